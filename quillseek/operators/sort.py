"""Sort expressions to ordering columns: ascending unless marked, nulls last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, text
from ..rewrite.kinds import sort_terms
from ..sources.catalog import FieldCatalog, FieldRef
from .conditions import emit


def _nested_value(ref: FieldRef, down: bool, elements: dict[str, Column], level: int, keep) -> Column:
    """The least value of all elements for ascending order, the greatest for descending."""
    n = ref.arrays[level]
    path = ".".join(ref.path[:n])
    array = FieldRef(ref.path[:n], tuple(a for a in ref.arrays if a < n), None).column(elements)
    if keep is not None and level == len(ref.arrays) - 1:
        array = F.filter(array, lambda e: F.coalesce(keep(path, {**elements, path: e}), F.lit(True)))

    def value(e: Column) -> Column:
        inner = {**elements, path: e}
        if level + 1 < len(ref.arrays):
            return _nested_value(ref, down, inner, level + 1, keep)
        return ref.column(inner)

    values = F.transform(array, value)
    return F.array_max(values) if down else F.array_min(values)


def sort_columns(node, catalog: FieldCatalog, config, compiler) -> list[Column]:
    out = []
    for term, down in sort_terms(node):
        if (ready := term.data.get("sort")) is not None:
            out.append(ready)
            continue
        name = term.name or term.text
        ref = catalog.resolve(name)
        if ref is None:
            compiler.context.result.unresolved_fields.add(name)
            column = F.lit(None).cast("string")
        elif ref.geo and term.field and term.term:
            lat, lon = compiler._lat_lon(ref.column(), ref)
            column = geo.haversine(lat, lon, geo.location(compiler._place(term.text)))
        elif ref.arrays:
            keep = None
            if config.nested_filter:
                from .conditions import Const

                keep = lambda path, elements: emit(compiler._filtered(path, Const(True)), elements)
            column = _nested_value(ref, down, {}, 0, keep)
        else:
            column = ref.column()
        if ref is not None and ref.sort_form and isinstance(ref.dtype, T.StringType):
            column = text.sort_form(column)
        out.append(column.desc_nulls_last() if down else column.asc_nulls_last())
    return out
