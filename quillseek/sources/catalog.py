"""The catalogue of fields that expressions can name.

Built from a DataFrame's schema; aliases, analyzed text fields, computed fields, geo fields
and relations to other DataFrames are laid over it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from dataclasses import field as dc_field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)
SUB_FIELDS = ("keyword", "sort")


@dataclass
class Relation:
    """Rows of another DataFrame that belong to a row: child.child_key = own parent_key, maybe over a bridge.

    kind: `many` (any related row counts) or `one`. bridge: (DataFrame, its key to us, its key to the child).
    """

    child: DataFrame
    parent_key: str
    child_key: str
    kind: str = "many"
    catalog: FieldCatalog | None = None
    bridge: tuple[DataFrame, str, str] | None = None

    def fields(self) -> FieldCatalog:
        if self.catalog is None:
            self.catalog = FieldCatalog.from_schema(self.child.schema)
        return self.catalog


@dataclass
class FieldRef:
    """A resolved field: struct steps, the arrays on its way (as lengths of its path), its type."""

    path: tuple[str, ...]
    arrays: tuple[int, ...]
    dtype: T.DataType | None
    analyzed: bool = False
    geo: bool = False
    sort_form: bool = False
    compute: Callable[[], Column] | None = None
    relations: tuple[Relation, ...] = ()
    metadata: dict = dc_field(default_factory=dict)

    @property
    def name(self) -> str:
        return ".".join(self.path)

    @property
    def nested_paths(self) -> list[str]:
        return [".".join(self.path[:n]) for n in self.arrays]

    def column(self, elements: dict[str, Column] | None = None) -> Column:
        """The value, read from the element of the innermost array at hand."""
        if self.compute is not None:
            return self.compute()
        for n in reversed(self.arrays):
            key = ".".join(self.path[:n])
            if elements and key in elements:
                out = elements[key]
                for step in self.path[n:]:
                    out = out.getField(step)
                return out
        return F.col(".".join(f"`{p}`" for p in self.path))


@dataclass
class FieldCatalog:
    schema: T.StructType
    aliases: dict[str, str] = dc_field(default_factory=dict)
    analyzed: set[str] = dc_field(default_factory=set)
    sort_forms: set[str] = dc_field(default_factory=set)
    geo: set[str] = dc_field(default_factory=set)
    computed: dict[str, tuple[str | Column, T.DataType]] = dc_field(default_factory=dict)
    relations: dict[str, Relation] = dc_field(default_factory=dict)
    max_depth: int = 10
    field_filter: Callable[[str], bool] | None = None

    @classmethod
    def from_schema(cls, schema: T.StructType, **more) -> FieldCatalog:
        return cls(schema, **more)

    def add_keyword_field(self, name: str) -> FieldCatalog:
        """An analyzed text field whose `.keyword` form is exact."""
        self.analyzed.add(name.lower())
        return self

    def add_sort_field(self, name: str) -> FieldCatalog:
        """A text field that sorts by its lower-cased form without accents."""
        self.sort_forms.add(name.lower())
        return self

    def add_keyword_and_sort_fields(self, name: str) -> FieldCatalog:
        return self.add_keyword_field(name).add_sort_field(name)

    def _descend(self, parts: list[str]) -> tuple[list[str], list[int], T.DataType | None, dict] | None:
        path, arrays, kind, meta = [], [], self.schema, {}
        for part in parts:
            while isinstance(kind, T.ArrayType):
                arrays.append(len(path))
                kind = kind.elementType
            if isinstance(kind, T.MapType):
                path.append(part)
                kind = kind.valueType
                continue
            if not isinstance(kind, T.StructType):
                return None
            exact = [f for f in kind.fields if f.name == part] or [f for f in kind.fields if f.name.lower() == part.lower()]
            if not exact:
                return None
            path.append(exact[0].name)
            kind, meta = exact[0].dataType, exact[0].metadata
        if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.StructType):
            arrays.append(len(path))
            kind = kind.elementType
        return path, arrays, kind, meta

    def resolve(self, name: str | None, depth: int = 0) -> FieldRef | None:
        """The field of a dotted name in any case; None if there is none."""
        if not name or depth > self.max_depth:
            return None
        if self.field_filter and not self.field_filter(name):
            return None
        low = name.lower()
        for alias, target in self.aliases.items():
            if low == alias.lower() or low.startswith(alias.lower() + "."):
                return self.resolve(target + name[len(alias) :], depth + 1)
        for computed, (expression, kind) in self.computed.items():
            if low == computed.lower():
                column = F.expr(expression) if isinstance(expression, str) else expression
                return FieldRef((computed,), (), kind, analyzed=low in self.analyzed, compute=lambda: column)
        parts = name.split(".")
        for relation_name, relation in self.relations.items():
            if parts[0].lower() == relation_name.lower():
                if len(parts) == 1:
                    return FieldRef((), (), None, relations=(relation,))
                ref = relation.fields().resolve(".".join(parts[1:]), depth + 1)
                if ref is not None:
                    ref.relations = (relation, *ref.relations)
                return ref
        tops = [f.name for f in self.schema.fields if f.name == name] or [f.name for f in self.schema.fields if f.name.lower() == low]
        found = self._descend(tops[:1] if tops else parts)
        sub = None
        if found is None and parts[-1].lower() in SUB_FIELDS and len(parts) > 1:
            found, sub = self._descend(parts[:-1]), parts[-1].lower()
        if found is None:
            return None
        path, arrays, kind, meta = found
        full = ".".join(path).lower()
        is_text = isinstance(kind, T.StringType)
        geo = full in {g.lower() for g in self.geo} or (isinstance(kind, T.StructType) and {"lat", "lon"} <= {f.name.lower() for f in kind.fields})
        names = {a.lower() for a in self.analyzed}
        return FieldRef(tuple(path), tuple(arrays), kind, analyzed=is_text and sub is None and full in names, geo=geo, sort_form=is_text and sub != "keyword" and full in {s.lower() for s in self.sort_forms}, metadata=meta)

    def text_fields(self) -> list[str]:
        return [f.name for f in self.schema.fields if isinstance(f.dataType, T.StringType)]

    def nested_path(self, name: str | None) -> str | None:
        """The array of structs that a name stands for."""
        if not name:
            return None
        found = self._descend(name.split("."))
        if found and isinstance(found[2], T.ArrayType) and isinstance(found[2].elementType, T.StructType):
            return ".".join(found[0])
        return None

    def field_names(self, prefix: str = "", schema: T.DataType | None = None, depth: int = 0) -> Iterable[str]:
        """All dotted names down to max_depth."""
        schema = self.schema if schema is None else schema
        for f in schema.fields:
            kind = f.dataType
            while isinstance(kind, T.ArrayType):
                kind = kind.elementType
            if isinstance(kind, T.StructType) and depth < self.max_depth:
                yield from self.field_names(f"{prefix}{f.name}.", kind, depth + 1)
            elif self.field_filter is None or self.field_filter(prefix + f.name):
                yield prefix + f.name
        if not prefix:
            for name, relation in self.relations.items():
                for inner in relation.fields().field_names():
                    yield f"{name}.{inner}"
