"""Aggregation expressions to flat DataFrames.

Metrics that share bucket keys run in one groupBy. A bucket level adds its key to those of its
parents; levels below a cut to the first n see only rows of surviving buckets, by a semi-join.
Each level's frame is [parents' keys, key, doc_count, metrics].
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import datemath, geo, intervals
from ..plans.gaps import fill_gaps
from ..plans.ranked import first_rows, same_keys
from ..rewrite.kinds import Agg
from ..sources.catalog import DATES, FieldCatalog, FieldRef
from ..streaming.guard import require_batch
from .conditions import Const, emit
from .predicate import typed

DEFAULT_PERCENTILES = (1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0)
DEFAULT_INTERVAL = 50.0
#: Rows up to which a frame of a known size is sorted as a top-k.
TOP_ROWS = 10_000
ROW_METRICS = ("min", "max", "avg", "sum", "stats", "exstats", "cardinality", "percentiles")


@dataclass
class Rows:
    """Input rows of a level: elements of exploded arrays are columns."""

    df: DataFrame
    elements: dict[str, Column]


class Aggregator:
    def __init__(self, config, catalog: FieldCatalog, compiler, start: dt.datetime | None = None, end: dt.datetime | None = None):
        self.config, self.catalog, self.compiler = config, catalog, compiler
        self.start, self.end = start, end
        self.results: dict[str, DataFrame] = {}
        self.names: dict[str, str] = {}
        self.meta: dict[str, dict] = {}

    def warn(self, message: str) -> None:
        self.compiler.context.result.warnings.append(message)

    def run(self, df: DataFrame, aggs: list[Agg]) -> dict[str, DataFrame]:
        rows = Rows(df, {})
        metrics = [a for a in aggs if not a.is_bucket and a.op != "tophits"]
        for frame, names in self._metric_frames(rows, [], metrics):
            for n in names:
                self.results[n] = frame.select(F.col(f"`{n}`"))
        for a in aggs:
            if a.op == "tophits":
                require_batch(df, "tophits")
                self.results[a.name] = self._hits(rows, [], a)
            elif a.is_bucket:
                self._bucket(rows, a, [], "")
        return self.results

    def metrics_row(self, df: DataFrame, aggs: list[Agg]) -> DataFrame:
        """All metrics of one pass as one row."""
        frames = self._metric_frames(Rows(df, {}), [], [a for a in aggs if not a.is_bucket and a.op != "tophits"])
        out = frames[0][0]
        for f, _ in frames[1:]:
            out = same_keys(out, f, [], "left")
        return out

    # fields

    def _ref(self, agg: Agg) -> FieldRef | None:
        ref = self.catalog.resolve(agg.field)
        if ref is None:
            self.compiler.context.result.unresolved_fields.add(agg.field)
        return ref

    def _exploded(self, rows: Rows, ref: FieldRef) -> Rows:
        """Rows with one row for each element of the arrays on the field's way, where that hasn't happened yet."""
        df, elements = rows.df, dict(rows.elements)
        for n in ref.arrays:
            path = ".".join(ref.path[:n])
            if path in elements:
                continue
            array = FieldRef(ref.path[:n], tuple(a for a in ref.arrays if a < n), None).column(elements)
            name = f"__e_{path.replace('.', '_')}"
            if self.catalog.nested_path(path) is None:
                array = F.array_distinct(array)
            df = df.withColumn(name, F.explode_outer(array))
            elements[path] = F.col(name)
            if self.config.nested_filter and self.catalog.nested_path(path):
                df = df.where(emit(self.compiler._filtered(path, Const(True)), elements))
        return Rows(df, elements)

    # metrics

    def _metric(self, agg: Agg, c: Column, kind: T.DataType | None) -> Column | None:
        numeric = isinstance(kind, T.NumericType)
        if agg.op in ("min", "max", "avg", "sum", "stats", "exstats", "cardinality") and agg.proximity:
            missing = typed(agg.proximity, kind)
            if missing is not None:
                c = F.coalesce(c, F.lit(missing))
        if agg.op in ("avg", "sum", "stats", "exstats", "percentiles") and not numeric:
            self.warn(f"{agg.name}: the field is no number")
            return F.lit(None).cast("double")
        if agg.op in ("min", "max", "avg", "sum"):
            return getattr(F, agg.op)(c)
        stats = [F.count(c).alias("count"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("avg"), F.sum(c).alias("sum")]
        if agg.op == "stats":
            return F.struct(*stats)
        if agg.op == "exstats":
            d = c.cast("double")
            mean, dev = F.avg(d), F.stddev_pop(d)
            more = [F.sum(d * d).alias("sum_of_squares"), F.var_pop(d).alias("variance"), dev.alias("std_deviation"), (mean + 2 * dev).alias("std_upper"), (mean - 2 * dev).alias("std_lower")]
            return F.struct(*stats, *more)
        if agg.op == "cardinality":
            return F.approx_count_distinct(c) if self.config.approx else F.count_distinct(c)
        if agg.op == "percentiles":
            wanted = []
            for p in (agg.proximity or "").split(","):
                try:
                    wanted.append(float(p))
                except ValueError:
                    continue
            points = [p / 100 for p in (wanted or DEFAULT_PERCENTILES)]
            return F.percentile_approx(c, points) if self.config.approx else F.percentile(c, points)
        return None

    def _metric_frames(self, rows: Rows, keys: list[str], aggs: list[Agg], extra: list[Column] = ()) -> list[tuple[DataFrame, list[str]]]:
        """Frames [keys, metrics]: one for all metrics of the rows, one more for each array that metrics look into."""
        groups: dict[tuple[str, ...], list[tuple[Agg, FieldRef]]] = {(): []}
        ready: list[tuple[str, Column]] = []
        for a in aggs:
            if a.ready is not None or a.op == "count":
                ready.append((a.name, a.ready if a.ready is not None else F.count(F.lit(1))))
                continue
            ref = self._ref(a)
            if ref is None or ref.relations:
                self.warn(f"{a.name}: no such field")
                continue
            groups.setdefault(tuple(p for p in ref.nested_paths if p not in rows.elements), []).append((a, ref))
        out = []
        for path, members in groups.items():
            if not members and not ((extra or ready) and path == ()):
                continue
            r = self._exploded(rows, members[0][1]) if path else rows
            columns = [*extra, *[m.alias(n) for n, m in ready]] if path == () else []
            names = [n for n, _ in ready] if path == () else []
            for a, ref in members:
                m = self._metric(a, ref.column(r.elements), ref.dtype)
                if m is not None and a.name not in names:
                    columns.append(m.alias(a.name))
                    names.append(a.name)
            if columns:
                out.append((r.df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*columns), names))
        return out

    # buckets

    def _key(self, rows: Rows, agg: Agg, ref: FieldRef, key: str) -> tuple[Rows, Callable[[DataFrame, list[str]], DataFrame] | None, Callable[[DataFrame], DataFrame] | None] | None:
        """(rows with the key, gap filling, last change of the key)"""
        rows = self._exploded(rows, ref)
        c, df = ref.column(rows.elements), rows.df
        if agg.op == "missing":
            return Rows(df.where(c.isNull()), rows.elements), None, None
        if agg.op == "terms":
            return Rows(self._with_terms(df, c, agg, ref, key), rows.elements), None, None
        if agg.op == "histogram":
            step = float(agg.proximity) if agg.proximity else DEFAULT_INTERVAL
            df = df.where(c.isNotNull()).withColumn(key, F.floor(c / F.lit(step)).cast("long"))
            return Rows(df, rows.elements), lambda f, by: fill_gaps(f, by, key, F.lit(1).cast("long")), lambda f: f.withColumn(key, F.col(f"`{key}`") * F.lit(step))
        if agg.op == "geogrid":
            precision = int(agg.proximity or 1)
            lat, lon = self.compiler._lat_lon(c, ref)
            df = df.where(lat.isNotNull() & lon.isNotNull()).withColumn(key, geo.geohash(lat, lon, precision)).withColumn("__lat", lat).withColumn("__lon", lon)
            return Rows(df, rows.elements), None, None
        return self._date_key(Rows(df, rows.elements), c, agg, ref, key)

    def _with_terms(self, df: DataFrame, c: Column, agg: Agg, ref: FieldRef, key: str) -> DataFrame:
        if missing := agg.option("missing"):
            literal = typed(missing[0].text, ref.dtype)
            c = F.coalesce(c, F.lit(literal)) if literal is not None else c
        df = df.withColumn(key, c).where(F.col(f"`{key}`").isNotNull())
        for name, keep in (("include", True), ("exclude", False)):
            options = agg.option(name)
            if not options:
                continue
            k = F.col(f"`{key}`")
            patterns = [t for t in options if t.regex]
            test = k.cast("string").rlike(f"^(?:{patterns[-1].term})$".replace("\\/", "/")) if patterns else k.isin([v for v in (typed(t.text, ref.dtype) for t in options) if v is not None])
            df = df.where(test if keep else ~test)
        return df

    def _date_key(self, rows: Rows, c: Column, agg: Agg, ref: FieldRef, key: str):
        if not isinstance(ref.dtype, DATES):
            self.warn(f"{agg.name}: the field is no date")
            return None
        kind, size = intervals.interval(agg.proximity, self.start, self.end)
        tz = datemath.zone_name(agg.boost or (self.config.timezone if self.config.timezone != "UTC" else None))
        offset = 0.0
        if found := agg.option("offset"):
            offset = intervals.seconds(found[0].text) * (-1 if found[0].prefix == "-" else 1)
        if (found := agg.option("missing")) and datemath.is_date(found[0].text):
            moment = datemath.evaluate(found[0].text, self.config.now)[0]
            c = F.coalesce(c.cast("timestamp_ntz") if not isinstance(ref.dtype, T.TimestampType) else c, F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz"))
        utc = F.lit("UTC")
        ntz = F.convert_timezone(F.current_timezone(), utc, c.cast("timestamp_ntz")) if isinstance(ref.dtype, T.TimestampType) else c.cast("timestamp_ntz")
        to_local = (lambda x: F.convert_timezone(utc, F.lit(tz), x)) if tz and kind == "calendar" else (lambda x: x)
        to_utc = (lambda x: F.convert_timezone(F.lit(tz), utc, x)) if tz and kind == "calendar" else (lambda x: x)
        df = rows.df.where(c.isNotNull())
        k = F.col(f"`{key}`")
        shift = F.expr(f"INTERVAL '{offset}' SECOND") if offset else None
        if kind == "calendar":
            cut = lambda x: F.date_trunc(size, x - shift if shift is not None else x).cast("timestamp_ntz") + (shift if shift is not None else F.expr("INTERVAL '0' SECOND"))
            df = df.withColumn(key, cut(to_local(ntz)))
            step = F.expr({"week": "INTERVAL 7 DAY", "quarter": "INTERVAL 3 MONTH"}.get(size, f"INTERVAL 1 {size.upper()}"))
        else:
            micros = round(size * 1_000_000)
            epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

            def cut(x: Column) -> Column:
                n = F.timestamp_diff("MICROSECOND", epoch, x)
                n = F.floor((n - round(offset * 1e6)) / F.lit(micros)).cast("long") * micros + round(offset * 1e6)
                return F.timestamp_add("MICROSECOND", n, epoch).cast("timestamp_ntz")

            df = df.withColumn(key, cut(ntz))
            step = F.expr(f"INTERVAL '{size}' SECOND")

        low = high = None
        if self.start and self.end:
            low, high = (cut(to_local(F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz"))) for t in (self.start, self.end))
        filled = lambda f, by: fill_gaps(f, by, key, step, low, high, intervals.LEAST_SECONDS[size] if kind == "calendar" else size)
        return Rows(df, rows.elements), filled, (lambda f: f.withColumn(key, to_utc(k))) if tz and kind == "calendar" else None

    def _bucket(self, rows: Rows, agg: Agg, by: list[str], path: str, most: int | None = 1) -> None:
        """most: how many parent buckets there are at most, if that is known."""
        ref = self._ref(agg)
        if ref is None or ref.relations:
            self.warn(f"{agg.name}: no such field")
            return
        name = f"{path}>{agg.name}" if path else agg.name
        key = agg.original if agg.original not in [*by, "doc_count"] else f"{agg.original}_{len(by)}"
        if agg.op != "missing" and key in rows.df.columns:
            # the key gets a column of its own beside the field
            plain, key = key, f"__key_{len(by)}"
        else:
            plain = key
        self.names[key] = plain
        if ref.dtype is not None:
            self.meta[key] = {"field_type": ref.dtype.simpleString()} | ({"timezone": agg.boost or self.config.timezone} if agg.op == "date" else {})
        made = self._key(rows, agg, ref, key)
        if made is None:
            return
        rows, fill, finish = made
        keys = [*by] if agg.op == "missing" else [*by, key]
        extra = [F.count(F.lit(1)).alias("doc_count")]
        if agg.op == "geogrid":
            extra += [F.avg("__lat").alias("avg_lat"), F.avg("__lon").alias("avg_lon")]
        metrics = [a for a in agg.children if not a.is_bucket and a.op != "tophits"]
        frames = self._metric_frames(rows, keys, metrics, extra)
        counts = frames[0][0]
        for f, _ in frames[1:]:
            counts = same_keys(counts, f, keys, "left")
        least = next((int(t.text) for t in agg.option("min") if t.text.isdigit()), int(agg.boost) if agg.op == "terms" and agg.boost and agg.boost.isdigit() else None)
        if least is not None:
            counts = counts.where(F.col("doc_count") >= least)
        elif fill and not rows.df.isStreaming:
            counts = fill(counts, by)
        order = self._order(agg, key, counts)
        cut, bound = False, most if agg.op == "missing" else None
        if agg.op == "terms":
            size = int(agg.proximity) if (agg.proximity or "").isdigit() else self.config.default_terms_size
            if size:
                require_batch(rows.df, "terms with a size")
                counts, cut = first_rows(counts, size, order, by), True
                bound = most * size if most else None
        elif fill:
            require_batch(rows.df, "a bucket with filled gaps")
        survivors = rows
        inner = [a for a in agg.children if a.is_bucket or a.op == "tophits"]
        if cut and inner:
            survivors = Rows(same_keys(rows.df, counts.select(*[F.col(f"`{k}`") for k in keys]), keys, "left_semi"), rows.elements)
        for a in inner:
            if a.op == "tophits":
                counts = same_keys(counts, self._hits(survivors, keys, a), keys, "left")
        for a in inner:
            if a.is_bucket:
                self._bucket(survivors, a, keys, name, bound)
        out = finish(counts) if finish else counts
        self.results[name] = self._shown(out, by, order, bound)

    def _shown(self, out: DataFrame, by: list[str], order: list[Column], bound: int | None) -> DataFrame:
        """In order, and with the fields' names for keys that stood beside their fields. With a bound on the rows, a top-k takes the global sort's place."""
        keys = [*[F.col(f"`{b}`").asc_nulls_last() for b in by], *order]
        if keys and self.config.ordered and not out.isStreaming:
            out = out.orderBy(*keys)
            if bound is not None and by and bound <= TOP_ROWS:
                out = out.limit(bound)
        return out.select(*[F.col(f"`{c}`").alias(self.names.get(c, c), metadata=self.meta.get(c, {})) for c in out.columns])

    def _order(self, agg: Agg, key: str, counts: DataFrame) -> list[Column]:
        k = F.col(f"`{key}`")
        if agg.op == "missing":
            return []
        if agg.op != "terms":
            return [k.asc()]
        order = []
        for a in agg.children:
            if a.prefix in ("+", "-") and a.name in counts.columns:
                c = F.col(f"`{a.name}`")
                order.append(c.desc_nulls_last() if a.prefix == "-" else c.asc_nulls_last())
        return [*(order or [F.col("doc_count").desc()]), k.asc()]

    # hits

    def _hits(self, rows: Rows, keys: list[str], agg: Agg) -> DataFrame:
        """[keys, tophits]: the first n rows of each bucket as structs, by the configured order."""
        n = int(agg.proximity) if (agg.proximity or "").isdigit() else 3
        source = [f for f in self.catalog.schema.fieldNames()]
        wanted, dropped = [t.text for t in agg.option("include")], [t.text.lower() for t in agg.option("exclude")]
        if wanted:
            refs = [r for w in wanted if (r := self.catalog.resolve(w)) is not None]
            columns = [r.column(rows.elements).alias(r.path[-1]) for r in refs]
        else:
            columns = [F.col(f"`{f}`") for f in source if f.lower() not in dropped]
        from ..lang import parse
        from .sort import sort_columns

        order = sort_columns(parse(self.config.tophits_order), self.catalog, self.config, self.compiler) if self.config.tophits_order else [F.col(f"`{source[0]}`").asc_nulls_last()]
        if keys:
            ranked = rows.df.withColumn("__rn", F.row_number().over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order))).where(F.col("__rn") <= n)
        else:
            ranked = rows.df.orderBy(*order).limit(n).withColumn("__rn", F.monotonically_increasing_id())
        packed = ranked.select(*[F.col(f"`{k}`") for k in keys], F.struct(F.col("__rn"), F.struct(*columns).alias("hit")).alias("__h"))
        hits = F.transform(F.sort_array(F.collect_list("__h")), lambda h: h.getField("hit"))
        return packed.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(hits.alias("tophits"))
