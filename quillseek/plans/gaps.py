"""Empty buckets between the first and the last, for each parent bucket on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranked import same_keys

#: Buckets that one parent may have, gaps included, and steps that one array holds.
MOST, STRETCH = 1_000_000, 10_000


def fill_gaps(counts: DataFrame, by: list[str], key: str, step: Column, low: Column | None = None, high: Column | None = None, seconds: float | None = None) -> DataFrame:
    """counts with a row for every step of `key` from each parent's least to its greatest, or from low to high if that is wider.

    seconds: the length of a step at least, for keys that are times. Over MOST buckets of a
    parent are an error. Steps are made in stretches of STRETCH, so no row holds all of them.
    """
    least, most = F.min(F.col(f"`{key}`")), F.max(F.col(f"`{key}`"))
    least = F.least(least, low) if low is not None else least
    most = F.greatest(most, high) if high is not None else most
    parents = [F.col(f"`{b}`") for b in by]
    bounds = (counts.groupBy(*parents) if by else counts.groupBy()).agg(least.alias("__least"), most.alias("__most")).where("__least IS NOT NULL")
    width = F.col("__most").cast("double") - F.col("__least").cast("double") if seconds is None else F.timestamp_diff("SECOND", F.col("__least"), F.col("__most")).cast("double") / seconds
    many = F.when(width >= MOST, F.raise_error(F.concat(F.lit(f"{key}: more than {MOST} buckets with gaps; use a longer interval, @min or a filter. From "), F.col("__least").cast("string"), F.lit(" to "), F.col("__most").cast("string")))).otherwise(width)
    starts = F.sequence("__least", "__most", step * STRETCH)
    stretches = bounds.withColumn("__many", many).where("__many >= 0").select(*parents, "__most", F.explode(starts).alias("__from"))
    until = F.least(F.col("__most"), F.col("__from") + step * (STRETCH - 1))
    every = stretches.select(*parents, F.explode(F.sequence("__from", until, step)).alias(key))
    out = same_keys(every, counts, [*by, key], "left")
    return out.withColumn("doc_count", F.coalesce("doc_count", F.lit(0).cast("long"))).select(*[F.col(f"`{c}`") for c in counts.columns])
