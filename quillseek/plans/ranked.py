"""The first rows of a frame, or of each group of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, n: int, order: list[Column], by: list[str]) -> DataFrame:
    """Without groups a top-k; with groups a ranked window, which Spark limits before the shuffle (`rn <= n`)."""
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on equal keys, null equal to null; right's keys are dropped."""
    if not keys:
        return left.crossJoin(F.broadcast(right)) if how != "left_semi" else left
    other = right.select(*[F.col(f"`{k}`").alias(f"__r{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`") for c in right.columns if c not in keys])
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(keys)]
    out = left.join(other, on, how)
    return out if how == "left_semi" else out.drop(*[f"__r{i}" for i in range(len(keys))])
