"""Flat results of nested buckets as one frame with nested arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranked import same_keys


def to_tree(results: dict[str, DataFrame], root: str) -> DataFrame:
    """The frame `root` with an array of structs for each bucket level below it. Arrays hold a parent's own buckets only."""
    out = results[root]
    depth = root.count(">")
    keys = out.columns[: out.columns.index("doc_count")]
    for name in [n for n in results if n.startswith(f"{root}>") and n.count(">") == depth + 1]:
        inner = to_tree(results, name)
        own = [c for c in inner.columns if c not in keys]
        label = name.rsplit(">", 1)[1]
        packed = inner.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in own])).alias(label))
        out = same_keys(out, packed, keys, "left")
    return out
