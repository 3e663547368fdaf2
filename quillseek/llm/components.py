"""Connected components over edge tables, by alternating star contraction. The edges of a hub are spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("degree"))
    out = attach(both.where("v > u"), least, ["u"], "degree", "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them; edges lead from u down to v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    joined = attach(edges.select("u", "v"), least, ["u"], "degree", "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the smallest node reachable.

    Each round writes its edges to the shared folder. It ends when a round changes
    nothing; then every edge leads from a node to its root. Self-loops, repeated edges and
    an empty table are fine; edges with a null end are ignored.
    """
    spark = edges.sparkSession
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = stored(edges, "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before or not mark[0]:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
            out.scratch = now.scratch
            return out
        before = tuple(mark)
        following = stored(_small_star(_large_star(now)), "edges")
        discard(spark, now)
        now = following
