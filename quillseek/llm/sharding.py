"""Sharding by minimax contiguous partition of ordered atomic groups.

Texts are ordered by their hash. Equal texts are a group, and groups are never split. The
sizes of groups are folded, in this order, into 2**CELL_BITS cells of equal hash ranges, so
what the driver plans over has a fixed size whatever the input; a cell is the atom. A binary
search finds the smallest capacity for which a greedy pass needs no more than the asked-for
shards. Cuts are then made within that capacity, each as near to an even share as it allows.

Slots number a shard's rows from 0 without gaps. They come from two levels: rows are numbered
within (cell, one of SALTS by the id's hash), and these small parts get offsets from running sums over
at most 2**CELL_BITS * SALTS counts. A hot group, one cell, is so spread over SALTS tasks.

Defined cases: a null text is empty; ties and repeated rows get different slots; fewer groups than shards
leave shards empty; an empty table gives an empty result. Other columns are not returned.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CELL_BITS = 16
SALTS = 256
#: Bytes that a row counts besides its text.
ROW_BYTES = 16


def feasible(sums: list[int], capacity: int, shards: int) -> list[int] | None:
    """Where a greedy pass from the left cuts, or None if it needs more shards. sums: running sums from 0 on."""
    cuts, at, last = [], 0, len(sums) - 1
    for _ in range(shards):
        at = bisect_right(sums, sums[at] + capacity) - 1
        cuts.append(at)
        if at == last:
            return cuts + [last] * (shards - len(cuts))
    return None


def minimax_cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """(smallest feasible capacity, end of each shard) for ordered atoms."""
    sums = [0, *accumulate(sizes)]
    total, last = sums[-1], len(sizes)
    low, high = max(max(sizes, default=0), -(-total // shards)), max(total, 1)
    while low < high:
        middle = (low + high) // 2
        if feasible(sums, middle, shards):
            high = middle
        else:
            low = middle + 1
    latest = feasible(sums, high, shards)
    mirrored = [total - s for s in reversed(sums)]
    earliest = [last - c for c in reversed(feasible(mirrored, high, shards)[:-1])] + [last]
    cuts, at = [], 0
    for k in range(shards):
        most = min(latest[k], bisect_right(sums, sums[at] + high) - 1)
        ideal = sums[at] + (total - sums[at]) / (shards - k)
        near = bisect_right(sums, ideal) - 1
        near += near < last and sums[near + 1] - ideal < ideal - sums[near]
        at = min(max(near, earliest[k], at), most)
        cuts.append(at)
    cuts[-1] = last
    return high, cuts


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard, slot for every row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - CELL_BITS).cast("int").alias("cell"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int").alias("salt"),
    )
    rows = stored(rows, "shard-rows")
    cells = rows.groupBy("cell").agg(F.sum("size").alias("size")).orderBy("cell").collect()
    _, cuts = minimax_cuts([r["size"] for r in cells], shards)
    # the smallest cell of each shard: a literal of at most `shards` numbers
    begins = [(k, cells[at]["cell"]) for k, at in enumerate([0, *cuts[:-1]]) if at < cuts[k]]
    of = F.lit(0)
    for k, first in begins:
        of = F.when(F.col("cell") >= first, k).otherwise(of)
    parts = rows.groupBy("cell", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("shard", of)
    before = Window.partitionBy("shard").orderBy("cell", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("cell").alias("c"), F.col("salt").alias("s"), "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("cell", "salt").orderBy("id", "crc", "size")
    numbered = rows.withColumn("rn", F.row_number().over(within) - 1)
    out = numbered.join(offsets, (F.col("cell") == F.col("c")) & (F.col("salt") == F.col("s")))
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("offset") + F.col("rn")).cast("long").alias("slot"))


