"""Exact dedup by two-pass Bloom filtering.

Pass 1 fills a counting Bloom filter: the 64-bit hash of a text names two of its cells, and
each row counts in them. Counts combine in the task before they travel, so a task sends at most the
filter, and are merged by ranges of cells. What is broadcast is one bit a cell: whether two
rows met there. Pass 2 asks it about every row: a text that is repeated finds all its cells
met. Only rows that may be repeated shuffle, all others pass straight through. A false answer
costs a shuffled row, never a wrong result; equality itself is decided by SHA-256.

The filter has 16 cells for each row, at most max_blocks blocks of 4 KiB whatever the input: 16 MiB hold some 8 million rows at 1.4 % of false answers, 33 million at 15 %; beyond
134 million three rows of four travel, and pass 2 is no more than a shuffle. Give more blocks
where executors have room.

Defined cases: null text counts as empty; equal texts are those identical after lower-casing
A-Z; the row with the largest id stays (a null id is smaller than any other); of rows that
also share the id, the one whose raw text, then whole row, has the largest hash, and of
identical rows exactly one; an empty table gives an empty result; other columns are carried
along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import MAX_BLOCKS, Bloom
from .common import ascii_lower, attach, discard, every, free_name, row_hash, stored

def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    The text is read once: a table of hashes in the shared folder feeds both passes.
    """
    raw = docs[text_col]
    base = docs.select(docs[id_col].alias("id"), normalised(raw).alias("t"), F.xxhash64(raw).alias("raw"), row_hash(docs).alias("row"))
    base = base.select("id", F.xxhash64("t").alias("h"), F.unhex(F.sha2("t", 256)).alias("sha"), "raw", "row", F.monotonically_increasing_id().alias("rid"))
    base = stored(base, "exact-hashes")
    marked = Bloom(base, "h", 2, max_blocks).mark(base, "h", "maybe")
    alone = marked.where(~F.col("maybe")).select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    some = marked.where("maybe").select("id", "sha", "rid", "raw", "row")
    groups = some.groupBy("sha").agg(F.max("id").alias("keep_id"), F.max_by("rid", F.struct("id", "raw", "row", "rid")).alias("keep_rid"), F.count(F.lit(1)).alias("group_size"))
    met = attach(some.select("id", "sha", "rid"), groups, ["sha"], "group_size").select("id", "sha", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"))
    return alone.unionByName(met).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The rows of docs that stay, whole and with all their columns.

    Rows that the filter has not met pass through without a shuffle; of the others the
    aggregate keeps each group's best row, combined before the shuffle.
    """
    h, flag = free_name(docs, "exact_hash"), free_name(docs, "exact_maybe")
    hash_of = F.xxhash64(normalised(docs[text_col]))
    hashes = stored(docs.select(hash_of.alias("h")), "exact-hashes")
    bloom = Bloom(hashes, "h", 2, max_blocks)
    discard(docs.sparkSession, hashes)
    marked = bloom.mark(docs.withColumn(h, hash_of), h, flag)
    alone = marked.where(~F.col(flag)).select(*every(docs))
    one = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rank = F.struct(F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`")), row_hash(docs))
    some = marked.where(F.col(flag)).select(F.sha2(normalised(F.col(f"`{text_col}`")), 256).alias("key"), rank.alias("rank"), one.alias("one"))
    best = some.groupBy("key").agg(F.max_by("one", "rank").alias("one"))
    return alone.union(best.select(*[F.col(f"one.c{i}").alias(c) for i, c in enumerate(docs.columns)]))
