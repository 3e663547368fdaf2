"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at Hamming distance 3 or less share a point between them, so both reach it
by flipping few bits: a fingerprint emits its *ball*, all variants within half the radius,
the variants are shuffled and equal ones meet. Work is done in two rounds:

1. On the 32-bit halves. One half of a linked pair differs by at most one bit, half the
   radius rounded down. Every fingerprint emits its two halves and their 64 one-bit
   variants; a semi-join on the variants keeps a fingerprint if a colliding one verifies at
   distance 3 or less. It returns each fingerprint at most once a variant, never pairs. Of the
   HEAVY_ROWS commonest halves, those of over COMMON fingerprints are split by the quarters of the other half.
2. On the whole 64 bits, for the linked fingerprints alone. Even ones (by parity) emit all
   variants within 2 bits, odd ones those at exactly 1 bit; at distance 1 and 3 the parities
   differ, at distance 2 both reach a point 1 bit away. At a variant at most 2,081 different
   fingerprints can meet. If one of them is within 1 bit, all are within 3 of it, so a star
   around it holds every link that this variant proves: edges grow in proportion to the
   members, and no pairs of a group are made. The rest of a variant's members are 4 apart.

The components of the stars are the components of the full graph of links.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and
is linked like any other; fewer than three words are one shingle; copies share a
fingerprint and so a component; very long texts are hashed in slices of SLICE shingles;
rows that share an id are each linked by their own text; a row without an id is linked, but has
no id to give to its component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import Bloom
from .common import HEAVY_ROWS, attach, discard, every, free_name, replacing, small_batches, stored, with_field
from .components import connected_components

SEED = 42
RADIUS = 3
#: Shingles whose bits are counted at a time.
SLICE = 1 << 16
#: Fingerprints with a common half from which on it is looked at in quarters.
COMMON = 1000


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of the text's word shingles, each with its repeats."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    k = min(width, len(words))
    starts, ends = (ends - lengths)[: len(words) - k + 1], ends[k - 1 :]
    h, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), SLICE):
        some = [h(joined[i:j], SEED) for i, j in zip(starts[at : at + SLICE].tolist(), ends[at : at + SLICE].tolist(), strict=True)]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fp", width: int = 3) -> DataFrame:
    """docs with a long column: the fingerprint's 64 bits, as signed. It replaces a column of its name."""
    docs = replacing(docs, (out,), (text_col,))
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps, pa.int64())], names=[*b.schema.names, out])

    return docs.mapInArrow(run, with_field(docs.schema, (out, T.LongType())))


def _flips(fp: Column, low: int, high: int) -> Column:
    one = F.lit(1).cast("long")
    return F.transform(F.sequence(F.lit(low), F.lit(high - 1)), lambda i: fp.bitwiseXOR(F.call_function("shiftleft", one, i)))


def linked(fps: DataFrame) -> DataFrame:
    """Round 1: the distinct fingerprints that have another within RADIUS."""
    low, one, top = F.lit(0xFFFFFFFF), F.lit(1).cast("long"), F.lit(1 << 32)
    left = F.shiftrightunsigned("fp", 32)
    right = F.col("fp").bitwiseAND(low)
    centres = fps.select(F.col("fp").alias("other"), F.explode(F.array(left, right + top)).alias("ckey"))

    def ball(half: Column) -> Column:
        return F.concat(F.array(half), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: half.bitwiseXOR(F.call_function("shiftleft", one, i))))

    variants = fps.select("fp", F.explode(F.concat(ball(left), F.transform(ball(right), lambda x: x + top))).alias("key"))
    common = stored(centres.groupBy("ckey").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMMON).orderBy(F.desc("n"), "ckey").limit(HEAVY_ROWS).select(F.col("ckey").alias("heavy")), "simhash-common")
    if common.count():
        # the other half of a linked pair differs by at most 3 bits, so one of its quarters by at most 1
        variants, centres = (_quartered(rows, fp, key, common, flips) for rows, fp, key, flips in ((variants, "fp", "key", True), (centres, "other", "ckey", False)))
        same = (F.col("key") == F.col("ckey")) & (F.col("key_part") == F.col("ckey_part"))
    else:
        same = F.col("key") == F.col("ckey")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS
    return variants.join(centres, same & (F.col("fp") != F.col("other")) & near, "left_semi").select("fp").distinct()


def _quartered(rows: DataFrame, fp: str, key: str, common: DataFrame, flips: bool) -> DataFrame:
    """rows with key_part: for a common half, the quarters of the other half (with `flips` also their one-bit variants), else 0."""
    one, of_left = F.lit(1).cast("long"), F.col(key) < F.lit(1 << 32)
    other = F.when(of_left, F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(fp, 32))
    parts = []
    for mark, quarter in ((1, other.bitwiseAND(F.lit(0xFFFF))), (2, F.shiftrightunsigned(other, 16))):
        parts += [F.lit(mark << 16) + (quarter.bitwiseXOR(F.call_function("shiftleft", one, F.lit(i))) if i >= 0 else quarter) for i in range(-1, 16 if flips else 0)]
    found = rows.join(F.broadcast(common), F.col(key) == F.col("heavy"), "left")
    return found.select(fp, key, F.explode(F.when(F.col("heavy").isNotNull(), F.array(*parts)).otherwise(F.array(F.lit(0).cast("long")))).alias(f"{key}_part"))


def star_edges(fps: DataFrame) -> DataFrame:
    """Round 2: edges (u, v) of stars that connect what links connect; fps are distinct."""
    one = F.lit(1).cast("long")
    odd = F.bit_count("fp").bitwiseAND(1) == 1
    single = F.transform(_flips(F.col("fp"), 0, 64), lambda x: F.struct(x.alias("key"), F.lit(1).alias("d")))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.transform(F.sequence(i + 1, F.lit(63)), lambda j: F.struct(F.col("fp").bitwiseXOR(F.call_function("shiftleft", one, i)).bitwiseXOR(F.call_function("shiftleft", one, j)).alias("key"), F.lit(2).alias("d")))))
    own = F.array(F.struct(F.col("fp").alias("key"), F.lit(0).alias("d")))
    balls = fps.select("fp", F.inline(F.when(odd, single).otherwise(F.concat(own, single, pairs))))
    rep = F.expr("min(CASE WHEN d <= 1 THEN fp END) OVER (PARTITION BY key)")
    return balls.withColumn("rep", rep).where("rep IS NOT NULL AND rep <> fp").select(F.col("rep").alias("u"), F.col("fp").alias("v")).distinct()


def near_components(rows: DataFrame) -> DataFrame:
    """rows (id, fp, ...) with component_id: the smallest id reachable over links."""
    per = stored(rows.where("fp IS NOT NULL").groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-fps")
    near = stored(linked(per.select("fp")), "simhash-linked")
    roots = connected_components(star_edges(near.repartition("fp")))
    member = per.join(roots, per.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    member = stored(member, "simhash-roots")
    discard(rows.sparkSession, per, near, roots)
    smallest = member.where("root <> fp").groupBy("root").agg(F.min("least").alias("below"), F.count(F.lit(1)).alias("size")).withColumnRenamed("root", "r")
    heads = member.where("root = fp").join(smallest, F.col("root") == F.col("r"), "left").select("root", F.least("least", "below").alias("component_id"), F.coalesce("size", F.lit(0)).alias("size"))
    found = attach(member.select("fp", "n", "root"), heads, ["root"], "size").select("fp", "component_id", "n")
    return attach(rows, found, ["fp"], "n").drop("n")


def near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, text_hash, fp, component_id) for every row of docs, each text whole."""
    text = F.col(f"`{text_col}`")
    rows = with_fingerprint(docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash")), "text", "fp", width)
    return near_components(stored(rows.select("id", "text_hash", "fp"), "simhash-rows"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """docs without near copies: of each component the row of the smallest id stays, whole.

    A row goes if its component has a smaller id than its own; rows that share id and text stay or go
    together, and rows without an id stay. A Bloom filter of a bounded size tells which rows may
    go: only those shuffle.
    """
    drop = near_dups(docs, id_col, text_col, width).where("component_id <> id").select("id", "text_hash").distinct()
    names = {c: free_name(docs, f"near_{c}") for c in ("id", "text", "both", "maybe")}
    drop = stored(drop.select(F.col("id").alias(names["id"]), F.col("text_hash").alias(names["text"])), "simhash-drop")
    both = F.xxhash64(F.col(names["id"]), F.col(names["text"]))
    ident, text = F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))
    marked = Bloom(drop.select(both.alias("h")), "h").mark(docs.withColumn(names["both"], F.xxhash64(ident, text)), names["both"], names["maybe"])
    alone = marked.where(~F.col(names["maybe"])).select(*every(docs))
    some = marked.where(F.col(names["maybe"])).join(drop, (ident == F.col(names["id"])) & (text == F.col(names["text"])), "left_anti")
    return alone.unionByName(some.select(*every(docs)))
