"""Line dedup with levelled sorted runs of line hashes.

The lines of all texts become a table of (document, text hash, line number, 96-bit hash),
written once. Batches of documents are then added one by one. A batch is reduced to one row for
each hash; it is merge-anti-joined with every run, and what no run has is added as a new run. What
some run has already is kept as counts beside the runs. Runs are tables in the shared folder,
bucketed and sorted by hash, so of the hashes only the batch shuffles, never the runs. When a level holds
`fanout` runs they are compacted into one run of the next level; a hash is in one run only.

Runs and counts together give in how many documents a line occurs and the largest id of
those. Lines of frequent keys go, except in that document. A line in most documents is no
hot spot: counting combines on the map side, and the join back takes the heaviest keys from
a broadcast of a fixed number of rows. The lines that go are a bit for each line of a text, and a
Bloom filter of a bounded size tells which texts may lose lines: only those shuffle, all others
pass straight through.

Defined cases: a null or empty text is one empty line; repeated rows of one id count as one
document, and each loses the same lines; rows without an id don't count and keep their lines;
lines shorter than the limit stay; lines may be any length; an empty table gives an empty
result; other columns are carried along, whatever their names, but those that have an output's
name are replaced. Tables of this module are removed, also when it fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import Bloom
from .common import SPACES, ascii_lower, attach, discard, every, free_name, remove_path, replacing, scratch_path, stored

LEAST_CHARS = 20
LEAST_DOCS = 3
BATCHES = 3
FANOUT = 2
#: 96 bits: by chance, equal for none of 10**12 lines.
KEY = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def hashed_lines(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(id, text, pos, h1, h2) of the lines with long enough keys; text is a hash of the whole."""
    text = F.col(f"`{text_col}`")
    texts = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text"), lines_of(ascii_lower(text)).alias("lines"))
    # outer: else Spark splits each text a second time to see whether it has lines
    keys = texts.select("id", "text", F.posexplode_outer("lines").alias("pos", "line")).select("id", "text", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.char_length("key") >= least_chars).select("id", "text", "pos", F.xxhash64("key").alias("h1"), F.hash(F.lit(7), "key").alias("h2"))


class LineRuns:
    """Levelled runs (h1, h2, n, last) as bucketed tables in the shared folder, and counts of later sightings."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_run_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]
        self.again: list[DataFrame] = []
        self.paths: dict[str, str] = {}
        self.made = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        self.made += 1
        table = f"{self.name}_{self.made}"
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)
        self.paths[table] = scratch_path(self.spark, "line-run")
        rows.repartition(self.buckets, *KEY).sortWithinPartitions(*KEY).write.format("parquet").option("compression", "zstd").option("path", self.paths[table]).bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(table)

    def _remove(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove_path(self.spark, self.paths.pop(table))

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def add(self, counts: DataFrame) -> None:
        """counts: h1, h2, n, last, a row for each hash of the batch."""
        runs = self.runs()
        if runs:
            counts = stored(counts, "line-batch")
        fresh = counts
        for run in runs:
            fresh = fresh.join(run.select(*KEY), KEY, "left_anti")
        self._write(fresh.select(*KEY, "n", "last"), 0)
        if runs:
            new = self.spark.table(self.levels[0][-1])
            self.again.append(stored(counts.join(new.select(*KEY), KEY, "left_anti").select(*KEY, "n", "last"), "line-again"))
            discard(self.spark, counts)
        self._compact()

    def _compact(self) -> None:
        for level, tables in enumerate(self.levels):
            if len(tables) >= self.fanout:
                merged = self.spark.table(tables[0])
                for t in tables[1:]:
                    merged = merged.unionByName(self.spark.table(t))
                self.levels[level] = []
                self._write(merged, level + 1)
                for t in tables:
                    self._remove(t)

    def frequent(self, least_docs: int) -> DataFrame:
        """(h1, h2, n, last) of the hashes in at least so many documents. First sightings lie in the runs, later ones beside them."""
        again = None
        for a in self.again:
            again = a if again is None else again.unionByName(a)
        if again is not None:
            again = again.groupBy(*KEY).agg(F.sum("n").alias("more"), F.max("last").alias("later"))
        out = None
        for run in self.runs():
            if again is None:
                part = run.where(F.col("n") >= least_docs)
            else:
                part = run.join(again, KEY, "left").select(*KEY, (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("last", "later").alias("last")).where(F.col("n") >= least_docs)
            out = part if out is None else out.unionByName(part)
        return out

    def drop(self) -> None:
        for t in [*self.paths]:
            self._remove(t)
        discard(self.spark, *self.again)
        self.levels, self.again = [[]], []


def _filled(masks: Column) -> Column:
    """Hexadecimal of (byte, mask) in order, with zeros where there is none."""
    since = lambda i: F.coalesce(F.when(i > 0, F.get(masks, i - 1)["byte"]), F.lit(-1))
    return F.array_join(F.transform(masks, lambda m, i: F.concat(F.repeat(F.lit("00"), m["byte"] - since(i) - 1), F.lpad(F.hex(m["mask"]), 2, "0"))), "")


def drops_of(docs: DataFrame, id_col: str, text_col: str, least_chars: int, least_docs: int, batches: int, fanout: int) -> DataFrame:
    """(id, text, gone, bits, n) of the texts that lose lines: their hash, how many lines go, and a bit for each line up to the last of them. Stored."""
    spark = docs.sparkSession
    lines = stored(hashed_lines(docs, id_col, text_col, least_chars), "line-hashes")
    runs, frequent = LineRuns(spark, fanout), None
    try:
        for i in range(batches):
            batch = lines.where(F.pmod(F.hash("id"), F.lit(batches)) == i)
            runs.add(batch.groupBy(*KEY).agg(F.count_distinct("id").alias("n"), F.max("id").alias("last")))
        frequent = stored(runs.frequent(least_docs), "line-frequent")
        found = attach(lines, frequent, KEY, "n", "inner").where("id <> last")
        byte = F.floor(F.col("pos") / 8).cast("int")
        masks = found.groupBy("id", "text", byte.alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, pos % 8)")).alias("mask"), F.count(F.lit(1)).alias("n"))
        masks = masks.groupBy("id", "text").agg(F.array_sort(F.collect_list(F.struct("byte", "mask"))).alias("masks"), F.sum(F.bit_count("mask")).alias("gone"), F.sum("n").alias("n"))
        # as an argument the sorted array is made once, not once for each element
        bits = F.element_at(F.transform(F.array("masks"), _filled), 1)
        return stored(masks.select("id", "text", "gone", F.unhex(bits).alias("bits"), "n"), "line-drops")
    finally:
        runs.drop()
        discard(spark, lines, *[] if frequent is None else [frequent])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with n_lines and n_dropped (long), and kept: the text without its dropped lines."""
    docs = replacing(docs, ("n_lines", "n_dropped", "kept"), (id_col, text_col))
    drops = drops_of(docs, id_col, text_col, least_chars, least_docs, batches, fanout)
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    names = {c: free_name(docs, f"line_{c}") for c in ("id", "text", "both", "maybe", "gone", "bits", "n")}
    key = lambda i, t: F.when(i.isNotNull(), F.xxhash64(i, t))
    bloom = Bloom(drops.select(key(F.col("id"), F.col("text")).alias("h")), "h")
    wide = docs.withColumn(names["text"], F.xxhash64(text)).withColumn(names["both"], key(ident, F.col(names["text"])))
    marked = bloom.mark(wide, names["both"], names["maybe"])
    whole = F.coalesce(text, F.lit(""))
    n_lines = (F.char_length(whole) - F.char_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long")
    alone = marked.where(~F.col(names["maybe"])).select(*every(docs), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), whole.alias("kept"))
    some = marked.where(F.col(names["maybe"])).withColumn(names["id"], ident).drop(names["both"], names["maybe"])
    joined = attach(some, drops.select(*[F.col(c).alias(names[c]) for c in drops.columns]), [names["id"], names["text"]], names["n"])
    gone, bits = F.col(names["gone"]), F.col(names["bits"])

    def stays(line: Column, at: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.call_function("getbit", byte, at % 8) == 0, F.lit(True))

    kept = F.when(gone.isNull(), whole).otherwise(F.array_join(F.filter(lines_of(text), stays), "\n"))
    touched = joined.select(*every(docs), n_lines.alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
    return alone.unionByName(touched)
