"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words: its weight's share of all words, at most MOST times
what it has; what that cuts off goes to the others by weight. A document is expected to be
taken rate = target / size of its source times (times its own weight, if it has one, MOST times
at most). The whole part is allocated for certain. What is left of the target is sampled: the
odds of a document's inclusion are those of the rest of its rate, times the fourth root of its
length against the mean of its source, so that scraps are repeated less than full texts.
Documents are ranked by the odds of a random number divided by the odds of inclusion, and each
source takes its first ones. The sample's fixed size is one of words, as targets are: it ends
at the document that comes nearest to the target.

The random number is a hash of id, text and seed, so reruns agree. No source is ordered in one
task: word sums over FINE ranges of the rank show in which range the target is met, and sums
over parts of that range narrow it again until at most SMALL documents are in it; only those are
ordered. What a source takes is then one bound of the rank, so copies are a function of the
row and its source: no row is looked up by its id.

Defined cases: a null text has size 0; a null source is a source, the last; a source without
words has target 0; rows without an id, or that share one, are rows like others; rows that
are equal in id, text and source are taken equally often; an empty table gives an empty
result; a weight that is null counts as 1, one below 0 as 0. `mix` returns ids with their numbers,
`replicate` all columns under their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HEAVY_ROWS, attach, discard, every, free_name, stored

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
#: Ranges that a range of ranks is divided into, as bits; and bits of a rank in all.
FINE_BITS, RANK_BITS = 12, 48
#: Documents in the last range of a source from which on it is divided again.
SMALL = 20_000
#: Parts in which sources are put into order.
PARTS = 64
SEED = "mix"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """sources (skey, source, source_size, ...) with target. Weights follow the sources' code point order, null last.

    Sources are ordered in parts; the driver sees how many each part has, and sums over all.
    """
    order = F.col("source").asc_nulls_last()
    parts = stored(sources.repartitionByRange(PARTS, order).withColumn("part", F.spark_partition_id()), "mix-order")
    many = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    before = F.array(*[F.lit(sum(n for p, n in many.items() if p < k)).cast("long") for k in range(max(many, default=0) + 1)])
    place = F.element_at(before, F.col("part") + 1) + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(place, F.lit(len(cycle))) + 1).cast("int"))
    weighed = stored(parts.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(MOST))).drop("part"), "mix-weights")
    discard(weighed.sparkSession, parts)
    # words for each unit of weight: it grows while that caps further sources
    level, following = None, 0.0
    while following != level:
        level = following
        capped = F.col("cap") / F.col("weight") < level
        total, caps, rest = weighed.agg(F.sum("source_size"), F.sum(F.when(capped, F.col("cap")).otherwise(0.0)), F.sum(F.when(~capped, F.col("weight")).otherwise(0.0))).first()
        following = (total - caps) / rest if rest else 0.0
    return weighed.withColumn("target", F.least(F.col("cap"), F.lit(level) * F.col("weight"))).drop("weight", "cap")


def _seen(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None, seed: str) -> dict[str, Column]:
    """What sampling needs of a row."""
    own = F.lit(1.0) if weight_col is None else F.greatest(F.coalesce(docs[weight_col].cast("double"), F.lit(1.0)), F.lit(0.0))
    text = F.md5(F.coalesce(docs[text_col], F.lit("")))
    return {
        "source": docs[source_col],
        "skey": F.coalesce(F.concat(F.lit("s"), docs[source_col]), F.lit("n")),
        "size": n_words(docs[text_col]),
        "own": own,
        "digest": F.md5(F.concat(F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit(":"), text, F.lit(f":{seed}"))),
    }


def _expected(row: dict[str, Column]) -> tuple[Column, Column]:
    """(copies for certain, place in the sampling order or null), of a row with its source's n, source_size, own_size and target.

    The place is the Pareto rank r as r / (r + what it is on average): in the same order, but from 0 to 1.
    """
    rate = F.when(row["own_size"] > 0, row["target"] / row["own_size"]).otherwise(F.lit(0.0))
    times = F.least(rate * row["own"], F.lit(float(MOST)))
    sure = F.floor(times).cast("long")
    p, usual = times - sure, rate - F.floor(rate)
    u = F.conv(F.substring(row["digest"], 1, 13), 16, 10).cast("double") / float(1 << 52)
    length = F.sqrt(F.sqrt(row["size"].cast("double") * row["n"] / row["source_size"]))
    rank = (u / (1 - u)) / ((p / (1 - p)) * length)
    base = F.when(usual > 0, (1 - usual) / usual).otherwise(F.lit(1.0))
    return sure, F.when((p > 0) & (row["size"] > 0) & (u < 1), rank / (rank + base))


def _copies(row: dict[str, Column]) -> Column:
    sure, place = _expected(row)
    first = (place < row["cut"]) | ((place == row["cut"]) & (row["digest"] <= row["cut_digest"]))
    return sure + F.when(F.coalesce(first, F.lit(False)), 1).otherwise(0).cast("long")


def _plan(rows: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """For each source (skey) n, source_size, own_size, target, and the place and digest of the last document that is sampled."""
    sources = rows.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("own")).alias("own_size"), F.count(F.lit(1)).alias("n"))
    sources = targets(sources, cycle).drop("source")
    full = attach(rows, sources, ["skey"], "n")
    sure, place = _expected({c: F.col(c) for c in full.columns})
    ranked = stored(full.select("skey", "size", "digest", sure.alias("sure"), place.alias("place")), "mix-ranked")
    surely = ranked.groupBy("skey").agg(F.sum(F.col("sure") * F.col("size")).alias("sure_words"), F.count("place").alias("open")).withColumnRenamed("skey", "k")
    needs = sources.join(surely, F.col("skey") == F.col("k")).select("skey", (F.col("target") - F.col("sure_words")).alias("rest"), "open")
    range_ = attach(ranked.where("place IS NOT NULL").select("skey", "size", "place", "digest"), needs, ["skey"], "open").drop("open")
    range_ = range_.withColumn("whole", F.least(F.floor(F.col("place") * (1 << RANK_BITS)).cast("long"), F.lit((1 << RANK_BITS) - 1)))
    used = []
    for shift in range(RANK_BITS - FINE_BITS, -1, -FINE_BITS):
        bin_ = F.shiftrightunsigned("whole", shift)
        sums = range_.groupBy("skey", bin_.alias("bin")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.count(F.lit(1)).alias("many"))
        run = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("skey").orderBy("bin")))
        here = F.struct("bin", (F.col("upto") - F.col("words")).alias("before"), "many")
        met = run.groupBy("skey").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("rest"), here)), F.max(here)).alias("c"), F.sum("many").alias("n"))
        cuts = stored(met.select("skey", "c.bin", "c.before", "c.many", "n"), "mix-cuts")
        range_ = attach(range_, cuts, ["skey"], "n").where(F.col("bin") == bin_).withColumn("rest", F.col("rest") - F.col("before")).drop("bin", "before", "n", "many")
        range_ = stored(range_, "mix-range")
        used += [cuts, range_]
        if (cuts.agg(F.max("many")).first()[0] or 0) <= SMALL:
            break
    least = range_.groupBy("skey", "place", "digest").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    order = Window.partitionBy("skey").orderBy("place", "digest").rowsBetween(Window.unboundedPreceding, 0)
    taken = 2 * F.sum("words").over(order) - F.col("words") < 2 * F.col("rest")
    last = F.max(F.when(F.col("taken"), F.struct("place", "digest")))
    none = F.struct(F.min("place").alias("place"), F.lit(None).cast("string").alias("digest"))
    ends = least.withColumn("taken", taken).groupBy("skey").agg(F.coalesce(last, none).alias("last")).select(F.col("skey").alias("k"), F.col("last.place").alias("cut"), F.col("last.digest").alias("cut_digest"))
    plan = stored(sources.join(ends, F.col("skey") == F.col("k"), "left").drop("k"), "mix-plan")
    discard(rows.sparkSession, ranked, *used)
    return plan


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, cycle: tuple[float, ...] = (1.0, 2.0, 3.0), seed: str = SEED) -> DataFrame:
    """id, source, size, source_size, target, copies (long, how often the mix takes the document) and taken (words), for every row.

    weight_col: a weight of each document within its source.
    """
    seen = _seen(docs, id_col, text_col, source_col, weight_col, seed)
    rows = stored(docs.select(docs[id_col].alias("id"), *[c.alias(name) for name, c in seen.items()]), "mix-rows")
    full = attach(rows, _plan(rows, cycle), ["skey"], "n")
    full = full.withColumn("copies", _copies({c: F.col(c) for c in full.columns}))
    return full.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def replicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, cycle: tuple[float, ...] = (1.0, 2.0, 3.0), seed: str = SEED) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken.

    Rows meet the plan by their source. Up to HEAVY_ROWS sources are broadcast and no text
    travels; more of them are joined as everywhere.
    """
    seen = _seen(docs, id_col, text_col, source_col, weight_col, seed)
    rows = stored(docs.select(*[c.alias(name) for name, c in seen.items()]), "mix-rows")
    plan = _plan(rows, cycle)
    discard(docs.sparkSession, rows)
    names = {name: free_name(docs, f"mix_{name}") for name in (*seen, *plan.columns)}
    wide = docs.select(*every(docs), *[c.alias(names[name]) for name, c in seen.items() if name != "source"])
    plan = plan.select(*[F.col(c).alias(names[c]) for c in plan.columns])
    key = names["skey"]
    if plan.count() <= HEAVY_ROWS:
        full = wide.join(F.broadcast(plan), key)
    else:
        full = attach(wide, plan, [key], names["n"])
    n = free_name(docs, "mix_copies")
    copies = _copies({name: F.col(c) for name, c in names.items()})
    times = full.select(*every(docs), copies.alias(n))
    # outer, and filtered by what it makes: a filter on the copies would count each text's words once more
    each, nth = F.when(F.col(n) > 0, F.sequence(F.lit(1).cast("long"), F.col(n))), free_name(docs, "mix_nth")
    return times.select(*every(docs), F.explode_outer(each).alias(nth)).where(F.col(nth).isNotNull()).select(*every(docs))
