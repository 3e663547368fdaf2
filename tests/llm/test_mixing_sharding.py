"""Mixing and sharding against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillseek.llm import mixing, sharding
from quillseek.llm.oracles import llm_oracles
from quillseek.llm.queries import llm_queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / share for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 40}, {"z": 7}, {"a": 0, "b": 5}, {"é": 100, "z": 1, "Z": 1, "y": 1}])
def test_targets(spark, sizes):
    rows = [(i, s, " ".join(["w"] * n)) for i, (s, n) in enumerate(sizes.items())]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id int, source string, text string")).collect()
    want = brute_targets(sizes)
    for r in out:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and r.taken <= 3 * r.size


def test_mix_is_near_its_targets_and_repeatable(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", " ".join(["w"] * rng.randint(0, 40))) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string")
    first, again = (sorted(map(tuple, mixing.mix(d).collect())) for d in (docs, docs.repartition(7)))
    assert first == again
    taken, target = Counter(), {}
    for _, source, size, _, t, copies, words in first:
        taken[source] += words
        target[source] = t
        assert words == copies * size and copies <= 3
    assert all(abs(taken[s] - t) <= 40 for s, t in target.items())


def test_unequal_weights_and_replicas(spark):
    rows = [(i, "a" if i < 1000 else "b", "w w w w", 3.0 if i % 2 else 1.0) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string, weight double")
    out = mixing.mix(docs, weight_col="weight").join(docs.select("doc_id", "weight"), "doc_id")
    by = {(r.source, r.weight): r.c for r in out.groupBy("source", "weight").agg(F.avg("copies").alias("c")).collect()}
    assert by["a", 3.0] > 2 * by["a", 1.0] and by["b", 3.0] > 2 * by["b", 1.0]
    assert by["a", 3.0] + by["a", 1.0] == pytest.approx(2 * 2 / 3, abs=0.05)
    copies = mixing.replicate(docs)
    assert copies.columns == docs.columns and copies.count() == out.count() and mixing.mix(docs).agg(F.sum("copies")).first()[0] == copies.count()


def test_mix_odd_rows(odd, empty):
    out = mixing.mix(odd)
    assert out.count() == odd.count() and mixing.mix(empty).count() == 0
    assert {r.size for r in out.where("doc_id IN (3, 4, 5)").collect()} == {0}


def test_replicas_of_null_and_repeated_ids(spark):
    ids = [None, 7, *range(100, 130)]
    rows = [(ids[i % 2] if i < 40 else ids[i - 38], "ab"[i % 5 == 0], " ".join(["w"] * (i + 1))) for i in range(70)]
    rows += [(None, "z", "the only one"), (7, "z", "another one"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string").repartition(5)
    key = lambda r, size: (r.doc_id, r.source, size)
    want = {key(r, r.size): r.copies for r in mixing.mix(docs).collect() if r.copies}
    got = Counter(key(r, len(WORD.findall(r.text))) for r in mixing.replicate(docs).collect())
    assert {k for k in want if k[0] is None} and {k for k in want if k[0] == 7} and max(want.values()) > 1
    assert got == Counter(want) and max(got.values()) <= 3


def as_sql(rows):
    """(doc_id, source, copies, taken) of each row as the SQL of the query has them."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["doc_id", "source", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    con.sql("CREATE TABLE documents AS SELECT doc_id, source, text FROM frame")
    return sorted(map(str, con.sql(f"SELECT doc_id, size, target, copies, taken FROM ({llm_oracles()['op2_mixing']})").fetchall()))


def mixed(docs, **more):
    return sorted(map(str, (tuple(r) for r in mixing.mix(docs, **more).select("doc_id", "size", "target", "copies", "taken").collect())))


@pytest.mark.parametrize("small", [1, 40, 20_000])
def test_ranges_are_narrowed_and_capped_sources_go_whole(spark, monkeypatch, small):
    """A hot source, sources at their cap (rate 3, nothing to sample), equal rows, null and repeated ids."""
    monkeypatch.setattr(mixing, "SMALL", small)
    rng = random.Random(8)
    rows = [(i, "hot", " ".join(["w"] * int(rng.paretovariate(0.9)))) for i in range(3000)]
    rows += [(5000 + i % 90, f"tiny{i % 3}", "few words here") for i in range(300)] + [(None, "nulls", f"w w {i % 20}") for i in range(200)]
    rows += [(9000 + i, "zz", None if i % 2 else "") for i in range(10)] + [(None, None, "left over")]
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string").repartition(6)
    assert mixed(docs) == as_sql(rows)
    out = mixing.mix(docs).collect()
    assert all(r.copies == 3 for r in out if (r.source or "").startswith("tiny"))
    taken, target, largest = Counter(), {}, Counter()
    for r in out:
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert r.copies <= 3
    assert all(abs(taken[s] - t) <= largest[s] * (10 if s == "nulls" else 1) for s, t in target.items())
    got = Counter((r.doc_id, r.source, r.text) for r in mixing.replicate(docs).collect())
    size = {(r.doc_id, r.source, r.size): r.copies for r in out if r.source == "hot"}
    assert sum(got.values()) == sum(r.copies for r in out)
    assert all(n == size[i, s, len(WORD.findall(t))] for (i, s, t), n in got.items() if s == "hot")


def test_longer_texts_are_likelier(spark):
    rows = [(i, "ab"[i % 2], " ".join(["w"] * (400 if i % 4 < 2 else 4))) for i in range(4000)]
    by = Counter()
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id int, source string, text string")).collect():
        by[r.source, r.size] += r.copies
    # source a is to take 2/3 of its words: odds of long texts are (400 / 4) ** 0.25 times those of short ones
    long, short = by["a", 400] / 1000, by["a", 4] / 1000
    assert long / (1 - long) / (short / (1 - short)) == pytest.approx(100**0.25, rel=0.25)


def test_many_sources_are_joined_as_few(spark, monkeypatch):
    rows = [(i, None if i % 41 == 0 else f"s{i % 41}", " ".join(["w"] * (i % 13))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string")
    few = sorted(map(str, mixing.replicate(docs).collect()))
    monkeypatch.setattr(mixing, "HEAVY_ROWS", 5)
    assert sorted(map(str, mixing.replicate(docs).collect())) == few and mixed(docs) == as_sql(rows)


def test_no_task_sees_all_sources_or_rows(spark, data, capsys):
    mixing.mix(spark.read.parquet(f"{data}/documents.parquet")).explain()
    assert "Exchange SinglePartition" not in capsys.readouterr().out


def test_mix_with_clashing_columns(spark):
    names = ["doc_id", "source", "text", "mix_skey", "mix_size", "copies", "n", "target", "a.b"]
    docs = spark.createDataFrame([(i, "a", "some words", *[i] * 6) for i in range(9)], ", ".join(f"`{n}` {'string' if n in ('source', 'text') else 'int'}" for n in names))
    out = mixing.replicate(docs)
    assert out.columns == names and out.count() == 9 and mixing.mix(docs).count() == 9


def test_many_rows_of_one_id(spark):
    rows = [(1, "a", f"w w {i}") for i in range(300)] + [(i, "b", "w w w") for i in range(2, 302)]
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string")
    got = Counter(r.text for r in mixing.replicate(docs).where("source = 'a'").collect())
    assert sum(got.values()) == mixing.mix(docs).where("source = 'a'").agg(F.sum("copies")).first()[0] and max(got.values()) <= 3


def test_registered_queries_as_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    queries = llm_queries()
    for name, sql in llm_oracles().items():
        df = queries[name](spark, data)
        names = sorted(df.columns)
        got = sorted(map(str, ([r[c] for c in names] for r in df.collect())))
        assert got == sorted(map(str, map(list, con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()))), name


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=8), st.integers(1, 5))
def test_smallest_capacity(sizes, shards):
    capacity, cuts = sharding.minimax_cuts(sizes, shards)
    bounds = [0, *cuts]
    parts = [sum(sizes[a:b]) for a, b in itertools.pairwise(bounds)]
    best = min((max(sum(sizes[a:b]) for a, b in itertools.pairwise((0, *c, len(sizes)))) for c in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1)), default=0)
    assert cuts[-1] == len(sizes) and len(cuts) == shards and bounds == sorted(bounds)
    assert not sizes or max(parts) == best <= capacity


def check_shards(rows, texts, shards):
    slots = defaultdict(list)
    where = defaultdict(set)
    for (_, text), r in zip(sorted(texts, key=str), sorted(rows, key=lambda r: str((r.doc_id, r.text))), strict=True):
        raw = (text or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        where[text or ""].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(w) == 1 for w in where.values())


def test_shards_of_the_table(spark, data, raw):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = sharding.shard(docs, 10).join(docs.select("doc_id", "text"), "doc_id").collect()
    check_shards(rows, [(r[0], r[1]) for r in raw], 10)
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert max(sizes.values()) < 1.1 * sum(sizes.values()) / 10


def test_the_registered_shards(spark, data, raw):
    """40 shards as the query makes them: the law of near equal sizes, whole groups, slots without gaps."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = llm_queries()["op7_sharding"](spark, data)
    assert {f.name: f.dataType.simpleString() for f in out.schema} == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    rows = out.join(docs.select("doc_id", "text"), "doc_id").collect()
    check_shards(rows, [(r[0], r[1]) for r in raw], 40)
    assert len(rows) == len(raw) and {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    sizes, groups = Counter(), Counter()
    for r in rows:
        sizes[r.shard] += r.size
        groups[r.text or ""] += r.size
    # no contiguous partition of whole groups can do better than its mean and its largest group
    assert set(sizes) == set(range(40)) and max(sizes.values()) <= sum(sizes.values()) / 40 + max(groups.values())


def test_shards_of_odd_rows_and_hot_groups(spark, odd, empty):
    assert sharding.shard(odd, 3).count() == odd.count() and sharding.shard(empty, 3).count() == 0
    hot = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i}") for i in range(3000)], "doc_id int, text string")
    rows = sharding.shard(hot, 8).join(hot, "doc_id").collect()
    check_shards(rows, [(r.doc_id, r.text) for r in rows], 8)
