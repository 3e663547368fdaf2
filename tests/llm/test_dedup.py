"""Exact, near and line dedup against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillseek.llm import bloom, exactdedup, linededup, simhash
from quillseek.llm.bloom import Bloom
from quillseek.llm.common import attach, clean, scratch_dir, stored
from quillseek.llm.components import connected_components
from quillseek.llm.queries import op3_simhash, op4_line_dedup, op9_exact_dedup

from .conftest import ascii_lower

SPACE = " \t\n\x0b\x0c\r"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def exact_groups(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[ascii_lower(t)].append(i)
    return groups


def test_exact_report_against_brute_force(spark, data, raw):
    got = {r.doc_id: r for r in op9_exact_dedup(spark, data).collect()}
    assert len(got) == len(raw)
    for text, ids in exact_groups((r[0], r[1]) for r in raw).items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(ids), len(ids), i == max(ids), sha(text))


def test_exact_odd_rows(odd, empty):
    rows = exactdedup.dedup_report(odd).collect()
    assert len(rows) == odd.count() and sum(r.kept for r in rows) == 7
    same = [r for r in rows if r.doc_id in (1, 2)]
    assert [r.keep_id for r in same] == [2, 2, 2] and sum(r.kept for r in same) == 1 and {r.group_size for r in same} == {3}
    assert {r.doc_id: r.keep_id for r in rows if r.group_size == 3 and r.keep_id == 4} == {3: 4, 4: 4, None: 4}
    kept = exactdedup.exact_dedup(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["2", "4", "5", "6", "7", "8", "None"])
    assert exactdedup.dedup_report(empty).count() == 0 and exactdedup.exact_dedup(empty).count() == 0


def test_filter_never_misses_a_repeat(spark):
    rows = spark.range(5000).select((F.col("id") % 4000).alias("k"), F.xxhash64(F.col("id") % 4000).alias("h"))
    for most in (1, 7):
        marked = Bloom(rows, "h", 2, most).mark(rows, "h", "maybe")
        found = {r.k: r.maybe for r in marked.collect()}
        assert all(found[k] for k in range(1000))
        assert sum(found[k] for k in range(1000, 4000)) < (1500 if most == 1 else 100)
        others = spark.range(10_000, 20_000).select(F.when(F.col("id") > 10_000, F.xxhash64("id")).alias("h"))
        assert Bloom(rows, "h", 1, most).mark(rows, "h", "maybe").where("NOT maybe").count() == 0
        assert Bloom(rows, "h", 1, most).mark(others, "h", "maybe").where("maybe").count() < (4000 if most == 1 else 400)
    assert bloom.blocks_for(10**12) == bloom.MAX_BLOCKS and bloom.blocks_for(0) == 1


def test_a_full_filter_keeps_results_right(spark, monkeypatch):
    monkeypatch.setattr(bloom, "BITS", 0)  # one block for 60,000 rows: most cells are met
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 50_000).cast("string")).alias("text"))
    report = exactdedup.dedup_report(docs).groupBy("group_size", "kept").count().collect()
    assert {(r.group_size, r.kept): r["count"] for r in report} == {(1, True): 40_000, (2, True): 10_000, (2, False): 10_000}
    kept = exactdedup.exact_dedup(docs)
    assert kept.count() == 50_000 and kept.where("doc_id < 10000").count() == 0


def test_exact_with_clashing_columns_and_ties(spark):
    names = ["doc_id", "text", "__block", "__b", "__id", "exact_hash", "exact_maybe", "bloom0", "rid", "h", "sha", "raw", "a.b", "m"]
    rows = [(i % 7, ["Same", "same", "SAME", None, "other"][i % 5], *[i % 2] * 11, {"k": i % 2}) for i in range(60)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'string' if n == 'text' else 'map<string, int>' if n == 'm' else 'int'}" for n in names))
    kept = exactdedup.exact_dedup(docs)
    assert kept.columns == names
    one, two = (sorted(map(str, exactdedup.exact_dedup(d).drop("m").collect())) for d in (docs, docs.repartition(5)))
    assert one == two and len(one) == 3 and all("doc_id=6" in r for r in one)
    report = exactdedup.dedup_report(docs).collect()
    assert len(report) == 60 and sum(r.kept for r in report) == 3 and {r.keep_id for r in report} == {6}


def test_attach_with_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr("quillseek.llm.common.HEAVY_ROWS", 2)
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(999, None)], "i int, k string")
    groups = rows.groupBy("k").agg(F.count("*").alias("n")).where("k IS NOT NULL")
    got = {r.i: r.n for r in attach(rows, groups, ["k"], "n").collect()}
    assert len(got) == 301 and got[1] == 200 and got[3] == 1 and got[999] is None
    more = {n: F.lit(5) for n in ("__heavy", "__spread", "__light", "__zero", "__h_k", "__l_k", "a.b")}
    wide = attach(rows.withColumns(more), groups, ["k"], "n").collect()
    assert {r.i: r.n for r in wide} == got and {r["__spread"] for r in wide} == {5}


def fingerprint(text):
    words = [w for w in ascii_lower(text).encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def brute_components(fps):
    """Smallest reachable id for each id, over all pairs."""
    ids, u = list(fps), np.array(list(fps.values()), np.uint64)
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(*np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 3), strict=True):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    members = defaultdict(list)
    for k, i in enumerate(ids):
        members[find(k)].append(i)
    return {i: min(m) for m in members.values() for i in m}


def test_near_dups_against_brute_force(spark, data, raw):
    want = {r[0]: fingerprint(r[1]) for r in raw[::9]}
    got = {r.doc_id: r for r in op3_simhash(spark, data).collect()}
    assert all(got[i].fingerprint == f"{f:016x}" for i, f in want.items()) and len(got) == len(raw)
    every = brute_components({i: int(r.fingerprint, 16) for i, r in got.items()})
    assert {i: r.component_id for i, r in got.items()} == every


def test_planted_fingerprints(spark):
    """Dense balls around a few points, distances 0 to 6 in all parities, halves and both."""
    rng = np.random.default_rng(3)
    fps, i = {}, 0
    for _ in range(6):
        centre = int(rng.integers(0, 1 << 63))
        for flips in [0, 0, 1, 1, 2, 2, 3, 3, 3, 4, 5, 6] * 4:
            x = centre
            for b in rng.choice(64, flips, replace=False):
                x ^= 1 << int(b)
            fps[i] = x
            i += 1
    for _ in range(200):
        fps[i] = int(rng.integers(0, 1 << 63)) * 2 + 1
        i += 1
    rows = spark.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for k, v in fps.items()], "id bigint, fp bigint")
    got = {r.id: r.component_id for r in simhash.near_components(rows).collect()}
    assert got == brute_components(fps)


@pytest.mark.parametrize("common", [1, 20, 1000])
def test_common_halves_are_split(spark, monkeypatch, common):
    """Many fingerprints with one half in common, some linked over the other half or over both."""
    monkeypatch.setattr(simhash, "COMMON", common)
    rng = np.random.default_rng(9)
    fps = [(0xABCD1234 << 32) + int(x) for x in rng.integers(0, 1 << 32, 150)] + [(int(x) << 32) + 0x5555AAAA for x in rng.integers(0, 1 << 31, 150)]
    for x in fps[::4]:
        for flips in (1, 2, 3, 4):
            y = x
            for b in rng.choice(64, flips, replace=False):
                y ^= 1 << int(b)
            fps.append(y)
    rows = {i: x for i, x in enumerate(fps)}
    got = simhash.near_components(spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in rows.items()], "id bigint, fp bigint")).collect()
    assert {r.id: r.component_id for r in got} == brute_components(rows)


def test_near_rows_go_by_id_and_text(spark):
    rows = [(5, "one two three four five"), (2, "ONE two three four five"), (2, "something else entirely, only here"), (None, "one two three four five"), (9, None), (9, None), (7, "")]
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id int, text string").withColumns({"near_id": F.lit(1), "near_both": F.lit(2), "a.b": F.lit(3)}))
    assert kept.columns == ["doc_id", "text", "near_id", "near_both", "a.b"]
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("2", "ONE two three four five"), ("2", "something else entirely, only here"), ("None", "one two three four five"), ("7", "")])


def test_near_odd_rows(odd, empty):
    got = simhash.near_dups(odd.where("doc_id IS NOT NULL")).collect()
    by = {r.id: r for r in got}
    assert len(got) == 9 and {by[3].fp, by[4].fp, by[5].fp} == {0} and by[5].component_id == 3 and by[2].component_id == 1
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns and kept.where("doc_id IN (2, 4, 5)").count() == 0 and kept.where("doc_id IS NULL").count() == 2
    assert simhash.near_dups(empty).count() == 0 and simhash.near_dedup(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (7, 7), (500, 400), (500, 400), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 300: 100, 400: 400, 500: 400}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_components_around_hubs(spark, monkeypatch):
    """A hub larger than its neighbours, one smaller than all, a chain between them; only one node counts as heavy."""
    monkeypatch.setattr("quillseek.llm.common.HEAVY_ROWS", 1)
    edges = [(9000, i) for i in range(10, 400)] + [(1, i) for i in range(1000, 1300)] + [(9000, 5000), (5000, 1299)] + [(7001, 7002), (7002, 7003)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    big = {x for e in edges[:-2] for x in e}
    assert got == {**dict.fromkeys(big, 1), 7001: 7001, 7002: 7001, 7003: 7001}


def brute_lines(pairs, least_docs=3):
    key = lambda line: ascii_lower(line.strip(SPACE))
    where = defaultdict(set)
    for i, t in pairs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                where[key(line)].add(i)
    last = {k: max(v) for k, v in where.items() if len(v) >= least_docs}
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or key(x) not in last or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def test_lines_against_brute_force(spark, data, raw):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in op4_line_dedup(spark, data).collect()}
    want = {i: (n, d, sha(t)) for i, n, d, t in brute_lines([(r[0], r[1]) for r in raw])}
    assert got == want and sum(d for _, d, _ in want.values()) > 100


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (2, 2), (5, 2), (7, 3)])
def test_lines_for_any_batches(spark, odd, batches, fanout):
    got = linededup.dedup_lines(odd, batches=batches, fanout=fanout)
    assert got.columns == [*odd.columns, "n_lines", "n_dropped", "kept"]
    rows = [(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()]
    want = brute_lines([(r.doc_id, r.text) for r in odd.collect()])
    assert sorted(rows, key=str) == sorted(want, key=str) and sum(d for _, _, d, _ in want) == 3


def test_lines_of_nothing_and_clashes(odd, empty):
    assert linededup.dedup_lines(empty).count() == 0
    assert linededup.dedup_lines(odd.withColumn("Kept", F.lit(1))).columns == [*odd.columns, "n_lines", "n_dropped", "kept"]
    more = {n: F.lit(1) for n in ("__drops", "__id", "line_id", "line_text", "line_maybe", "bloom0", "drops", "id", "h1", "n", "__heavy", "__spread", "a.b")}
    wide = linededup.dedup_lines(odd.withColumns(more))
    assert wide.columns == [*odd.columns, *more, "n_lines", "n_dropped", "kept"]
    plain = linededup.dedup_lines(odd)
    assert sorted(map(str, wide.drop(*more).collect())) == sorted(map(str, plain.collect()))


def test_a_text_of_many_lines_that_go(spark):
    """Lines of one text are told apart by their numbers: 60,000 lines, half of which go, take no time that grows with the square."""
    one = "\n".join(f"a line that is long enough, number {i // 2 * 2}" if i % 2 else f"own line number {i} of this long text" for i in range(60_000))
    docs = spark.createDataFrame([(1, one), (2, one), (3, one), (None, one)], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in linededup.dedup_lines(docs).collect()}
    want = {i: (n, d, t) for i, n, d, t in brute_lines([(1, one), (2, one), (3, one), (None, one)])}
    assert got == want and got[1][1] == 60_000 and got[3][1] == 0


def test_clean_removes_this_applications_tables(spark):
    import os

    stored(spark.range(3).toDF("x"), "some")
    assert os.listdir(scratch_dir(spark).removeprefix("file://"))
    clean(spark)
    assert not os.path.exists(scratch_dir(spark).removeprefix("file://"))
    assert stored(spark.range(3).toDF("x"), "some").count() == 3


def test_nothing_is_left_behind(spark, odd, monkeypatch):
    """Runs and tables of lines go, also after a failure."""
    import os

    def tables():
        found = {t.name for t in spark.catalog.listTables()}
        shared = scratch_dir(spark).removeprefix("file://")
        return {t for t in found if t.startswith("line_run")}, {f for f in os.listdir(shared) if f.startswith(("line-run", "line-hashes", "line-again", "line-frequent", "line-batch"))}

    linededup.dedup_lines(odd).collect()
    assert tables() == (set(), set())
    monkeypatch.setattr(linededup.LineRuns, "frequent", lambda self, n: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        linededup.dedup_lines(odd)
    assert tables() == (set(), set())


def test_runs_hold_each_hash_once(spark):
    runs = linededup.LineRuns(spark, fanout=2, buckets=2)
    for at in range(5):
        runs.add(spark.range(at * 10, at * 10 + 30).select(F.xxhash64("id").alias("h1"), F.hash("id").alias("h2"), F.lit(1).cast("long").alias("n"), F.lit(at).cast("long").alias("last")))
    hashes = [r.h1 for run in runs.runs() for r in run.collect()]
    assert len(hashes) == len(set(hashes)) == 70 and any(level for level in runs.levels[1:])
    assert {r.n for r in runs.frequent(3).collect()} == {3} and runs.frequent(3).count() == 30
    runs.drop()
