"""The pipeline against its stages done by hand."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from quillseek.llm import mixing
from quillseek.llm.queries import op1_toxicity

from .conftest import ascii_lower
from .test_dedup import brute_components, fingerprint


def test_pipeline_against_brute_force(spark, data, raw):
    texts = {r[0]: r[1] for r in raw}
    rejected = {r.doc_id for r in op1_toxicity(spark, data).where("rejected").collect()}
    left = {i: t for i, t in texts.items() if i not in rejected}
    last = {ascii_lower(t): i for i, t in sorted(left.items())}
    left = {i: texts[i] for i in last.values()}
    near = brute_components({i: fingerprint(t) for i, t in left.items()})
    left = [i for i in left if near[i] == i]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = docs.join(spark.createDataFrame([(i,) for i in left], "doc_id bigint"), "doc_id")
    want = Counter({r.doc_id: r.copies for r in mixing.mix(kept).where("copies > 0").collect()})
    out = corpus_pipeline.run(spark, data).select("doc_id", "n_tokens", "round_trip").collect()
    assert Counter(r.doc_id for r in out) == want and all(r.round_trip for r in out)


def test_stages_keep_the_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("more", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, data).columns == corpus_pipeline.COLUMNS


def test_stages_of_odd_rows(spark, data, odd, empty):
    """What each stage keeps of nulls, empty and long texts, ties and repeated rows: by hand."""
    wide = lambda d: d.withColumn("n_chars", F.length("text").cast("long"))
    rows = Counter((r.doc_id, r.text) for r in odd.collect())
    stage = {name: f for name, f in corpus_pipeline.STAGES}
    kept = {name: Counter((r.doc_id, r.text) for r in f(spark, wide(odd), data).collect()) for name, f in corpus_pipeline.STAGES[:4]}
    assert kept["toxicity"] == rows
    # of equal texts the largest id, of repeated rows one
    best = {}
    for i, t in rows:
        key = ascii_lower(t)
        best[key] = max(best.get(key, (-2, None)), (-1 if i is None else i, t), key=lambda x: x[0])
    assert kept["exact dedup"] == Counter((None if i < 0 else i, t) for i, t in best.values())
    # near copies: ids whose component has a smaller one go, null ids stay
    near = brute_components({k: fingerprint(t) for k, (i, t) in enumerate(rows.elements())})
    every = [*rows.elements()]
    least = {}
    for k, (i, _) in enumerate(every):
        if i is not None:
            least[near[k]] = min(least.get(near[k], i), i)
    assert kept["simhash near-dedup"] == Counter(r for k, r in enumerate(every) if r[0] is None or least[near[k]] == r[0])
    plan = mixing.mix(wide(odd)).collect()
    assert sum(kept["mixing to target weights"].values()) == sum(r.copies for r in plan) and set(kept["mixing to target weights"]) <= set(rows)
    coded = stage["bpe encoding"](spark, wide(odd), data).collect()
    assert Counter(r.doc_id for r in coded) == Counter(i for i, _ in rows.elements()) and all(r.round_trip for r in coded)
    assert {r.n_tokens for r in coded if r.doc_id in (3, 4)} == {0}
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, wide(empty), data).count() == 0
