"""Fitted models: held-out accuracy, plain loops over the fitted tables, and odd rows."""

import itertools
import math
import os
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillseek.llm import langid, quality, toxicity
from quillseek.llm.ordinal import fit_cumulative_link, labelled_sample, telling
from quillseek.llm.queries import op1_toxicity, op5_language_id, op10_quality
from quillseek.llm.textfeat import BASE, features, slices


def test_cumulative_link_recovers_an_order():
    rng = np.random.default_rng(1)
    n, weights = 1500, np.array([1.5, -1.0, 0.0])
    x = rng.random((n, 3)) < 0.5
    score = x @ weights + rng.logistic(size=n)
    grades = np.digitize(score, [-0.5, 1.0])
    rows, cols = np.nonzero(x)
    w, theta = fit_cumulative_link(rows, cols, grades, np.ones(n), 3, 3)
    assert np.allclose(w, weights, atol=0.35) and np.allclose(theta, [-0.5, 1.0], atol=0.35) and theta[0] < theta[1]


def test_features_are_of_whole_texts():
    d, h = features(["Idiot, idiotic words", None, "", "idiot"], beginnings=False)
    assert set(h[d == 3].tolist()) <= set(h[d == 0].tolist()) and not (d == 1).any() and not (d == 2).any()
    long = "word " * 700_000 + "needle"
    d, h = features([long, "needle word"], beginnings=False)
    assert sorted(h[d == 0].tolist()) == sorted(h[d == 1].tolist())
    assert b"".join(p for _, ps in slices([long.encode()]) for p in ps) == long.encode()
    wanted = np.sort(features(["needle"], beginnings=False)[1])
    assert len(features([long], beginnings=False, wanted=wanted)[1]) == 1


def test_long_marks_are_features():
    def marks(run):
        d, h = features([f"one{run}two three", "one two three"], False, True)
        return set(h[d == 0]) - set(h[d == 1])

    runs = ["-" * 16, "-" * 17, "-" * 40, "-" * 5000, "#" * 20, " #### \n" * 9]
    assert all(len(marks(r)) == 1 for r in runs) and len(set.union(*map(marks, runs))) == len(runs)
    assert marks("-" * 17) == marks("-" * 31) and marks("-" * 17) != marks("-" * 32)


def test_telling_features():
    rows, hashes = np.array([0, 1, 2, 0, 1, 2, 3, 4, 5]), np.array([7, 7, 7, 9, 9, 9, 9, 9, 9], np.uint64)
    kept, a, b = telling(rows, hashes, np.array([True] * 3 + [False] * 3), 2.0)
    assert kept.tolist() == [7] and a.tolist() == [3] and b.tolist() == [0]


def labelled(spark, n=600):
    """Synthetic rows: insults make toxic ones; marks make bad ones."""
    rng = np.random.default_rng(5)
    plain = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = list(rng.choice(plain, 60))
        toxic, bad = int(i % 5 == 0), int(i % 7 == 0)
        if toxic:
            for _ in range(1 + i % 4):
                words[int(rng.integers(60))] = str(rng.choice(["vilest", "vilely"]))
        text = " !!! ".join(words) if bad else " ".join(words)
        docs.append((i, text))
        labels.append((i, 1 - bad, toxic))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark, odd, empty):
    docs, labels = labelled(spark)
    model = toxicity.fit_flags(docs, labels.where("doc_id % 3 <> 0"))
    out = toxicity.score_toxicity(docs.where("doc_id % 3 = 0"), model).join(labels, "doc_id").collect()
    assert all(r.rejected == (r.toxic == 1) for r in out)
    assert all(0 <= r.p_severe <= r.p_toxic <= 1 and 0 <= r.severity <= 2 for r in out)
    unseen = toxicity.score_toxicity(spark.createDataFrame([(1, "one vilest" + " fine" * 5000), (2, "vile vill")], "doc_id bigint, text string"), model).orderBy("doc_id").collect()
    assert unseen[0].rejected
    assert toxicity.score_toxicity(odd, model).columns == [*odd.columns, "severity", "p_toxic", "p_severe", "rejected"]
    assert toxicity.score_toxicity(odd, model).where("rejected").count() == 0 and toxicity.score_toxicity(empty, model).count() == 0
    clash = toxicity.score_toxicity(docs.withColumns({"Severity": F.lit("x"), "rejected": F.lit("x")}), model)
    assert clash.columns == ["doc_id", "text", "severity", "p_toxic", "p_severe", "rejected"] and clash.count() == docs.count()
    with pytest.raises(ValueError):
        toxicity.score_toxicity(docs.withColumnRenamed("text", "severity"), model, "severity")


def test_grades_of_severity_on_held_out_rows(spark):
    """Labels with four grades: expected severity follows them on rows that did not teach."""
    rng = np.random.default_rng(6)
    plain, bad = [f"w{i}" for i in range(200)], ["rude", "vile", "vicious"]
    rows = []
    for i in range(1200):
        words, grade = list(rng.choice(plain, 40)), i % 4
        for g in range(grade):
            words[g * 7] = bad[g]
        rows.append((i, " ".join(words), grade))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, severity int")
    model = toxicity.fit_toxicity(docs, labels.where("doc_id % 5 <> 0"), grades=4)
    out = toxicity.score_toxicity(docs.where("doc_id % 5 = 0"), model).join(labels.withColumnRenamed("severity", "grade"), "doc_id").collect()
    by = [np.mean([r.severity for r in out if r.grade == g]) for g in range(4)]
    assert all(abs(m - g) < 0.4 for g, m in enumerate(by)) and np.all(np.diff(model.thresholds) > 0)


@pytest.mark.parametrize("base", [0.0, 0.01, 0.3, 0.5, 0.8, 0.99])
def test_threshold_is_in_reach(base):
    assert max(base, toxicity.REJECT) <= toxicity.threshold(base) < 1


def test_toxic_heavy_labels(spark):
    rows = [(i, f"plain words number {i % 9} of many" + (" vile wretch" if i % 10 < 3 else " kind friend" if i % 10 == 3 else ""), int(i % 10 != 3)) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(docs, labels, grade_col="toxic", grades=2)
    base = float(model.tails(np.zeros(1))[0, 0])
    out = toxicity.score_toxicity(docs.where("doc_id < 40"), model).collect()
    assert base > 0.5 and not any(r.rejected for r in out if "kind" in r.text)
    assert all(r.rejected for r in out if "vile" in r.text)


def test_models_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for labels in (none, nulls):
        assert toxicity.score_toxicity(odd, toxicity.fit_flags(odd, labels)).where("rejected").count() == 0
        ratings = labels.select("doc_id", quality.rating(F.col("quality"), F.col("toxic")).alias("grade"))
        assert quality.score_quality(odd, quality.fit_quality(odd, ratings)).count() == odd.count()


def test_quality_on_held_out_rows(spark, odd, empty):
    docs, labels = labelled(spark)
    ratings = labels.select("doc_id", quality.rating(F.col("quality"), F.col("toxic")).alias("grade"))
    model = quality.fit_quality(docs, ratings.where("doc_id % 3 <> 0"))
    out = quality.score_quality(docs.where("doc_id % 3 = 0"), model).join(labels, "doc_id").collect()
    assert all(r.selected == (r.quality == 1) for r in out)
    assert np.mean([r.expected_grade for r in out if r.quality]) > 1 > np.mean([r.expected_grade for r in out if not r.quality])
    assert quality.score_quality(odd, model).count() == odd.count() and quality.score_quality(empty, model).count() == 0


BIG = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(BIG), reason="no test tables")
def test_registered_models_on_held_out_labels(spark):
    """Fitted on four labels of five, judged on the fifth."""
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    teach, held = labels.where("doc_id % 5 <> 0"), labels.where("doc_id % 5 = 0")
    unseen = docs.join(held, "doc_id")
    toxic = toxicity.score_toxicity(unseen, toxicity.fit_flags(docs, teach)).select("toxic", "rejected").collect()
    assert np.mean([r.rejected for r in toxic if r.toxic]) >= 0.9 and np.mean([r.rejected for r in toxic if not r.toxic]) < 0.04
    ratings = teach.select("doc_id", quality.rating(F.col("quality"), F.col("toxic")).alias("grade"))
    good = quality.score_quality(unseen, quality.fit_quality(docs, ratings)).select(F.col("quality"), "selected").collect()
    assert np.mean([r.selected for r in good if r.quality]) >= 0.9 and np.mean([not r.selected for r in good if not r.quality]) >= 0.9


def brute_hash(values, kind):
    h = sum(v * pow(BASE, i, 1 << 64) for i, v in enumerate(values))
    h = (((h % (1 << 64)) ^ (kind * 0x51ED270B7A2D)) * 0xD6E8FEB86659FD93) % (1 << 64)
    return h ^ (h >> 32)


def brute_features(text, beginnings, marks):
    raw = (text or "").encode().lower()
    found = [(m.start(), m.end()) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
    span = lambda s, e, kind: brute_hash([b + 1 for b in raw[s:e]], kind)
    out = {span(s, e, 1) for s, e in found}
    if beginnings:
        out |= {span(s, s + n, n + 10) for s, e in found for n in (4, 5, 6, 7) if e - s > n}
    if marks:
        between = Counter()
        for (a, b), (c, d) in itertools.pairwise(found):
            if c - b > 1:
                mark = span(b, min(c, b + 16), 2)
                if c - b > 16:
                    mark = brute_mix(mark + int(math.log2(c - b)) * BASE, 4)
                between[mark] += 1
            if raw[a:b] == raw[c:d]:
                between[0xA5A5A5A5] += 1
        out |= {brute_mix(h + int(math.log2(max(len(found) / n, 1))) * BASE, 3) for h, n in between.items()}
    return out


def brute_mix(h, kind):
    h = (((h % (1 << 64)) ^ (kind * 0x51ED270B7A2D)) * 0xD6E8FEB86659FD93) % (1 << 64)
    return h ^ (h >> 32)


def brute_tails(model, text):
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))
    score = sum(weight.get(h, 0.0) for h in brute_features(text, **model.options))
    return [1 / (1 + math.exp(min(max(t - score, -50), 50))) for t in model.thresholds.tolist()]


def test_registered_models_by_plain_loops(spark, data, raw):
    """The scores of op1 and op10 for whole texts, from the fitted tables word by word."""
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    ratings = labels.select("doc_id", quality.rating(F.col("quality"), F.col("toxic")).alias("grade"))
    bad, good = toxicity.fit_flags(docs, labels), quality.fit_quality(docs, ratings)
    least = toxicity.threshold(float(bad.tails(np.zeros(1))[0, 0]))
    toxic, fine = ({r.doc_id: r for r in q(spark, data).collect()} for q in (op1_toxicity, op10_quality))
    assert len(toxic) == len(fine) == len(raw)
    for i, text, *_ in raw[::6]:
        tails = brute_tails(bad, text)
        assert (toxic[i].severity, toxic[i].p_toxic, toxic[i].p_severe) == pytest.approx((sum(tails), tails[0], tails[-1]))
        assert toxic[i].rejected == (tails[0] >= least)
        tails = brute_tails(good, text)
        assert (fine[i].expected_grade, fine[i].tail_prob, fine[i].p_best) == pytest.approx((sum(tails), tails[0], tails[-1]))
        assert fine[i].selected == (tails[0] >= quality.SELECT)


def test_languages_by_plain_loops(spark, data, raw):
    """Predictions and scores of op5 for whole texts: known words, else the mean of the longest known n-grams."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    docs = spark.read.parquet(f"{data}/documents.parquet")
    teach = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    model = langid.fit_languages(teach)
    tables = {n: {h: row for h, row in zip(hs.tolist(), logs.tolist(), strict=True)} for n, (hs, logs) in model.tables.items()}
    got = {r.doc_id: r for r in op5_language_id(spark, data).collect()}
    backed_off = 0
    for i, text, *_ in [r for r in raw if held(r[0])][::3]:
        total = np.zeros(len(model.languages))
        padded = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
        for m in re.finditer(r"[^ ]+", padded):
            value = tables[0].get(brute_hash(map(ord, m[0]), 0))
            if value is None:
                backed_off += 1
                for n in (4, 3, 2, 1):
                    whole = padded[m.start() - (n > 1) : m.end() + (n > 1)]
                    known = [tables[n][h] for k in range(len(whole) - n + 1) if (h := brute_hash(map(ord, whole[k : k + n]), n)) in tables[n]]
                    if known:
                        value = np.mean(known, 0)
                        break
            total += 0 if value is None else value
        share = np.exp(total - total.max())
        assert got[i].lang_pred == (model.languages[int(total.argmax())] if padded.strip() else "und")
        assert got[i].score == pytest.approx(1 / share.sum() if padded.strip() else 0, rel=1e-3)
    assert backed_off > 100


def test_long_texts_teach_and_cost_bounded_memory(spark):
    rows = [(i, ("needle " if i % 2 else "thread ") + "plain words " * (25_000 if i < 30 else 3), i % 2) for i in range(80)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 30], "doc_id bigint, severity int")
    out = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, grades=2)).collect()
    assert all(r.rejected == (r.doc_id % 2 == 1) for r in out)
    ask = "import resource, sys; sys.path.insert(0, %r); from quillseek.llm.textfeat import features; from quillseek.llm.langid import words; t = 'ab1é' * 7_500_000; before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; n = len(features([t])[0]) + sum(len(s.doc) for s in words([t])); print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"
    n, grown = map(int, subprocess.run([sys.executable, "-c", ask % os.getcwd()], capture_output=True, text=True, check=True).stdout.split())
    assert n > 0 and grown < 300


def test_samples_are_bounded_where_ids_repeat(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i} of many") for i in range(500)] + [(None, "no id")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i % 5, i % 2) for i in range(50)] + [(None, 1), (1, 9)], "doc_id bigint, g int")
    lists, grades, stands = labelled_sample(docs, labels, "doc_id", "text", "g", 2, 3, toxicity.OPTIONS)
    assert len(lists) == len(grades) == 6 and sorted(grades.tolist()) == [0, 0, 0, 1, 1, 1] and stands.sum() == pytest.approx(10)


def test_language_on_held_out_rows(spark, data, raw):
    lang = {r[0]: r[3] for r in raw}
    out = op5_language_id(spark, data).collect()
    assert len(out) == len(raw) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in out)


def test_language_backs_off_and_odd_rows(spark, odd, empty):
    rows = [(i, t, k) for i, (t, k) in enumerate([("the quick brown fox", "en"), ("the lazy dog", "en"), ("der schnelle fuchs", "de"), ("der faule hund schläft", "de")] * 3)]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    names, scores = model.predict(["the fox", "der fuchs", "schnellschnell", "quickest", "123 !!", None, "", "wwwq"])
    assert names[:4] == ["en", "de", "de", "en"] and names[4:7] == ["und"] * 3 and scores[4:7].tolist() == [0, 0, 0] and names[7] in ("de", "en")
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd.where("doc_id IS NOT NULL"), model).collect()}
    assert got[3] == got[4] == got[5] == "und" and got[6] in ("de", "en")
    assert langid.identify(empty, model).count() == 0
    blank = langid.fit_languages(empty)
    assert blank.predict(["text"])[0] == ["und"]
    assert langid.identify(odd.withColumn("score", F.lit("x")), model).where("score <= 1").count() == odd.count()


def test_language_counts_take_few_files(spark, monkeypatch):
    """However many partitions a shuffle has; more where the sample is large. The model is the same."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join("".join(rng.choice(list("abcdeé"[i % 2 :]), 5)) for _ in range(40)), "ab"[i % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    files, store = [], langid.stored
    monkeypatch.setattr(langid, "stored", lambda df, name: files.append(len((out := store(df, name)).inputFiles())) or out)
    few = langid.fit_languages(docs)
    confs = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        many = langid.fit_languages(docs)
        monkeypatch.setattr(langid, "PART_TEXTS", 2 * len(rows) // 40, raising=False)
        large = langid.fit_languages(docs)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert files[1] <= 16 < files[2] <= 40
    for n, (h, logs) in few.tables.items():
        assert len(h) and all(np.array_equal(h, m.tables[n][0]) and np.array_equal(logs, m.tables[n][1]) for m in (many, large))
