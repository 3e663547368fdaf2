"""Language identification: words first, backing off to shorter and shorter n-grams.

A known word adds its log frequency in each language. A word that the model doesn't know
adds the mean log frequency of its character 4-grams that the model knows; if there is none,
of its 3-grams, then 2-grams, then letters. The language with the largest sum wins; the
score is its softmax share.

Fitting reads a sample: of each language about `sample` texts (all, if it has fewer), chosen by
a hash of the id, whole. A model keeps at most `words_kept` words and `grams_kept` n-grams of each
length, the commonest; of words those that come `least_words` times at least. All four are parameters.

Defined cases: a null text, or one without a letter, is `und` with score 0; ties go to the
smaller language name; a model without languages says `und`; rows without language or
text teach nothing; an empty table gives an empty result; other columns are carried along,
but those that have an output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, replacing, small_batches, stored, with_field
from .textfeat import _mix, powers, slices

SAMPLE = 1500
LONGEST = 4
WORDS_KEPT, GRAMS_KEPT, LEAST_WORDS = 60_000, 60_000, 2
SMOOTH = 0.1
#: Tasks that sum and write the counts: so many, or more where each would get over PART_TEXTS sampled texts, times languages.
PARTS, PART_TEXTS = 16, 4000
UND = "und"

_cache: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _cache:
        _cache["is"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _cache["is"]


@dataclass
class Slice:
    """Words of texts: where they are, and what is needed to hash any span."""

    doc: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    sums: np.ndarray

    def hashes(self, s: np.ndarray, e: np.ndarray, kind: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[e] - self.sums[s]) * powers(len(self.sums))[1][s], kind)

    def grams(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the word, hash) of the n-grams of some words; from 2 on they see the words' borders."""
        s, e = self.starts[which] - (n > 1), self.ends[which] + (n > 1)
        count = np.maximum(e - s - n + 1, 0)
        owner = np.repeat(np.arange(len(which)), count)
        at = np.repeat(s, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return owner, self.hashes(at, at + n, n)


def words(texts: list[str | None]) -> Iterator[Slice]:
    for owners, parts in slices([(t or "").lower() for t in texts]):
        code = np.frombuffer((" " + " ".join(parts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = letters()[code]
        code = np.where(inside, code, 32).astype(np.uint64)
        up, _ = powers(len(code) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * up[: len(code)], dtype=np.uint64)])
        edge = np.flatnonzero(np.diff(inside.astype(np.int8))) + 1
        starts, ends = edge[::2], edge[1::2]
        bounds = np.cumsum([len(p) + 1 for p in parts]) + 1
        yield Slice(np.array(owners, np.int64)[np.searchsorted(bounds, starts, "right")], starts, ends, sums)


@dataclass
class LanguageModel:
    languages: list[str]
    #: By n (0: words): sorted hashes, and log frequencies with a column for each language.
    tables: dict[int, tuple[np.ndarray, np.ndarray]]

    def find(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, _ = self.tables[n]
        if not len(known):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return at, known[at] == h

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        k, n = len(self.languages), len(texts)
        total, seen = np.zeros((n, k)), np.zeros(n, bool)
        for s in words(texts):
            seen[s.doc] = True
            if not k:
                continue
            at, hit = self.find(0, s.hashes(s.starts, s.ends, 0))
            value = np.zeros((len(s.doc), k), np.float32)
            value[hit] = self.tables[0][1][at[hit]]
            rest = np.flatnonzero(~hit)
            for m in range(LONGEST, 0, -1):
                owner, h = s.grams(rest, m)
                at, hit = self.find(m, h)
                owner, logs = owner[hit], self.tables[m][1][at[hit]]
                count = np.bincount(owner, minlength=len(rest))
                got = count > 0
                for j in range(k):
                    value[rest[got], j] = np.bincount(owner, logs[:, j], minlength=len(rest))[got] / count[got]
                rest = rest[~got]
            for j in range(k):
                total[:, j] += np.bincount(s.doc, value[:, j], minlength=n)
        if not k:
            return [UND] * n, np.zeros(n)
        best = total.argmax(1)
        share = 1 / np.exp(np.maximum(total - total.max(1, keepdims=True), -700)).sum(1)
        return [self.languages[b] if x else UND for b, x in zip(best.tolist(), seen.tolist(), strict=True)], np.where(seen, share, 0.0)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, n, hash, count) of the words and n-grams of (text, language) batches."""
    for b in batches:
        texts, names = b.column(0).to_pylist(), b.column(1).to_pylist()
        for name in sorted(set(names)):
            some = [t for t, x in zip(texts, names, strict=True) if x == name]
            for s in words(some):
                every = np.arange(len(s.doc))
                for n in range(LONGEST + 1):
                    h, c = np.unique(s.grams(every, n)[1] if n else s.hashes(s.starts, s.ends, 0), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array(np.full(len(h), n, np.int32)), pa.array(h.view(np.int64)), pa.array(c)], names=["lang", "n", "h", "c"])


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, words_kept: int = WORDS_KEPT, grams_kept: int = GRAMS_KEPT, least_words: int = LEAST_WORDS) -> LanguageModel:
    """A model from the labelled rows of docs. The driver gets one row for each language, and the kept words and n-grams."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    per = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(per)
    if not languages:
        return LanguageModel([], {n: (np.zeros(0, np.uint64), np.zeros((0, 0), np.float32)) for n in range(LONGEST + 1)})
    rate = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample / per[k]))])[F.col("lang")]
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < rate * 1_000_000)
    small_batches(docs.sparkSession)
    counts = picked.select("text", "lang").mapInArrow(_counts, "lang string, n int, h bigint, c bigint").groupBy("n", "h").agg(*[F.sum(F.when(F.col("lang") == k, F.col("c")).otherwise(0)).alias(f"c{i}") for i, k in enumerate(languages)])
    all_of = sum((F.col(f"c{i}") for i in range(1, len(languages))), F.col("c0"))
    parts = max(PARTS, sum(min(sample, n) for n in per.values()) * len(languages) // PART_TEXTS)
    counts = stored(counts.withColumn("total", all_of).coalesce(parts), "language-counts")
    kept = [counts.where((F.col("n") == n) & (F.col("total") >= (1 if n else least_words))).orderBy(F.desc("total"), "h").limit(grams_kept if n else words_kept) for n in range(LONGEST + 1)]
    union = kept[0]
    for k in kept[1:]:
        union = union.unionByName(k)
    table = union.toArrow()
    discard(docs.sparkSession, counts)
    n_of, h = table.column("n").to_numpy(), table.column("h").to_numpy().view(np.uint64)
    c = np.stack([table.column(f"c{i}").to_numpy() for i in range(len(languages))], 1) if len(h) else np.zeros((0, len(languages)))
    tables = {}
    for n in range(LONGEST + 1):
        here = np.flatnonzero(n_of == n)
        here = here[np.argsort(h[here])]
        x = c[here] + SMOOTH
        tables[n] = (h[here], np.log(x / x.sum(0, keepdims=True)).astype(np.float32) if len(here) else x.astype(np.float32))
    return LanguageModel(languages, tables)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred string and score double."""
    docs = replacing(docs, ("lang_pred", "score"), (text_col,))
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = model.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, with_field(docs.schema, ("lang_pred", T.StringType()), ("score", T.DoubleType())))
