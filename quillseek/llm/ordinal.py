"""Cumulative-link ordinal regression on sparse hashed text features.

P(grade <= k) = logistic(threshold_k - score): one weight vector for all grades, and
ordered thresholds. A model is a few thousand hashes with weights; texts are scored whole,
in numpy over Arrow batches.

Fitting uses a bounded sample of labelled rows: at most fit_rows (a parameter) labels of each
grade, those of the smallest xxhash64 of their id, with their whole texts. Of documents that share an
id, one teaches: that of the smallest xxhash64 of its text. Rows of a grade are weighted back to
the grade's share of all labelled rows. A model keeps at most `kept` features (a parameter), those
that tell the grades apart most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import replacing, small_batches, with_field
from .textfeat import features

#: Labels of each grade that teach at most, and features that a model keeps at most, unless parameters say otherwise.
FIT_ROWS, KEPT = 4000, 20_000


@dataclass
class OrdinalModel:
    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    options: dict = field(default_factory=dict)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        d, h = features(texts, wanted=self.hashes, **self.options)
        w = self.weights[np.searchsorted(self.hashes, h)] if len(h) else np.zeros(0)
        return np.bincount(d, w, minlength=len(texts))

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1 on, a column each; a text without any known feature has score 0."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def fit_cumulative_link(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, share: np.ndarray, n_features: int, n_grades: int, ridge: float = 1e-5, rounds: int = 300, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the whole sample. (rows, cols): where features are; share: weight of each row."""
    n = len(grades)
    w = np.zeros(n_features)
    cut = np.array([np.sum(share[grades <= k]) / share.sum() for k in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    first = np.log(cut / (1 - cut))
    free = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros(n_features + n_grades - 1), np.zeros(n_features + n_grades - 1)
    share = share / share.sum()
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for step in range(1, rounds + 1):
        steps = np.exp(free[1:])
        theta = free[0] + np.concatenate([[0.0], np.cumsum(steps)])
        score = np.bincount(rows, w[cols], minlength=n)
        wide = np.concatenate([[-np.inf], theta, [np.inf]])
        high, low = logistic(wide[grades + 1] - score), logistic(wide[grades] - score)
        p = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high) / p * share, low * (1 - low) / p * share
        by_theta = np.bincount(grades, -dh, minlength=n_grades)[: n_grades - 1] + np.bincount(grades, dl, minlength=n_grades)[1:]
        by_w = np.bincount(cols, (dh - dl)[rows], minlength=n_features) + ridge * w
        tail = np.cumsum(by_theta[::-1])[::-1]
        g = np.concatenate([by_w, [by_theta.sum()], tail[1:] * steps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w -= move[:n_features]
        free -= move[n_features:]
    return w, free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def telling(rows: np.ndarray, hashes: np.ndarray, high: np.ndarray, least_g: float, least_docs: int = 3, most: int = KEPT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, counts among high rows, counts among the others), sorted by hash: features whose share differs between the two.

    The measure is the root of the likelihood ratio statistic, which also holds for few rows.
    """
    known, inverse = np.unique(hashes, return_inverse=True)
    a = np.bincount(inverse, high[rows], minlength=len(known))
    b = np.bincount(inverse, minlength=len(known)) - a
    na, nb = high.sum(), (~high).sum()

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9))

    share = (a + b) / max(1, na + nb)
    g = np.sqrt(np.maximum(2 * (part(a, share * na) + part(b, share * nb) + part(na - a, (1 - share) * na) + part(nb - b, (1 - share) * nb)), 0))
    keep = np.flatnonzero((g >= least_g) & (a + b >= least_docs))
    keep = np.sort(keep[np.argsort(-g[keep], kind="stable")[:most]])
    return known[keep], a[keep], b[keep]


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, grade_col: str, n_grades: int, fit_rows: int, options: dict) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of each sampled text, its grade, and how many labelled rows each sampled row stands for. The driver gets a row for each of at most fit_rows labels a grade."""
    small_batches(docs.sparkSession)
    rated = labels.select(F.col(id_col).alias("__id"), F.col(grade_col).cast("int").alias("__grade")).where(F.col("__id").isNotNull() & F.col("__grade").between(0, n_grades - 1)).distinct()
    per = {r[0]: r[1] for r in rated.groupBy("__grade").count().collect()}
    picks = None
    for g in sorted(per):
        some = rated.where(F.col("__grade") == g).orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
        picks = some if picks is None else picks.unionByName(some)
    if picks is None:
        return [], np.zeros(0, np.int64), np.zeros(0)
    small = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    met = small.join(F.broadcast(picks), F.col("id") == F.col("__id"))
    met = met.groupBy("__id", "__grade").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "__grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, h = features(b.column(0).to_pylist(), **options)
            ends = np.searchsorted(d, np.arange(len(b) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64))), b.column(1)], names=["h", "g"])

    table = met.mapInArrow(run, "h array<bigint>, g int").toArrow()
    lists = [np.asarray(x.values).view(np.uint64) for chunk in table.column("h").chunks for x in chunk]
    grades = np.array(table.column("g").to_pylist(), np.int64)
    # the same model whatever the order in which executors delivered the rows
    order = sorted(range(len(lists)), key=lambda i: (grades[i], len(lists[i]), lists[i][:8].tobytes()))
    lists, grades = [lists[i] for i in order], grades[order]
    stands = np.array([per[g] / max(1, np.sum(grades == g)) for g in grades.tolist()])
    return lists, grades, stands


def flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return rows, np.concatenate(lists) if lists else np.zeros(0, np.uint64)


def fit(lists: list[np.ndarray], grades: np.ndarray, stands: np.ndarray, n_grades: int, high: Callable[[np.ndarray], np.ndarray], options: dict, least_g: float, kept: int = KEPT, **more) -> OrdinalModel:
    """A model on the telling features. Grades that no row has merge with the next below; without rows everything is grade 0."""
    if not len(grades):
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.full(n_grades - 1, 50.0), options)
    rows, hashes = flat(lists)
    known, _, _ = telling(rows, hashes, high(grades), least_g, most=kept)
    at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
    hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
    w, theta = fit_cumulative_link(rows[hit], at[hit], grades, stands, len(known), n_grades, **more)
    return OrdinalModel(known, w, theta, options)


def scored(docs: DataFrame, model: OrdinalModel, text_col: str, names: tuple[str, str, str]) -> DataFrame:
    """docs with three doubles: expected grade, P(grade >= 1), P(highest grade)."""
    docs = replacing(docs, names, (text_col,))
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tails = model.tails(model.scores(b.column(at).to_pylist()))
            more = [tails.sum(1), tails[:, 0], tails[:, -1]]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x, pa.float64()) for x in more]], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, with_field(docs.schema, *[(n, T.DoubleType()) for n in names]))
