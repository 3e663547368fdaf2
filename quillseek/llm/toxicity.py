"""Toxicity by cumulative-link ordinal regression.

Features are the words of a text and how its longer words begin, each once a text, so one
insult in a long text counts as much as in a short one. Severity grades come from labels alone:
0 clean, and from 1 on toxic, as many grades as the labels have. One weight vector serves all
grades; expected severity is the sum of the tail probabilities. Features are chosen by how they tell
toxic rows from clean ones.

Where labels only say toxic or not, as those at hand do, `severity_label` makes grades of the two
flags there are: 1 toxic, 2 toxic and of low quality as well.

Defined cases: a null or empty text has no feature and so the score of the base rate;
without labelled rows nothing is toxic; labels with a null id or grade, or one out of range, are
left out; repeated rows are scored alike; an empty table gives an empty result; other
columns are carried along, but those that have an output's name are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import replacing
from .ordinal import KEPT, OrdinalModel, fit, labelled_sample, scored

GRADES = 3
#: Labels of each grade that fitting reads at most; with word beginnings a row has many features.
FIT_ROWS = 2000
OPTIONS = {"beginnings": True, "marks": False}
#: A text is rejected if it is toxic in any grade at least this probably, and the odds of that are at least
#: ABOVE_BASE times those of a text without any evidence; a miss costs more than a false alarm.
REJECT, ABOVE_BASE = 0.05, 2.0
#: How clearly a feature must tell toxic from clean rows.
LEAST_G = 5.5


def severity_label(toxic: Column, quality: Column) -> Column:
    """The grade of a label row of two flags: 0 clean, 1 toxic, 2 toxic and of low quality; null if toxic is neither 0 nor 1."""
    return F.when(toxic == 0, 0).when((toxic == 1) & (quality == 0), 2).when(toxic == 1, 1)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "severity", grades: int = GRADES, fit_rows: int = FIT_ROWS, kept: int = KEPT) -> OrdinalModel:
    """labels: id and a grade from 0 to grades - 1. fit_rows bounds the sample of each grade, kept the features of the model."""
    lists, found, stands = labelled_sample(docs, labels, id_col, text_col, grade_col, grades, fit_rows, OPTIONS)
    return fit(lists, found, stands, grades, lambda g: g > 0, OPTIONS, least_g=LEAST_G, kept=kept)


def fit_flags(docs: DataFrame, labels: DataFrame, **more) -> OrdinalModel:
    """A model from labels with the flags toxic and quality."""
    return fit_toxicity(docs, labels.select("doc_id", severity_label(F.col("toxic"), F.col("quality")).alias("severity")), **more)


def threshold(base: float) -> float:
    """The probability from which on texts are rejected; base is that of a text without evidence. It is under 1 if base is."""
    return max(REJECT, ABOVE_BASE * base / (1 + (ABOVE_BASE - 1) * base))


def score_toxicity(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """docs with severity (0 to the highest grade, expected), p_toxic, p_severe and rejected."""
    out = scored(replacing(docs, ("rejected",), (text_col,)), model, text_col, ("severity", "p_toxic", "p_severe"))
    base = float(model.tails(np.zeros(1))[0, 0])
    return out.withColumn("rejected", F.col("p_toxic") >= threshold(base))
