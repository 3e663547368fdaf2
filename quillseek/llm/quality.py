"""Quality by cumulative-link ordinal regression on graded ratings.

Features are words, and marks between words with how often they come, each once a text. Ratings are grades 0 to 2;
a text is selected if its grade is 1 or more at least SELECT probably (the tail probability).

Defined cases: a null or empty text has no feature and so the score of the base rate;
without labelled rows every expected grade is 0; ratings outside 0 to 2 are left out;
repeated rows are scored alike; an empty table gives an empty result; other columns are
carried along, but those that have an output's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import replacing
from .ordinal import FIT_ROWS, KEPT, OrdinalModel, fit, labelled_sample, scored

GRADES = 3
OPTIONS = {"beginnings": False, "marks": True}
SELECT = 0.35
#: How clearly a feature must tell low from better grades; words seldom do.
LEAST_G = 5.5


def rating(quality: Column, toxic: Column) -> Column:
    """The grade of a label row: 0 low quality, 1 good but toxic, 2 good and clean; null if either is."""
    return F.when(quality == 0, F.when(toxic.isNotNull(), 0)).when((quality == 1) & (toxic == 1), 1).when((quality == 1) & (toxic == 0), 2)


def fit_quality(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", fit_rows: int = FIT_ROWS, kept: int = KEPT) -> OrdinalModel:
    """ratings: id and a grade 0 to 2. fit_rows bounds the sample of each grade, kept the features of the model."""
    lists, grades, stands = labelled_sample(docs, ratings, id_col, text_col, grade_col, GRADES, fit_rows, OPTIONS)
    return fit(lists, grades, stands, GRADES, lambda g: g > 0, OPTIONS, least_g=LEAST_G, kept=kept)


def score_quality(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """docs with expected_grade (0 to 2), tail_prob = P(grade >= 1), p_best = P(grade 2) and selected."""
    out = scored(replacing(docs, ("selected",), (text_col,)), model, text_col, ("expected_grade", "tail_prob", "p_best"))
    return out.withColumn("selected", F.col("tail_prob") >= SELECT)
