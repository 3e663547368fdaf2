"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but
the last return the columns of documents; docs must have those (others are left out).

Rows are kept or dropped as rows: null and repeated ids go through all stages. Stages give an
empty result for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillseek.llm import bpe, exactdedup, mixing, simhash, toxicity
from quillseek.llm.common import discard, documents, stored
from quillseek.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go. It learns from the labels of the documents at hand; null and empty texts are scored as the base rate and stay."""
    model = toxicity.fit_flags(docs, documents(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs.select(*COLUMNS), model).where(~F.col("rejected")).select(*COLUMNS)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty) the document of the largest id stays, of repeated rows one; a null id is smaller than any other."""
    return exactdedup.exact_dedup(docs.select(*COLUMNS))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document of the smallest id stays; rows without an id stay. Null, empty and blank texts are one component."""
    return simhash.near_dedup(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, at most three times; rows without words are taken as often as their source's rate has whole copies."""
    return mixing.replicate(docs.select(*COLUMNS))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (null: none), and whether decoding them gives the text back; one row for each row."""
    path = vocabulary("byte_bpe_50k.json")
    back = bpe.bpe_round_trip(docs.select("doc_id", "text"), path)
    return back.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("mixing to target weights", mixing_stage),
    ("bpe encoding", bpe_stage),
]

#: SQL can't express the fitted model, the fingerprints and the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "pipeline")
            discard(spark, before)
    return docs
