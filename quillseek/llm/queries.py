"""The registered queries of these operators, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exactdedup, langid, linededup, media, mixing, quality, sharding, simhash, toxicity
from .common import documents

SHARDS = 40


def vocabulary(name: str, folder: str | None = None) -> str:
    """The path of a vocabulary, the same on every machine: in `folder`, or else where the package public_tokenizers has it."""
    if folder is not None:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit_flags(docs, documents(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs.select("doc_id", "text"), model).select("doc_id", "severity", "p_toxic", "p_severe", "rejected")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_dups(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    model = langid.fit_languages(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_bpe(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json", folder)
    back = bpe.bpe_round_trip(documents(spark, sf_dir).select("doc_id", "text"), path)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(documents(spark, sf_dir), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.media_columns(documents(spark, sf_dir))
    payload = F.col("payload")
    return rows.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.dedup_report(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    ratings = documents(spark, sf_dir, "labels").select("doc_id", quality.rating(F.col("quality"), F.col("toxic")).alias("grade"))
    model = quality.fit_quality(docs, ratings)
    return quality.score_quality(docs.select("doc_id", "text"), model).select("doc_id", "expected_grade", "tail_prob", "p_best", "selected")


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_toxicity, op2_mixing, op3_simhash, op4_line_dedup, op5_language_id, op6_bpe, op7_sharding, op8_media, op9_exact_dedup, op10_quality)
    return {f.__name__: f for f in ops}
