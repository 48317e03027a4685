"""The opN queries: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ckptlake.llm import bpe

    return bpe.code(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ckptlake.llm import quality
    from ckptlake.llm.toxicity import held_out

    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~held_out()))
    return quality.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ckptlake.llm import minhash

    found = minhash.groups(_read(spark, sf_dir, "documents"), width=3, percent=85)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ckptlake.llm import html_text

    return html_text.extract(_read(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ckptlake.llm import decontaminate

    found = decontaminate.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256)
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), digest.alias("items_sha256"), (n_items >= 2).alias("contaminated"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ckptlake.llm import lm_score
    from ckptlake.llm.toxicity import held_out

    return lm_score.score(_read(spark, sf_dir, "documents"), held_out(remainder=1))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ckptlake.llm import fingerprint

    return fingerprint.with_edits(_read(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ckptlake.llm import suffix_dedup

    found = suffix_dedup.repeats(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ckptlake.llm import licenses

    return licenses.scan(_read(spark, sf_dir, "documents")).drop("spans")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ckptlake.llm import toxicity

    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", toxicity.held_out().alias("held_out"), F.col("p_toxic").alias("score"), (F.col("p_toxic") >= 0.5).cast("int").alias("predicted"), "severity", "grade", (F.col("p_toxic") >= 0.5).alias("toxic")
    )


QUERIES = {f.__name__: f for f in (op1_bpe, op2_quality, op3_minhash, op4_html, op5_decontaminate, op6_lm, op7_fingerprint, op8_suffix_dedup, op9_licenses, op10_toxicity)}
