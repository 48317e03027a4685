"""The corpus pipeline: five stages over ``documents``, each calling one operator of ``ckptlake.llm``.

Every stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes it as
Parquet in the shared folder and hands the next stage what it reads there. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ckptlake.llm import bpe, decontaminate, minhash, suffix_dedup, toxicity
from ckptlake.llm.store import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely than not to be toxic of any grade go. The model learns from the corpus's labels, but for the fold that is held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    return toxicity.reject(docs, toxicity.fit(docs, labels), 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their five-word shingles, the one of least id stays."""
    return minhash.keep_first(docs, width=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 50 that also start in a document of smaller id go; every document stays, with the text that is left."""
    return suffix_dedup.cut_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of any benchmark item occurs go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_items=1)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    return bpe.code(docs, public_tokenizers.path("word_bpe_49k.json"), ("n_tokens", "ids", "ids_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL can't express the trained, hashed and tokenizing stages; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
