"""Tables between steps, as in ``ckptlake.store``, and what operators do with hot keys and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ckptlake.store import Scratch

__all__ = ["Scratch", "beside", "shards_for", "text_bytes"]
SALTS = 16


def beside(rows: DataFrame, one: DataFrame, key: str, by: Column, how: str = "inner") -> DataFrame:
    """Rows joined to the one row of ``one`` that has their key, each key dealt to SALTS partitions by ``by``, since one key may have a third of all rows."""
    salted = one.withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, [key, "__salt"], how).drop("__salt")


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: one pass in the JVM."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0


def shards_for(docs: DataFrame, bytes_a_shard: int, text_col: str = "text") -> int:
    """How many shards keep a shard's part of the texts near a size, whatever the texts' sum; at least two a shuffle partition."""
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs, text_col) // bytes_a_shard))
