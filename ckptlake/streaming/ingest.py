"""Continuous ingestion: one commit for each checkpoint file that arrives.

A file source with a fixed schema finds files; each micro-batch commits its files
in the order of their names. Objects are content-addressed and a file's commit is
looked for before it is made, so a batch that is run again after a failure
changes nothing. ``branch_state`` keeps, for each branch of a stream of commits,
the number since the last full one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ckptlake.operators.lake import Lake


def watch(lake: Lake, folder: str, checkpoint: str, config: bytes | None = None, per_batch: int = 8):
    """Commit what is in folder and not committed yet, then stop; the query is returned when it has ended."""
    spark = lake.spark
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.safetensors").option("maxFilesPerTrigger", per_batch).load(folder).select("path")

    def commit(batch: DataFrame, _: int) -> None:
        for row in batch.orderBy("path").collect():  # names of at most per_batch files
            name = row["path"].rpartition("/")[2]
            tip = lake.head()[1]
            if lake.table("commits").where((F.col("checkpoint_name") == name) & (F.col("message") == f"ingest {name}")).limit(1).count():
                continue
            lake.commit(row["path"], f"ingest {name}", config=config if tip is None else None)

    query = files.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _count(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    since, total, last = state.get if state.exists else (-1, 0, -1)
    rows = pd.concat(list(batches)).sort_values("seq")
    for seq, full in zip(rows["seq"], rows["full"], strict=True):
        since = 0 if full or since < 0 else since + 1
        total, last = total + 1, int(seq)
    state.update((since, total, last))
    yield pd.DataFrame({"branch": [key[0]], "since_full": [since], "n_commits": [total], "last_seq": [last]})


def branch_state(commits: DataFrame) -> DataFrame:
    """(branch, since_full, n_commits, last_seq) after each batch of (branch, seq, full), one row for each branch that moved."""
    return commits.groupBy("branch").applyInPandasWithState(_count, "branch long, since_full long, n_commits long, last_seq long", "since_full long, n_commits long, last_seq long", "update", GroupStateTimeout.NoTimeout)
