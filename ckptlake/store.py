"""Tables between steps, in the folder that the cluster names for checkpoints.

A written table cuts lineage, survives lost executors and has its true size in
the next plan. The folder is read from the session's ``spark.checkpoint.dir``; a
folder of this machine is used only where the setting is unset and the master is
local, as in tests. What is written there goes when the application ends, and
earlier where nothing reads it any more.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ckptlake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class Scratch:
    """Tables of one run of an operator, under a folder of its own, which is deleted when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        path, fs = self._at(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, name: str, where: str = "true") -> tuple[DataFrame, int]:
        """The saved table, and how many of its rows meet a condition, told by the write itself."""
        seen = Observation()
        saved = self.save(df.observe(seen, F.count_if(F.expr(where)).alias("n")), name)
        return saved, seen.get["n"]

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that no returned frame reads."""
        for df in tables:
            for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
                path, fs = self._at(folder)
                fs.delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage by a table in the shared folder."""
    return Scratch(df.sparkSession, "cut").save(df, "rows")
