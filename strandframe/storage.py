"""Tables in the folder that driver and executors share; they cut lineage, so that a lost executor costs a read and no more."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a temporary one serves a local master; on a cluster, whose executors would not see it, this raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="strandframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


class Scratch:
    """Tables in the shared folder. put() writes a frame and reads it back, so that lineage ends in files every executor sees."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, shared_path(spark, name), 0

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def put(self, df: DataFrame) -> DataFrame:
        df.write.option("compression", "zstd").parquet(at := self.path())
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch = at
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that nothing reads any more, and lets Spark free the shuffle files of frames that are gone."""
        for df in frames:
            self.erase(df._scratch)
        self.sweep()

    def erase(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def sweep(self) -> None:
        """Shuffle files go when the driver collects its garbage; this asks for it between the phases of a long operator."""
        gc.collect()
        self.spark._jvm.System.gc()
