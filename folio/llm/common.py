"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that every word contract here splits on: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where that is unset.
    On a cluster without it there is no such folder, and this raises."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="folio-")  # driver and executors are one process
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


class Scratch:
    """Written tables in the shared folder that cut lineage; unlike cached blocks they outlive executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")  # a written table's shuffle is of no more use
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 500:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")  # whole texts: ten thousand are too many for a Python worker
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        at = self.path(name)
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *frames: DataFrame) -> None:
        """Deletes the files of tables that no later result reads."""
        for df in frames:
            for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                delete(self.spark, f)

    def keep_only(self, *frames: DataFrame) -> None:
        """Deletes all tables but those that the result reads."""
        kept = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for df in frames for f in df.inputFiles()}
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        for status in root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root):
            if status.getPath().getName() not in kept:
                delete(self.spark, str(status.getPath()))


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with a key of each row's own, ``_row``: doc_id may be null or stand on several rows. Written, so that the
    keys hold however often the result is read."""
    return scratch.keep(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def give_back() -> None:
    """Returns a Python worker's free memory to the system, as the worker waits for the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
