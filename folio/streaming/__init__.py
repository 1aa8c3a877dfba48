"""Structured Streaming: PDF files that arrive in a folder become text as they come. Decoding keeps no state, so no
watermark is needed; each file is read once, and Spark's checkpoint tells which ones were."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..documents import numbered
from ..pdf import relations as rel

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """doc_id, path, content of the PDF files that arrive below ``path``."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true")
    return numbered(reader.option("maxFilesPerTrigger", files_per_batch).load(path).select("path", "content"))


def ingest(spark: SparkSession, path: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes the glyphs of arriving files to ``target`` as Parquet; with ``once`` it ends when all that is there is read."""
    writer = rel.glyphs(arriving(spark, path)).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start(target)
