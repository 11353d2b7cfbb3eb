"""Files that arrive in a folder, as a stream: headers are read and limits checked as files come, then they are decoded as in a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.sources import files

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, at_once: int = 1000, limits: dict[str, int] | None = None) -> DataFrame:
    """A stream of files.inspect rows; at_once bounds the files of one micro-batch."""
    rows = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", at_once).option("recursiveFileLookup", "true").load(folder)
    return files.inspect(rows.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("byte_count"), "content"), limits)


def decoded(spark: SparkSession, folder: str, at_once: int = 1000, limits: dict[str, int] | None = None, mode: str = "permissive") -> DataFrame:
    """A stream of frames: path, frame_no, delay_ms, width, height, data, error."""
    rows = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", at_once).option("recursiveFileLookup", "true").load(folder)
    return files.decode(rows.select("path", "content"), "path", limits, mode)


def counts(stream: DataFrame, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Files, bytes and refused files by format in windows of their modification time; later ones than `late` aren't counted."""
    window = F.window("modified", every)
    return stream.withWatermark("modified", late).groupBy(window.alias("window"), "format").agg(F.count(F.lit(1)).alias("n"), F.sum("byte_count").alias("bytes"), F.count("error").alias("refused"))
