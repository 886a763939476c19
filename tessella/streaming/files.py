"""Streams of image files: frames of new files, and running statistics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources import images


def frames(spark: SparkSession, path: str, mask: str = "*", first_only: bool = False) -> DataFrame:
    """A streaming table of the frames of files as they arrive under a path."""
    return images.decode(images.files(spark, path, mask, stream=True), first_only)


def format_counts(stream: DataFrame) -> DataFrame:
    """Running numbers of frames and bytes by format; for the complete or update mode."""
    return stream.groupBy("format").agg(F.count("*").alias("n_frames"), F.sum(F.octet_length("bits")).alias("n_bytes"), F.count("error").alias("n_errors"))


def arrivals(spark: SparkSession, path: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Files and bytes by window of their modification time, late files taken up to a watermark; for the append mode."""
    table = images.files(spark, path, stream=True).select("modificationTime", "length").withWatermark("modificationTime", late)
    return table.groupBy(F.window("modificationTime", window)).agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))
