"""Streams of image files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from samplegrid.sources.images import headers, is_image_path

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, width, height) of every file that comes to a folder, as it comes."""
    return headers(spark.readStream.format("binaryFile").schema(SCHEMA).load(path).where(is_image_path("path")))
