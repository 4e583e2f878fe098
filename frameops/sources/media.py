"""Catalogues of media files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


# File suffixes that count as video.
VIDEO_EXTENSIONS = ("webm", "mp4", "mkv", "gif", "mov")


def only_media(files: DataFrame, exts: tuple[str, ...] = VIDEO_EXTENSIONS) -> DataFrame:
    """Files whose text after the last dot, in lower case, is one of ``exts``."""
    return files.filter(F.lower(F.substring_index("name", ".", -1)).isin(*exts))


def media_catalog(files: DataFrame, exts: tuple[str, ...] = VIDEO_EXTENSIONS) -> DataFrame:
    return only_media(files, exts).orderBy("name")


def missing_media(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requested names that no file has, with the message for them."""
    missing = requests.join(files.select("name").distinct(), "name", "left_anti").select(*requests.columns)
    return missing.withColumn("message", F.concat(F.lit("Invalid video file: "), F.col("name")))


def _listing(files: DataFrame) -> DataFrame:
    # content is never selected, so files are listed and not opened
    return files.select(
        F.substring_index("path", "/", -1).alias("name"), "length",
        F.unix_millis("modificationTime").alias("mtime_ms"),
    )


def read_media_catalog(spark: SparkSession, directory: str, exts: tuple[str, ...] = VIDEO_EXTENSIONS) -> DataFrame:
    """Catalogue of the files lying directly in ``directory``."""
    return media_catalog(_listing(spark.read.format("binaryFile").load(directory)), exts)


def read_media_stream(spark: SparkSession, directory: str) -> DataFrame:
    """Stream of the files in ``directory`` as they arrive, each reported once."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return _listing(spark.readStream.format("binaryFile").schema(schema).load(directory))
