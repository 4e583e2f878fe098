"""Decoded images as pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from frameops.session import wide

def unpack_images(packed: DataFrame) -> DataFrame:
    """``(batch_id, image_id, height, width, nChannels, data)`` rows to pixels; alpha is dropped.

    An image is cut into lines of bytes, which are dealt over the cluster, and lines into positions. One channel means
    grey; more are stored as blue, green, red. Images without bytes or size have no pixels.
    """
    # no filter on the bytes: it would move below whatever makes them, which would then be done twice
    whole = "height > 0 AND width > 0 AND data IS NOT NULL"
    lines = (
        packed.select(F.col("batch_id").cast("bigint"), F.col("image_id").cast("bigint"), "width", "nChannels", "data",
                      F.expr(f"explode(CASE WHEN {whole} THEN sequence(0, height - 1) END)").alias("y"))
        .withColumn("line", F.expr("substring(data, y * width * nChannels + 1, width * nChannels)")).drop("data")
        .repartition(wide(packed.sparkSession), "image_id", "y")
    )
    spots = lines.withColumn("x", F.expr("explode(sequence(0, width - 1))"))
    code = "CAST(conv(hex(substring(line, x * nChannels + 1, least(3, nChannels))), 16, 10) AS INT)"
    colors = spots.select("batch_id", "image_id", "y", "x", "nChannels", F.expr(code).alias("code"))
    grey = F.col("nChannels") == 1
    return colors.select(
        "batch_id", "image_id", F.col("y").cast("int"), F.col("x").cast("int"), F.expr("code & 255").alias("r"),
        F.when(grey, F.col("code")).otherwise(F.expr("shiftright(code, 8) & 255")).alias("g"),
        F.when(grey, F.col("code")).otherwise(F.expr("shiftright(code, 16) & 255")).alias("b"),
    )


def read_packed_images(spark: SparkSession, directory: str, batch_id: int = 0) -> DataFrame:
    """Image files of a directory, decoded by Spark's image source. The id is a hash of the whole path.

    Files that cannot be decoded are listed by :func:`undecodable_images`.
    """
    image = spark.read.format("image").option("dropInvalid", "true").load(directory).select("image.*")
    return image.select(
        F.lit(batch_id).cast("bigint").alias("batch_id"), F.xxhash64("origin").alias("image_id"),
        F.substring_index("origin", "/", -1).alias("name"), "height", "width", "nChannels", "data",
    )


def undecodable_images(spark: SparkSession, directory: str) -> DataFrame:
    """Names of the files of a directory that hold no image, with a message."""
    image = spark.read.format("image").load(directory).select("image.*")
    return image.filter("height < 0").select(
        F.substring_index("origin", "/", -1).alias("name"), F.lit("Could not decode image").alias("error"))


def read_image_pixels(spark: SparkSession, directory: str, batch_id: int = 0) -> DataFrame:
    return unpack_images(read_packed_images(spark, directory, batch_id))
