"""Pixel tables stored in square tiles, so that a crop reads the tiles it touches and no others.

A table is a folder per zone: one tile position of a number of neighbouring images, sorted by image and line.
A crop becomes a stored list of tiles first. The zones on that list prune folders while the query runs, and the rows
of other images in those zones fall to a join on (image, zone). Images of a batch are mostly cropped alike, so their tiles share
a zone; where each image is cropped elsewhere, give a zone fewer images.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from frameops.operators import geometry as G
from frameops.operators.regions import usable_regions
from frameops.schemas import PIXELS
from frameops.sources.zones import pruned

#: Tiles a side of an image; a zone's number holds the tile's line and column in 12 bits each.
GRID = 1 << 12


@dataclass(frozen=True)
class Tiling:
    """How a pixel table is laid out. Files suit a cluster best when ``side**2 * images`` pixels make about 100 MB."""

    side: int = 256
    images: int = 512

    def zone(self, image_id: Column, tile_y: Column, tile_x: Column) -> Column:
        block = F.floor(image_id / self.images).cast("long")
        return block * GRID * GRID + tile_y * GRID + tile_x

    def tile(self, position: Column) -> Column:
        return F.floor(position / self.side).cast("long")


def write_tiles(pixels: DataFrame, path: str, tiling: Tiling = Tiling()) -> None:
    """Store pixels under ``path``. A zone is written by one task: at most ``side**2 * images`` pixels."""
    zone = tiling.zone(F.col("image_id"), tiling.tile(F.col("y")), tiling.tile(F.col("x")))
    placed = pixels.select(*G.PIXEL, zone.alias("zone")).repartition("zone")
    placed.sortWithinPartitions("zone", "image_id", "y", "x").write.partitionBy("zone").parquet(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """All pixels under ``path`` with their ``zone``."""
    return spark.read.schema(f"{PIXELS.toDDL()}, zone long").parquet(path)


def touched(tiled: DataFrame, boxes: DataFrame, tiling: Tiling = Tiling()) -> DataFrame:
    """Pixels of all tiles that a box meets. ``boxes`` has one row per image: ``image_id, x_from, x_to, y_from, y_to``, half open."""
    def tiles(axis: str) -> Column:
        return F.explode(F.sequence(tiling.tile(F.col(f"{axis}_from")), tiling.tile(F.col(f"{axis}_to") - 1)))

    inside = boxes.filter((F.col("x_to") > F.col("x_from")) & (F.col("y_to") > F.col("y_from")))
    wanted = inside.withColumn("part", tiles("y")).withColumn("tile_x", tiles("x")).select(
        "image_id", tiling.zone(F.col("image_id"), F.col("part"), F.col("tile_x")).alias("zone"), "part")
    return pruned(tiled, wanted, ["image_id"]).select(*G.PIXEL)


def region_boxes(images: DataFrame, regions: DataFrame) -> DataFrame:
    """What ``region_crop`` reads: the region of an image, or all of an image without a usable one."""
    sides = usable_regions(images, regions)
    x, y, zero = F.col("mask_x"), F.col("mask_y"), F.lit(0)
    return images.join(sides, "image_id", "left").select(
        "image_id", F.coalesce(x, zero).alias("x_from"), F.coalesce(x + F.col("mask_width"), F.col("width")).alias("x_to"),
        F.coalesce(y, zero).alias("y_from"), F.coalesce(y + F.col("mask_height"), F.col("height")).alias("y_to"))


def pose_boxes(images: DataFrame, masks: DataFrame, **change: int) -> DataFrame:
    """What ``pose_setup`` reads: the window inside the image, or all of an image whose masks select nothing."""
    summary = G.mask_summary(masks)
    placed = G.pose_placement(images, summary, **change)

    def side(start: str, window: str, size: str, axis: str) -> list[Column]:
        return [F.greatest(F.lit(0), -F.col(start)).alias(f"{axis}_from"), F.least(F.col(size), F.col(window) - F.col(start)).alias(f"{axis}_to")]

    cut = placed.select("image_id", *side("left", "win_width", "w", "x"), *side("top", "win_height", "h", "y"))
    whole = images.join(summary.filter("NOT any").select("batch_id"), "batch_id", "left_semi").select(
        "image_id", F.lit(0).alias("x_from"), F.col("width").alias("x_to"), F.lit(0).alias("y_from"), F.col("height").alias("y_to"))
    return cut.unionByName(whole)
