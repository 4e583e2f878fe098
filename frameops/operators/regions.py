"""Region masks over selected frames and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from frameops.functions.region import SIDES, clamp_region, with_region


def region_from_json(df: DataFrame, col: str) -> DataFrame:
    """Add ``region``, read from a JSON payload."""
    return with_region(df, col)


def clamp_regions(df: DataFrame, width: str | Column, height: str | Column) -> DataFrame:
    """Bound ``region`` by a frame size."""
    width = F.col(width) if isinstance(width, str) else width
    height = F.col(height) if isinstance(height, str) else height
    return df.withColumn("region", clamp_region(F.col("region"), width, height))


def _usable() -> Column:
    return F.coalesce((F.col("region.width") > 0) & (F.col("region.height") > 0), F.lit(False))


def video_masks(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """Mask of each video, as its size and the rectangle of ones.

    Without a region, or with an empty one, the rectangle is empty and the mask all zeros. ``regions`` has
    ``video_id, region``; ``sizes`` has ``video_id, target_width, target_height``.
    """
    return (
        clamp_regions(sizes.join(regions, "video_id", "left"), "target_width", "target_height")
        .select("video_id", "target_width", "target_height",
                *(F.when(_usable(), F.col(f"region.{s}")).otherwise(F.lit(0)).cast("int").alias(f"mask_{s}") for s in SIDES))
    )


def region_mask(frames: DataFrame, regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """Mask of each selected frame. It is the same for all frames of a video, so its positions are spelled out on demand only."""
    return frames.join(video_masks(regions, sizes), "video_id")


def mask_lines(masks: DataFrame) -> DataFrame:
    """Lines of each mask: ones in ``[x_from, x_to)``, zeros elsewhere."""
    height = F.col("target_height")
    inside = (F.col("y") >= F.col("mask_y")) & (F.col("y") < F.col("mask_y") + F.col("mask_height"))
    return (
        masks.filter(height > 0).withColumn("y", F.explode(F.sequence(F.lit(0), height - 1)))
        .withColumns({
            "x_from": F.when(inside, F.col("mask_x")).otherwise(F.lit(0)),
            "x_to": F.when(inside, F.col("mask_x") + F.col("mask_width")).otherwise(F.lit(0)),
        })
        .drop(*(f"mask_{s}" for s in SIDES), "target_height")
    )


def mask_positions(lines: DataFrame) -> DataFrame:
    """Every position of the masks with its value ``m``."""
    return (
        lines.filter(F.col("target_width") > 0)
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("target_width") - 1)))
        .withColumn("m", ((F.col("x") >= F.col("x_from")) & (F.col("x") < F.col("x_to"))).cast("double"))
        .drop("x_from", "x_to", "target_width")
    )


def mask_coverage(masks: DataFrame) -> DataFrame:
    """Share of ones per video over all its selected frames."""
    ones = F.sum(F.col("mask_width").cast("bigint") * F.col("mask_height"))
    area = F.sum(F.col("target_width").cast("bigint") * F.col("target_height"))
    return masks.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_frames"), ones.alias("ones"),
        F.coalesce(ones / F.nullif(area, F.lit(0).cast("bigint")), F.lit(0.0)).alias("coverage"),
    )


def usable_regions(images: DataFrame, regions: DataFrame) -> DataFrame:
    """``image_id`` and the sides of its region inside the image, where that is not empty. ``regions`` has ``image_id, region``."""
    return clamp_regions(images.join(regions, "image_id"), "width", "height").filter(_usable()).select(
        "image_id", *(F.col(f"region.{s}").cast("int").alias(f"mask_{s}") for s in SIDES)
    )


def region_crop(pixels: DataFrame, images: DataFrame, regions: DataFrame) -> DataFrame:
    """Pixels inside the region of their image, moved to its corner; images without a usable region are kept whole.

    ``regions`` has ``image_id, region``. Of a stored table, ``tiles.touched`` reads just the pixels this needs.
    """
    joined = pixels.select("batch_id", "image_id", "y", "x", "r", "g", "b").join(usable_regions(images, regions), "image_id", "left")
    x, y = (F.col(axis) - F.coalesce(F.col(f"mask_{axis}"), F.lit(0)) for axis in ("x", "y"))
    inside = (x >= 0) & (x < F.col("mask_width")) & (y >= 0) & (y < F.col("mask_height"))
    return joined.filter(F.col("mask_x").isNull() | inside).select(
        "batch_id", "image_id", y.alias("y"), x.alias("x"), "r", "g", "b"
    )


def crop_mask(images: DataFrame, regions: DataFrame) -> DataFrame:
    """Mask that goes with ``region_crop``: all ones at the region's size; images left whole have none."""
    whole = usable_regions(images, regions)
    return whole.withColumns({
        "target_width": F.col("mask_width"), "target_height": F.col("mask_height"), "mask_x": F.lit(0), "mask_y": F.lit(0),
    }).select("image_id", "target_width", "target_height", *(f"mask_{s}" for s in SIDES))
