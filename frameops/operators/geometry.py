"""Moving pixels: rotate, fit, crop and fill, masks.

A pixel table is dense: every position of every image is a row. So output positions that come from a pixel are
computed from that pixel, output positions that come from nowhere are computed from the image size alone, and
the two are united. Nothing joins a position table to a pixel table; masks are looked up as bits, 64 positions at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from frameops.functions.color import parse_hex_literal
from frameops.operators import runs as R
from frameops.operators.lattice import lattice
from frameops.session import wide

PIXEL = ["batch_id", "image_id", "y", "x", "r", "g", "b"]
Fill = str | tuple[int, int, int]


def _fill(color: Fill) -> list[Column]:
    rgb = parse_hex_literal(color) if isinstance(color, str) else color
    return [F.lit(int(v)).cast("int").alias(c) for c, v in zip("rgb", rgb)]


def with_image(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """Add the columns of ``images`` (one row per image) to its pixels; pixels that have them all stay where they are."""
    extra = [c for c in images.columns if c != "batch_id"]
    if set(extra) <= set(pixels.columns):
        return pixels
    return join_images(pixels, images.select(*extra))


def join_images(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """Pixels with what is known of their image, met in hash tables of images, never of pixels.

    The optimiser takes pixels that expand from images to be as small as those, and a joined table of images to be
    large. Left to it, all pixels would be broadcast through the driver.
    """
    return pixels.join(images.hint("shuffle_hash"), "image_id")


def orphan_pixels(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """How many pixels each image has that ``images`` does not list: they are in no result of :func:`with_image`."""
    counts = pixels.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_pixels"))
    return counts.join(images.select("image_id"), "image_id", "left_anti")


def _rotation(degrees: int, width: Column, height: Column):
    """Source position of an output position, in 16.16 fixed point as imaging libraries rotate.

    Returns the map and the largest error fixed point adds to it.
    """
    turn = math.radians(degrees % 360)
    cos, sin = round(math.cos(turn), 15), round(math.sin(turn), 15)

    def fixed(number: float) -> int:
        return math.floor(number * 65536 + 0.5)

    def start(a: float, b: float, mid: Column, mid_a: Column, mid_b: Column) -> Column:
        corner = F.lit(a) * -mid_a + F.lit(b) * -mid_b + mid
        return F.floor((corner + F.lit(a * 0.5) + F.lit(b * 0.5)) * 65536 + 0.5)

    mid_x, mid_y = width / F.lit(2.0), height / F.lit(2.0)

    def source(x: Column, y: Column) -> tuple[Column, Column]:
        sx = start(cos, sin, mid_x, mid_x, mid_y) + x * F.lit(fixed(cos)) + y * F.lit(fixed(sin))
        sy = start(-sin, cos, mid_y, mid_x, mid_y) + x * F.lit(fixed(-sin)) + y * F.lit(fixed(cos))
        return F.shiftright(sx, 16).cast("int"), F.shiftright(sy, 16).cast("int")

    return cos, sin, source


def _near(center: Column, reach: Column, size: Column) -> Column:
    """Positions of an axis whose centre may lie within ``reach`` of ``center``."""
    first = F.greatest(F.lit(0), F.ceil(center - reach - 0.5).cast("int"))
    last = F.least(size - 1, F.floor(center + reach - 0.5).cast("int"))
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def rotate_pixels(pixels: DataFrame, images: DataFrame, degrees: int, background: Fill = "#000000") -> DataFrame:
    """Turn each image clockwise about its centre on the same canvas, nearest neighbour.

    A pixel reaches at most two positions per axis: the output positions whose centre can fall in its turned
    square. Each of those is kept when the exact map leads back to the pixel.
    """
    width, height = F.col("width"), F.col("height")
    cos, sin, source = _rotation(degrees, width, height)
    u = F.col("x") + F.lit(0.5) - width / 2
    v = F.col("y") + F.lit(0.5) - height / 2
    center_x = u * cos - v * sin + width / 2
    center_y = u * sin + v * cos + height / 2
    reach = F.lit((abs(cos) + abs(sin)) / 2 + 1e-6) + (width + height) / F.lit(2.0 ** 17)
    moved = (
        with_image(pixels, images)
        .withColumn("dx", F.explode(_near(center_x, reach, width)))
        .withColumn("dy", F.explode(_near(center_y, reach, height)))
    )
    sx, sy = source(F.col("dx"), F.col("dy"))
    covered = moved.filter((sx == F.col("x")) & (sy == F.col("y"))).select(
        "batch_id", "image_id", F.col("dy").alias("y"), F.col("dx").alias("x"), "r", "g", "b"
    )
    sx, sy = source(F.col("x"), F.col("y"))
    inside = sx.between(0, width - 1) & sy.between(0, height - 1)
    gaps = lattice(images, "width", "height").withColumns({"width": width, "height": height})
    return covered.unionByName(gaps.filter(~inside).select("batch_id", "image_id", "y", "x", *_fill(background)))


def fit_to_size(pixels: DataFrame, images: DataFrame, width: int, height: int, background: Fill = "#000000") -> DataFrame:
    """Centre each image on a canvas of the given size; larger images are cropped."""
    place = {
        "left": F.floor((F.lit(width) - F.col("width")) / 2).cast("int"),
        "top": F.floor((F.lit(height) - F.col("height")) / 2).cast("int"), "w": F.col("width"), "h": F.col("height"),
    }
    placed = images.select("image_id", "batch_id", *(c.alias(n) for n, c in place.items()))
    if {"width", "height"} <= set(pixels.columns):
        pixels = pixels.withColumns(place)
    return _place(pixels, placed, F.lit(width), F.lit(height), background)


def _place(pixels: DataFrame, placed: DataFrame, width: Column, height: Column, background: Fill) -> DataFrame:
    """Put each image's corner at ``(top, left)`` of a new canvas and fill what it leaves open.

    ``placed`` has one row per image with ``left``, ``top`` and the image size ``w``, ``h``; the
    canvas size may use its columns.
    """
    x, y = F.col("x") + F.col("left"), F.col("y") + F.col("top")
    copied = (
        with_image(pixels, placed).filter((x >= 0) & (x < width) & (y >= 0) & (y < height))
        .select("batch_id", "image_id", y.cast("int").alias("y"), x.cast("int").alias("x"), "r", "g", "b")
    )
    x, y = F.col("x") - F.col("left"), F.col("y") - F.col("top")
    covered = (x >= 0) & (x < F.col("w")) & (y >= 0) & (y < F.col("h"))
    gaps = lattice(placed, width, height).filter(~covered)
    return copied.unionByName(gaps.select("batch_id", "image_id", "y", "x", *_fill(background)))


# Masks ---------------------------------------------------------------------------------------

def mask_union(mask_pixels: DataFrame) -> DataFrame:
    """One mask per batch, selected where any member is above one half."""
    return mask_pixels.groupBy("batch_id", "y", "x").agg(F.bool_or(F.col("m") > 0.5).alias("selected"))


def _batch_frames(images: DataFrame) -> DataFrame:
    """Frame size of each batch: a batch is dense, so its images share one size."""
    return images.groupBy("batch_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))


def _without_mask(united: DataFrame, images: DataFrame) -> DataFrame:
    return _batch_frames(images).join(united.select("batch_id").distinct().hint("shuffle_hash"), "batch_id", "left_anti")


def mask_or_full(mask_pixels: DataFrame, images: DataFrame) -> DataFrame:
    """United mask of each image batch; a batch without any mask selects its whole frame."""
    united = mask_union(mask_pixels)
    given = united.join(images.select("batch_id").distinct(), "batch_id", "left_semi")
    whole = lattice(_without_mask(united, images), "width", "height")
    return given.unionByName(whole.select("batch_id", "y", "x", F.lit(True).alias("selected")))


def mask_bbox(mask: DataFrame) -> DataFrame:
    """Half-open bounding box of the selected positions; batches selecting nothing have no row."""
    return mask.filter("selected").groupBy("batch_id").agg(
        F.min("x").alias("min_x"), (F.max("x") + 1).alias("max_x"),
        F.min("y").alias("min_y"), (F.max("y") + 1).alias("max_y"),
    )


def mask_summary(masks: DataFrame) -> DataFrame:
    """One row per batch with a mask, from mask pixels or from runs: whether anything is selected, and the box around it."""
    return R.run_summary(masks) if "x_from" in masks.columns else R.pixel_summary(masks)


def _bbox_or_full(summary: DataFrame, images: DataFrame) -> DataFrame:
    """Frames meet the summary of their masks once, in hash tables of batches: neither is broadcast through the driver."""
    frames = _batch_frames(images).join(summary.hint("shuffle_hash"), "batch_id", "left").filter("any IS NULL OR any")
    zero = F.lit(0)
    whole = {"min_x": zero, "max_x": F.col("width"), "min_y": zero, "max_y": F.col("height")}
    return frames.select("batch_id", *(F.when(F.col("any"), F.col(name)).otherwise(side).alias(name) for name, side in whole.items()))


def batch_bbox(masks: DataFrame, images: DataFrame) -> DataFrame:
    """Box around each batch's united masks (pixels or runs); the whole frame without a mask, no row where masks select nothing."""
    return _bbox_or_full(mask_summary(masks), images)


def pose_window(bbox: DataFrame, width_change: int = 0, height_change: int = 0, offset_x: int = 0, offset_y: int = 0) -> DataFrame:
    """Source window of the output canvas: the box grown evenly, then shifted against the offset."""
    def side(low: str, high: str, change: int) -> Column:
        return F.greatest(F.lit(1), F.col(high) - F.col(low) + F.lit(change)).cast("int")

    def start(low: str, change: int, offset: int) -> Column:
        return (F.col(low) - F.lit(change // 2) - F.lit(offset)).cast("int")

    return bbox.select(
        "batch_id", start("min_x", width_change, offset_x).alias("start_x"), start("min_y", height_change, offset_y).alias("start_y"),
        side("min_x", "max_x", width_change).alias("win_width"), side("min_y", "max_y", height_change).alias("win_height"),
    )


def _untouched(pixels: DataFrame, summary: DataFrame, images: DataFrame) -> DataFrame:
    unmoved = images.join(summary.filter("NOT any").select("batch_id").hint("shuffle_hash"), "batch_id", "left_semi").select("image_id")
    return pixels.join(unmoved, "image_id", "left_semi").select(*PIXEL)


def empty_mask_passthrough(pixels: DataFrame, masks: DataFrame, images: DataFrame) -> DataFrame:
    """Pixels of batches whose masks (pixels or runs) select nothing, unchanged."""
    return _untouched(pixels, mask_summary(masks), images)


def pose_placement(images: DataFrame, summary: DataFrame, **change: int) -> DataFrame:
    """Per image of a batch with a window: where its corner goes, its size and the window's."""
    window = pose_window(_bbox_or_full(summary, images), **change)
    return images.join(window.hint("shuffle_hash"), "batch_id").select(
        "image_id", "batch_id", (-F.col("start_x")).alias("left"), (-F.col("start_y")).alias("top"),
        F.col("width").alias("w"), F.col("height").alias("h"), "win_width", "win_height",
    )


def pose_setup(pixels: DataFrame, images: DataFrame, masks: DataFrame, fill: Fill = "#000000",
               width_change: int = 0, height_change: int = 0, offset_x: int = 0, offset_y: int = 0,
               only_fill: bool = False) -> DataFrame:
    """Cut a window around the mask out of every image of a batch and fill what lies outside.

    With ``only_fill`` just the masked pixels are copied. Batches whose masks select nothing
    come back unchanged. ``masks`` are mask pixels or runs (see ``runs``); neither is spelt out or united position by position.
    """
    summary = mask_summary(masks)
    placed = pose_placement(images, summary, width_change=width_change, height_change=height_change, offset_x=offset_x, offset_y=offset_y)
    untouched = _untouched(pixels, summary, images)
    size = F.col("win_width"), F.col("win_height")
    if not only_fill:
        return _place(pixels, placed, *size, fill).unionByName(untouched)

    given = R.run_words(masks) if "x_from" in masks.columns else R.mask_words(masks, F.col("m") > 0.5)
    words = given.unionByName(R.run_words(R.full_runs(_without_mask(summary, images))))
    return (
        _masked_pixels(pixels, placed, words)
        .unionByName(_unmasked_spots(placed, words, fill)).unionByName(untouched)
    )


def _is_set() -> Column:
    return F.expr("coalesce(shiftright(bits, x & 63) & 1, 0) = 1")


def _masked_pixels(pixels: DataFrame, placed: DataFrame, words: DataFrame) -> DataFrame:
    """Masked pixels inside the window, moved to it."""
    y, x = F.col("y") + F.col("top"), F.col("x") + F.col("left")
    inside = (x >= 0) & (x < F.col("win_width")) & (y >= 0) & (y < F.col("win_height"))
    shown = with_image(pixels, placed).filter(inside).withColumn("word", F.shiftright("x", 6))
    marked = R.with_bits(shown, words)
    return marked.filter(_is_set()).select("batch_id", "image_id", y.alias("y"), x.alias("x"), "r", "g", "b")


def _unmasked_spots(placed: DataFrame, words: DataFrame, fill: Fill) -> DataFrame:
    """Window positions no masked pixel lands on; bits are looked up per 64 positions, before they expand."""
    first, last = -F.col("left"), F.col("win_width") - F.col("left") - 1
    runs = (
        placed.withColumn("dy", F.explode(F.sequence(F.lit(0), F.col("win_height") - 1)))
        .repartition(wide(placed.sparkSession), "image_id", "dy")
        .withColumn("y", F.col("dy") - F.col("top"))
        .withColumn("word", F.explode(F.sequence(F.shiftright(first, 6), F.shiftright(last, 6))))
    )
    start, end = F.greatest(first, F.col("word") * 64), F.least(last, F.col("word") * 64 + 63)
    # dealt again: images of a batch meet its words in the same places, and are still to expand
    marked = R.with_bits(runs, words, "left").repartition(wide(placed.sparkSession), "image_id", "dy", "word")
    spots = marked.withColumn("x", F.explode(F.sequence(start, end)))
    return spots.filter(~_is_set()).select(
        "batch_id", "image_id", F.col("dy").alias("y"), (F.col("x") + F.col("left")).alias("x"), *_fill(fill)
    )


# Channels ------------------------------------------------------------------------------------

def fill_channels(df: DataFrame, n_channels: str, rgb: str) -> DataFrame:
    """Add ``fill``: the colour cut to the channel count, or its last channel repeated."""
    n, colors = F.col(n_channels), F.col(rgb)
    extra = F.array_repeat(F.element_at(colors, -1), F.greatest(F.lit(0), n - F.size(colors)))
    return df.withColumn("fill", F.slice(F.concat(colors, extra), F.lit(1), n))


def quantize_pixels(df: DataFrame, cols: list[str], clip: bool = False) -> DataFrame:
    """0..1 to 0..255 in single precision, fractions cut off; ``clip`` bounds the product first. A null stays null."""
    def level(name: str) -> Column:
        scaled = F.col(name).cast("float") * F.lit(255.0).cast("float")
        if clip:
            bounded = F.greatest(F.lit(0.0).cast("float"), F.least(F.lit(255.0).cast("float"), scaled))
            scaled = F.when(scaled.isNotNull(), bounded)
        return scaled.cast("int").bitwiseAND(F.lit(255))

    return df.withColumns({name: level(name) for name in cols})


def dequantize_pixels(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: (F.col(c).cast("float") / F.lit(255.0).cast("float")).cast("float") for c in cols})


def bgr_to_rgb(pixels: DataFrame) -> DataFrame:
    """Swap the first and third channel."""
    swapped = {"r": F.col("b").alias("r"), "b": F.col("r").alias("b")}
    return pixels.select(*(swapped.get(c, F.col(c)) for c in pixels.columns))
