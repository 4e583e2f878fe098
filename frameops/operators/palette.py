"""Palettes of image batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from frameops.functions import color as C
from frameops.operators.spacing import allowed_colors, farthest, nearest

# Stride, brightness and saturation limits by default, colour when nothing is allowed.
SAMPLE_RATE = 10
MAX_BRIGHTNESS, MIN_SATURATION, MAX_SATURATION = 140, 0.2, 0.6
FALLBACK_RGB = (80, 100, 90)


def pixel_grid_sample(pixels: DataFrame, rate: int = SAMPLE_RATE) -> DataFrame:
    """Every ``rate``-th line and column from 0, three channels."""
    return pixels.filter((F.col("y") % rate == 0) & (F.col("x") % rate == 0)).select(
        "batch_id", "image_id", "y", "x", "r", "g", "b"
    )


def distinct_palette(pixels: DataFrame) -> DataFrame:
    """Distinct colours of each batch and how many pixels have them."""
    return pixels.groupBy("batch_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("n_pixels"))


def muted_color_filter(df: DataFrame, max_brightness: int = MAX_BRIGHTNESS, min_sat: float = MIN_SATURATION,
                       max_sat: float = MAX_SATURATION) -> DataFrame:
    return df.filter(C.is_muted(F.col("r"), F.col("g"), F.col("b"), max_brightness, min_sat, max_sat))


def _values(colors: DataFrame) -> DataFrame:
    return colors.select(
        "batch_id", C.pack_rgb(F.col("r"), F.col("g"), F.col("b")).cast("int").alias("value")
    ).distinct()


def nearest_palette_color(queries: DataFrame, palette: DataFrame) -> DataFrame:
    """Nearest palette colour of each distinct query colour in the same batch.

    Ties go to the smallest 24-bit value. Batches without a palette have no answer rows.
    """
    found = nearest(_values(queries), _values(palette))
    return found.select(
        "batch_id", F.col("value").cast("bigint").alias("value"),
        F.col("near").cast("bigint").alias("nearest_value"), F.sqrt(F.col("dist2")).alias("distance"),
    )


def _measured_choices(pixels: DataFrame, rate: int, limits: tuple, measure: bool) -> DataFrame:
    """``(batch_id, value, dist2)`` of the chosen colour; ``dist2`` of a fallback only on ``measure``.

    Whether any colour is allowed depends on the limits alone: if one is, no batch is left for the fallback.
    """
    palette = _values(pixel_grid_sample(pixels, rate))
    allowed = allowed_colors(pixels.sparkSession, *limits).limit(1).select((F.col("value") % 1).cast("int").alias("_any"))
    r, g, b = FALLBACK_RGB
    # position (0, 0) is always sampled, so every batch is in the palette
    fallback = (
        palette.withColumn("_any", F.expr("CAST(coalesce(batch_id % 1, 0) AS INT)")).join(F.broadcast(allowed), "_any", "left_anti")
        .select("batch_id").distinct().withColumn("value", F.lit(r << 16 | g << 8 | b))
    )
    far = farthest(palette, *limits)
    if not measure:
        return far.select("batch_id", "value").unionByName(fallback)
    return far.unionByName(nearest(fallback, palette).select("batch_id", "value", "dist2"))


def farthest_color(pixels: DataFrame, rate: int = SAMPLE_RATE, max_brightness: int = MAX_BRIGHTNESS,
                   min_sat: float = MIN_SATURATION, max_sat: float = MAX_SATURATION) -> DataFrame:
    """Per batch the allowed colour farthest from every sampled pixel, as value, hex and rgb.

    The maximum is exact over whole-number colours; ties go to the smallest value. If the limits
    allow no colour, every batch gets the fallback colour, even though it breaks them.
    """
    chosen = _measured_choices(pixels, rate, (max_brightness, min_sat, max_sat), measure=False)
    return chosen.select("batch_id", F.col("value").cast("bigint").alias("value")).withColumns({
        "hex": C.hex_text(F.col("value")), "rgb": C.rgb_text(F.col("value")),
    })


def farthest_color_summary(pixels: DataFrame, rate: int = SAMPLE_RATE, max_brightness: int = MAX_BRIGHTNESS,
                           min_sat: float = MIN_SATURATION, max_sat: float = MAX_SATURATION) -> DataFrame:
    """Chosen colour per batch with its hue, saturation, value and distance to the palette."""
    chosen = _measured_choices(pixels, rate, (max_brightness, min_sat, max_sat), measure=True)
    channels = {c: C.channel(F.col("value"), c) for c in "rgb"}
    h, s, v = C.hsv(F.col("r"), F.col("g"), F.col("b"))
    return chosen.select("batch_id", "value", "dist2").withColumns(channels).select(
        "batch_id", "r", "g", "b", h.alias("h"), s.alias("s"), v.alias("v"),
        F.sqrt(F.col("dist2")).alias("distance"),
    )
