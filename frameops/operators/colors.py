"""Standardising colour columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from frameops.functions import color as C


def color_standardize(df: DataFrame, col: str) -> DataFrame:
    """Add ``value``, ``hex`` and ``rgb``; a text no rule can read gives the invalid colour."""
    value = F.col("_value")
    return (
        df.withColumn("_value", C.color_value(F.col(col)))
        .withColumn("hex", F.when(value.isNull(), F.lit(C.INVALID_HEX)).otherwise(C.hex_text(value)))
        .withColumn("rgb", F.when(value.isNull(), F.lit(C.INVALID_RGB)).otherwise(C.rgb_text(value)))
        .withColumn("value", F.coalesce(value, F.lit(0).cast("bigint")))
        .drop("_value")
    )


def color_reject_report(df: DataFrame, col: str) -> DataFrame:
    """How many rows each rule read, and how many nothing could read."""
    return (
        df.select(C.color_path(F.col(col)).alias("path"))
        .groupBy("path").agg(F.count(F.lit(1)).alias("n_rows"))
    )


def color_rejects(df: DataFrame, col: str) -> DataFrame:
    """The rows behind ``invalid`` in the report."""
    return df.filter(C.color_value(F.col(col)).isNull())


def hex_to_rgb(df: DataFrame, col: str, fallback: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Add ``r``, ``g``, ``b`` of a lenient hex text; anything else gives the fallback."""
    value = F.col("_value")
    channels = {c: F.coalesce(C.channel(value, c), F.lit(fallback[i])) for i, c in enumerate("rgb")}
    return df.withColumn("_value", C.hex_value(F.col(col))).withColumns(channels).drop("_value")


def pack_rgb24(df: DataFrame, r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    return df.withColumn("value", C.pack_rgb(F.col(r), F.col(g), F.col(b)))


def range24_filter(df: DataFrame, col: str, mode: str = "drop") -> DataFrame:
    """Keep values of the 24-bit range, or fail on the first one outside it."""
    inside = C.in_rgb24(F.col(col))
    if mode == "drop":
        return df.filter(inside)
    if mode == "error":
        message = F.concat(F.lit("colour outside 0..16777215: "), F.col(col).cast("string"))
        return df.withColumn(
            col, F.when(inside | F.col(col).isNull(), F.col(col)).otherwise(F.raise_error(message).cast(df.schema[col].dataType))
        )
    raise ValueError(f"unknown mode {mode!r}")


def unpack_rgb24(df: DataFrame, col: str, on_invalid: str = "error") -> DataFrame:
    """Add ``r``, ``g``, ``b``; values outside the range fail, turn null, or are dropped."""
    if on_invalid in ("error", "drop"):
        df = range24_filter(df, col, on_invalid)
    elif on_invalid != "null":
        raise ValueError(f"unknown mode {on_invalid!r}")
    value = F.col(col)
    return df.withColumns({c: F.when(C.in_rgb24(value), C.channel(value, c)) for c in "rgb"})


def format_color(df: DataFrame, col: str) -> DataFrame:
    """Add ``hex`` and ``rgb`` texts of 24-bit values; other values are an error."""
    value = F.col(col)
    return range24_filter(df, col, "error").withColumns({"hex": C.hex_text(value), "rgb": C.rgb_text(value)})


def rgb_to_hsv(df: DataFrame, r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    hue, saturation, value = C.hsv(F.col(r), F.col(g), F.col(b))
    return df.withColumns({"h": hue, "s": saturation, "v": value})
