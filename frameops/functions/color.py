"""Colour expressions. Every function maps columns to a column and stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from frameops.functions.text import EDGE, WHITE, int_text

# What counts as a hex colour, the 24-bit limit, the text of a rejected colour.
HEX_COLOR = f"^{EDGE}#?[0-9a-fA-F]{{1,6}}{EDGE}$"
MAX_RGB24 = 0xFFFFFF
INVALID_HEX = "Invalid"
INVALID_RGB = "0, 0, 0"


def in_rgb24(value: Column) -> Column:
    return value.between(0, MAX_RGB24)


def is_hex_color(text: Column) -> Column:
    return F.coalesce(text.rlike(HEX_COLOR), F.lit(False))


def _hex_digits(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE + "#"))


def color_value(text: Column) -> Column:
    """24-bit value of a dirty colour text: hex first, then signed decimal, else null."""
    value = F.coalesce(hex_value(text), int_text(text))
    return F.when(in_rgb24(value), value)


def color_path(text: Column) -> Column:
    """Which rule read the text: ``hex``, ``decimal`` or ``invalid``."""
    return (
        F.when(color_value(text).isNull(), F.lit("invalid"))
        .when(is_hex_color(text), F.lit("hex"))
        .otherwise(F.lit("decimal"))
    )


def channel(value: Column, name: str) -> Column:
    """Channel ``r``, ``g`` or ``b`` of a 24-bit value."""
    shift = {"r": 16, "g": 8, "b": 0}[name]
    return F.shiftright(value, shift).bitwiseAND(F.lit(255)).cast("int")


def hex_text(value: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.hex(value), 6, "0"))


def rgb_text(value: Column) -> Column:
    return F.concat_ws(", ", *(channel(value, c).cast("string") for c in "rgb"))


def hex_value(text: Column) -> Column:
    """24-bit value of a lenient hex text, null for any other; short texts count as padded with zeros."""
    return F.when(is_hex_color(text), F.conv(_hex_digits(text), 16, 10).cast("bigint"))


def parse_hex_literal(text: str | None, fallback: tuple[int, int, int] = (0, 0, 0)) -> tuple[int, int, int]:
    """Channels of a hex colour the caller passes as a parameter instead of a column."""
    digits = (text or "").strip().removeprefix("#")
    if not 1 <= len(digits) <= 6 or set(digits) - set("0123456789abcdefABCDEF"):
        return fallback
    value = int(digits, 16)
    return value >> 16, value >> 8 & 255, value & 255


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    """24-bit value of three channels; fractions are cut off, the range is not checked."""
    r, g, b = (c.cast("bigint") for c in (r, g, b))
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue 0-360, saturation 0-1 and value 0-1 of channels 0-255; ties favour r, then g, then b."""
    r, g, b = (c.cast("double") / F.lit(255.0) for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    spread = F.nullif(top - low, F.lit(0.0))

    def arc(first: Column, second: Column, start: float) -> Column:
        return (F.lit(60.0) * ((first - second) / spread) + F.lit(start)) % F.lit(360.0)

    hue = (
        F.when(spread.isNull(), F.lit(0.0))
        .when(top == r, arc(g, b, 360.0))
        .when(top == g, arc(b, r, 120.0))
        .otherwise(arc(r, g, 240.0))
    )
    saturation = F.coalesce((top - low) / F.nullif(top, F.lit(0.0)), F.lit(0.0))
    return hue, saturation, top


def is_muted(r: Column, g: Column, b: Column, max_brightness: int, min_sat: float, max_sat: float) -> Column:
    """Dark enough and neither grey nor vivid, all limits included."""
    _, saturation, value = hsv(r, g, b)
    return (value * F.lit(255.0) <= F.lit(float(max_brightness))) & saturation.between(
        F.lit(float(min_sat)), F.lit(float(max_sat))
    )
