"""Eight-tap Lanczos resampling in fixed point, on lines packed as arrays.

A line of pixels is one array of packed colours. The horizontal pass turns it into the line of the target width where it
lies; the lines then travel once, to the blocks of target lines that use them, and are weighed there column by column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from frameops.functions.region import computed_once
from frameops.operators.geometry import join_images
from frameops.session import wide

# Taps per axis and weight scale of the 8-bit resampling this reproduces.
TAPS = 8
SCALE_BITS = 11

#: Bits of a channel inside a packed sum: sums of eight weighted levels stay within 20 bits and a sign.
FIELD = 21
#: Added to each channel of a packed sum, so that none is below zero.
OFFSET = 1 << FIELD - 1
#: Target lines that are weighed together. They use at most ``TAPS`` source lines each.
BLOCK = 32
CHANNELS = {"r": 2 * FIELD, "g": FIELD, "b": 0}


def _shape(distance: Column) -> Column:
    """Lanczos window of radius four, up to a common factor."""
    angle = F.lit(3.141592653589793) * distance
    return F.when(F.abs(distance) < 1e-6, F.lit(1.0)).otherwise(
        F.sin(angle) * F.sin(angle / 4) * 4 / F.nullif(angle * angle, F.lit(0.0))
    )


def _base(to: str, src: str, dst: str) -> str:
    """Source position left of the middle of target position ``to``, in single precision as imaging libraries place it."""
    return f"CAST(floor(CAST(({to} + 0.5D) * (CAST({src} AS DOUBLE) / {dst}) - 0.5D AS FLOAT)) AS INT)"


def with_taps(df: DataFrame, src: str, dst: str, to: str) -> DataFrame:
    """Adds ``taps`` of target position ``to``: source position ``at`` and whole-number weight ``w`` of each of the eight.

    Taps beyond an edge count for the edge.
    """
    at = F.expr(f"CAST(({to} + 0.5D) * (CAST({src} AS DOUBLE) / {dst}) - 0.5D AS FLOAT)")
    part = (at - F.col("base").cast("float")).cast("float").cast("double")
    raw = F.array(*(_shape(part + F.lit(TAPS // 2 - 1.0 - i)) for i in range(TAPS)))
    total = F.aggregate("raw", F.lit(0.0), lambda total, weight: total + weight)
    clamped = [F.greatest(F.lit(0), F.least(F.col(src) - 1, F.col("base") - (TAPS // 2 - 1) + i)) for i in range(TAPS)]
    weights = [F.rint(F.col("raw")[i] / F.col("total") * (1 << SCALE_BITS)).cast("bigint") for i in range(TAPS)]
    taps = F.array(*(F.struct(a.alias("at"), w.alias("w")) for a, w in zip(clamped, weights)))
    based = df.withColumn("base", F.expr(_base(to, src, dst)))
    summed = based.withColumn("raw", computed_once(raw)).withColumn("total", computed_once(total))
    return summed.withColumn("taps", computed_once(taps)).drop("base", "raw", "total")


def tap_table(sizes: DataFrame) -> DataFrame:
    """``taps`` of every target position ``to`` of each distinct ``(src, dst)`` size."""
    spots = sizes.select("src", "dst").distinct().withColumn("to", F.explode(F.sequence(F.lit(0), F.col("dst") - 1)))
    return with_taps(spots, "src", "dst", "to")


def packed_lines(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """One row per line and ``keys``: ``y`` and ``line``, its packed colours from left to right; ``sw`` is the width of the image.

    Positions without a pixel count as black.
    """
    colors = " + ".join(f"shiftleft(CAST({c} AS BIGINT), {shift})" for c, shift in CHANNELS.items())
    lines = pixels.groupBy(*keys, "y").agg(F.array_sort(F.collect_list(F.expr(f"struct(x, {colors} AS rgb)"))).alias("spots"))
    dense = F.expr("""CASE WHEN size(spots) = sw THEN spots.rgb
        ELSE transform(sequence(0, sw - 1), x -> coalesce(get(filter(spots, s -> s.x = x), 0).rgb, 0L)) END""")
    return lines.withColumn("line", dense).drop("spots")


def _sum(value: str, weight: str) -> str:
    return " + ".join(f"{value.format(i)} * {weight.format(i)}" for i in range(TAPS))


def _across(lines: DataFrame, taps: DataFrame) -> DataFrame:
    """Lines of the target width: sums of eight packed colours, whose channels never meet."""
    ordered = F.array_sort(F.collect_list(F.struct("to", "taps")))
    table = taps.groupBy(F.col("src").alias("sw"), F.col("dst").alias("tw")).agg(ordered["taps"].alias("line_taps"))
    packed = _sum("line[t[{0}].at]", "t[{0}].w")
    offset = sum(OFFSET << shift for shift in CHANNELS.values())
    return lines.join(table, ["sw", "tw"]).withColumn("line", F.expr(f"transform(line_taps, t -> {packed} + {offset}L)")).drop("line_taps")


def _blocks_using() -> Column:
    """Blocks of target lines that use source line ``y``: of the few targets nearby, those with a tap on it."""
    ratio, half = "(CAST(sh AS DOUBLE) / th)", TAPS // 2
    first = f"CASE WHEN y = 0 THEN 0 ELSE greatest(0, CAST(floor((y - {half} + 0.5D) / {ratio} - 0.5D) AS INT) - 1) END"
    last = f"CASE WHEN y = sh - 1 THEN th - 1 ELSE least(th - 1, CAST(ceil((y + {half} + 0.5D) / {ratio} - 0.5D) AS INT) + 1) END"
    base = _base("t", "sh", "th")
    inner = f"greatest(0, least(sh - 1, {base} - {half - 1})) <= y AND y <= greatest(0, least(sh - 1, {base} + {half}))"
    return F.expr(f"array_distinct(transform(filter(sequence({first}, {last}), t -> {inner}), t -> CAST(t DIV {BLOCK} AS INT)))")


def _down(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels of the target height: a block of target lines gathers the lines it uses, then weighs them position by position."""
    sent = lines.withColumn("block", F.explode(_blocks_using())).select(*keys, "block", "y", "line")
    gathered = sent.repartition(wide(lines.sparkSession), *keys, "block").groupBy(*keys, "block").agg(
        F.map_from_entries(F.collect_list(F.struct("y", "line"))).alias("lines"))
    targets = with_taps(gathered.withColumn("to", F.expr(
        f"explode(sequence(block * {BLOCK}, least(block * {BLOCK} + {BLOCK - 1}, th - 1)))")), "sh", "th", "to")
    eight = {f"line_{i}": F.expr(f"lines[taps[{i}].at]") for i in range(TAPS)}
    weights = {f"w_{i}": F.expr(f"taps[{i}].w") for i in range(TAPS)}
    ready = targets.withColumns(eight | weights).withColumn("y", F.col("to")).drop("lines", "taps", "to")
    spots = ready.withColumn("x", F.expr("explode(sequence(0, tw - 1))"))

    def level(shift: int) -> str:
        mask, bits = (1 << FIELD) - 1, 2 * SCALE_BITS
        total = _sum(f"coalesce((shiftright(line_{{0}}[x], {shift}) & {mask}L) - {OFFSET}L, 0L)", "w_{0}")
        return f"CAST(greatest(0L, least(255L, shiftright({total} + {1 << bits - 1}L, {bits}))) AS INT)"

    return spots.select("batch_id", "image_id", "y", "x", *(F.expr(level(shift)).alias(c) for c, shift in CHANNELS.items()))


def resize_pixels(pixels: DataFrame, images: DataFrame, targets: DataFrame) -> DataFrame:
    """Resample each image to its ``target_width`` x ``target_height``; equal sizes pass through.

    ``targets`` has one row per image. Pixels travel once to become lines, lines once to become blocks; nothing is multiplied
    by the number of taps.
    """
    sizes = images.join(targets, "image_id").select(
        "image_id", F.col("width").alias("sw"), F.col("height").alias("sh"),
        F.col("target_width").cast("int").alias("tw"), F.col("target_height").cast("int").alias("th"),
    )
    rows = join_images(pixels.select("batch_id", "image_id", "y", "x", "r", "g", "b"), sizes)
    same = (F.col("sw") == F.col("tw")) & (F.col("sh") == F.col("th"))
    untouched = rows.filter(same).select("batch_id", "image_id", "y", "x", "r", "g", "b")
    wanted = ~same & (F.col("tw") > 0) & (F.col("th") > 0)
    taps = tap_table(sizes.filter(wanted).select(F.col("sw").alias("src"), F.col("tw").alias("dst")))
    keys = ["batch_id", "image_id", "sw", "tw", "sh", "th"]
    lines = packed_lines(rows.filter(wanted), keys)
    return untouched.unionByName(_down(_across(lines, taps), keys))
