"""Masks as runs: per line the stretches ``[x_from, x_to)`` that are selected.

A run table has ``batch_id, y, x_from, x_to`` and may have more keys. A run with ``x_from = x_to`` selects nothing; it says
that there is a mask. So a mask of any size moves as its outline, not as a row per position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from frameops.session import wide

KEYS = ("batch_id",)


def mask_words(mask_pixels: DataFrame, selected: Column, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Selected positions as bits: one row per 64 positions of a line that holds any, combined before the exchange."""
    return mask_pixels.filter(selected).groupBy(*keys, "y", F.shiftright("x", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, x & 63)")).alias("bits"))


def mask_runs(mask_pixels: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Runs of the positions where some mask of ``keys`` is above one half; an empty run for keys without any."""
    words = mask_words(mask_pixels, F.col("m") > 0.5, keys)

    def places(bits: str) -> str:
        return f"filter(sequence(0, 63), i -> shiftright({bits}, i) & 1 = 1)"

    ends = F.expr(f"arrays_zip({places('bits & ~shiftleft(bits, 1)')}, {places('bits & ~shiftrightunsigned(bits, 1)')})")
    inside = words.withColumn("run", F.explode(ends)).select(
        *keys, "y", (F.col("word") * 64 + F.col("run")["0"]).cast("int").alias("x_from"),
        (F.col("word") * 64 + F.col("run")["1"] + 1).cast("int").alias("x_to"))
    zero = F.lit(0)
    nothing = mask_pixels.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("m") > 0.5), F.lit(False)).alias("any")).filter("NOT any").select(
        *keys, zero.alias("y"), zero.alias("x_from"), zero.alias("x_to"))
    return _swept(inside, keys).unionByName(nothing)


def union_runs(runs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Runs that overlap or touch become one, per ``keys`` and line. Empty runs go, but for one where keys have no other.

    Runs that begin at the same place are combined before any exchange, so a line is swept over at most as many
    runs as it has positions, whatever the number of masks.
    """
    longest = runs.filter("x_to > x_from").groupBy(*keys, "y", "x_from").agg(F.max("x_to").alias("x_to"))
    empty = runs.groupBy(*keys).agg(F.max(F.col("x_to") > F.col("x_from")).alias("any"), F.min("y").alias("y")).filter("NOT any")
    return _swept(longest, keys).unionByName(empty.select(*keys, "y", F.lit(0).alias("x_from"), F.lit(0).alias("x_to")))


def _swept(runs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Runs that overlap or touch become one; none is empty and no two of a line begin at the same place."""
    line = Window.partitionBy(*keys, "y").orderBy("x_from")
    reach = F.max("x_to").over(line.rowsBetween(Window.unboundedPreceding, -1))
    opened = runs.withColumn("opens", F.coalesce(F.col("x_from") > reach, F.lit(True)).cast("int"))
    swept = opened.withColumn("island", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return swept.groupBy(*keys, "y", "island").agg(F.min("x_from").alias("x_from"), F.max("x_to").alias("x_to")).drop("island")


def run_words(runs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The same selection as bits, one row per 64 positions of a line that holds any."""
    words = runs.filter("x_to > x_from").withColumn("word", F.expr("explode(sequence(shiftright(x_from, 6), shiftright(x_to - 1, 6)))"))
    low, high = "greatest(x_from - word * 64, 0)", "least(x_to - word * 64, 64)"
    bits = F.expr(f"shiftleft(shiftrightunsigned(-1L, 64 - ({high} - {low})), {low})")
    return words.groupBy(*keys, "y", "word").agg(F.bit_or(bits).alias("bits"))


def with_bits(spots: DataFrame, words: DataFrame, how: str = "inner") -> DataFrame:
    """Add the ``bits`` of its word to each spot (``batch_id, y, word``), met in hash tables of words.

    Words expand from few images or runs. The optimiser takes them to be as small as those, and left to it, the words
    of all batches would be broadcast through the driver.
    """
    return spots.join(words.hint("shuffle_hash"), ["batch_id", "y", "word"], how)


def run_bbox(runs: DataFrame) -> DataFrame:
    """Half-open bounding box of the runs of every batch that selects anything."""
    return run_summary(runs).filter("any").drop("any")


def run_summary(runs: DataFrame) -> DataFrame:
    """One row per batch with a mask: whether ``any`` position is selected, and the box around those."""
    return _summary(runs, F.col("x_to") > F.col("x_from"), F.col("x_from"), F.col("x_to"))


def pixel_summary(mask_pixels: DataFrame) -> DataFrame:
    """The same from mask pixels, in one aggregation that leaves a row per batch before the exchange."""
    return _summary(mask_pixels, F.col("m") > 0.5, F.col("x"), F.col("x") + 1)


def _summary(rows: DataFrame, selected: Column, x_from: Column, x_to: Column) -> DataFrame:
    return rows.groupBy("batch_id").agg(
        F.coalesce(F.bool_or(selected), F.lit(False)).alias("any"),
        F.min(F.when(selected, x_from)).alias("min_x"), F.max(F.when(selected, x_to)).alias("max_x"),
        F.min(F.when(selected, F.col("y"))).alias("min_y"), F.max(F.when(selected, F.col("y") + 1)).alias("max_y"),
    )


def full_runs(frames: DataFrame) -> DataFrame:
    """A run over every line of ``frames`` (``batch_id, width, height``)."""
    lines = frames.filter("width > 0 AND height > 0").withColumn("y", F.expr("explode(sequence(0, height - 1))"))
    return lines.select("batch_id", "y", F.lit(0).alias("x_from"), F.col("width").alias("x_to"))


def spelt_out(runs: DataFrame, frames: DataFrame) -> DataFrame:
    """Every position of ``frames`` that have a mask, with ``selected``; runs are looked up as bits, 64 positions at once."""
    masked = frames.join(runs.select("batch_id").distinct(), "batch_id", "left_semi").filter("width > 0 AND height > 0")
    lines = masked.withColumn("y", F.expr("explode(sequence(0, height - 1))")).repartition(wide(runs.sparkSession), "batch_id", "y")
    words = lines.withColumn("word", F.expr("explode(sequence(0, shiftright(width - 1, 6)))"))
    # dealt again: the words of one batch meet by line, and are still to expand
    marked = with_bits(words, run_words(runs), "left").repartition(wide(runs.sparkSession), "batch_id", "y", "word")
    spots = marked.withColumn("x", F.expr("explode(sequence(word * 64, least(word * 64 + 63, width - 1)))"))
    return spots.select("batch_id", "y", "x", F.expr("coalesce(shiftright(bits, x & 63) & 1, 0) = 1").alias("selected"))
