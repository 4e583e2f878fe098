"""Nearest and farthest colours by cells of the colour cube.

Comparing every colour of a batch with every palette colour would emit all pairs of a group. Both sides are gathered
into cells of 16 colours a side instead, each one row with its colours and the tight box around them. A batch has
at most 4,096 cells, so all boxes of its palette are one short array, its outline. With squared distances:

* ``upper`` = least of the largest distances from a cell's box to a box of the outline. Every colour of the cell has a
  palette colour at most that far, so palette cells and colours whose least distance exceeds it are left out.
  What remains travels to the cell, and the same cut is made again for its blocks of 8 and of 4 colours a side.
* For the farthest search each cell carries one allowed colour; the least distance from it to the outline
  bounds the batch's optimum from below, and cells whose ``upper`` is under the best such bound are left out.

Distances are whole numbers, so both cuts are exact and ties survive them. Rows are dealt by (batch, cell): a batch
holding most of the rows is spread over its cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from frameops.functions.color import is_muted
from frameops.functions.region import computed_once
from frameops.session import wide

CELL = 4                # bits of a channel inside a cell
BLOCKS = (3, 2)         # and inside the blocks that a cell is parted into, one after the other
CHANNELS = {"r": 16, "g": 8, "b": 0}
BOX = [f"{name}_{c}" for name in ("mid", "half") for c in CHANNELS]
#: Distances are kept above 24 bits that hold the colour they belong to, so that the least one names the smallest colour.
KEY = 1 << 24

# Expressions as SQL text: there are many, and text is read in one go. Coordinates are doubles, exact for whole numbers of this size.


def _part(value: str, channel: str) -> str:
    return f"CAST(shiftright({value}, {CHANNELS[channel]}) & 255 AS DOUBLE)"


def _cell(value: str, bits: int) -> str:
    """Number of the cube of ``2**bits`` colours a side that holds a colour: its smallest colour."""
    mask = 255 >> bits << bits
    return f"({value} & {mask << 16 | mask << 8 | mask})"


def _apart(box: str, other: str, c: str) -> tuple[str, str]:
    """How far the middles of two boxes are apart in a channel, and the sum of their half sides. Boxes are prefixes of columns or fields."""
    return f"abs({other}mid_{c} - {box}mid_{c})", f"({box}half_{c} + {other}half_{c})"


def _point_apart(color: str, c: str) -> tuple[str, str]:
    """The same for this row's box and a packed colour."""
    return f"abs({_part(color, c)} - mid_{c})", f"half_{c}"


def _least(apart: list[tuple[str, str]]) -> str:
    """Squared least distance between two boxes."""
    return " + ".join(f"pow(greatest(0D, {middles} - {sides}), 2D)" for middles, sides in apart)


def _largest(apart: list[tuple[str, str]]) -> str:
    """Squared largest distance between two boxes."""
    return " + ".join(f"pow({middles} + {sides}, 2D)" for middles, sides in apart)


BOXES = [_apart("", "p.", c) for c in CHANNELS]
COLORS = [_point_apart("p", c) for c in CHANNELS]


def _boxed(value: str = "value") -> list:
    """Aggregates for the tight box around colours."""
    ends = {c: (f"min({_part(value, c)})", f"max({_part(value, c)})") for c in CHANNELS}
    mids = [F.expr(f"({low} + {high}) / 2").alias(f"mid_{c}") for c, (low, high) in ends.items()]
    return mids + [F.expr(f"({high} - {low}) / 2").alias(f"half_{c}") for c, (low, high) in ends.items()]


def _cells(colors: DataFrame) -> DataFrame:
    """Distinct ``(batch_id, value)`` rows by cell: box and colours, at most 4,096 of them."""
    # known to be present, so that no reader of the cells adds a filter of its own and all share one exchange
    present = colors.filter("batch_id IS NOT NULL AND value IS NOT NULL").selectExpr(
        "coalesce(batch_id, 0L) AS batch_id", "coalesce(value, 0) AS value")
    return _dealt(present.withColumn("cell", F.expr(_cell("value", CELL))), "batch_id", "cell").groupBy("batch_id", "cell").agg(
        *_boxed(), F.collect_list("value").alias("colors"))


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by their keys over the whole cluster: they are few, but each is searched for long."""
    return rows.repartition(wide(rows.sparkSession), *keys)


def _outline(palette_cells: DataFrame) -> DataFrame:
    """All boxes of a batch's palette: one row per batch, at most 4,096 boxes."""
    return _dealt(palette_cells.select("batch_id", "cell", *BOX), "batch_id").groupBy("batch_id").agg(
        F.collect_list(F.struct("cell", *BOX)).alias("outline"))


def _measured(rows: DataFrame, keys: list[str], **aggregates: str) -> DataFrame:
    """``upper`` of every box from its batch's outline, and further aggregates over the outline's boxes ``p``."""
    pairs = rows.withColumn("p", F.explode("outline")).drop("outline")
    kept = [F.first(name).alias(name) for name in BOX]
    return pairs.groupBy(*keys).agg(*kept, F.expr(f"min({_largest(BOXES)})").alias("upper"), *(F.expr(e).alias(n) for n, e in aggregates.items()))


def _reached(measured: DataFrame, outline: DataFrame, on: list[str]) -> DataFrame:
    """One row per box and palette cell ``near`` that may hold the nearest colour of some colour in it."""
    pairs = measured.join(outline, on).withColumn("p", F.explode("outline")).drop("outline")
    return pairs.filter(f"{_least(BOXES)} <= upper").withColumn("near", F.col("p.cell")).drop("p")


def _candidates(reached: DataFrame, palette_cells: DataFrame, keys: list[str]) -> DataFrame:
    """Per cell, given by ``keys``, the colours of the palette cells ``near`` it that are within reach of its box."""
    far_side = palette_cells.select("batch_id", F.col("cell").alias("near"), "colors")
    found = reached.join(far_side, ["batch_id", "near"]).withColumn("colors", F.expr(f"filter(colors, p -> {_least(COLORS)} <= upper)"))
    return _dealt(found.select(*keys, "colors"), "batch_id", "cell").groupBy(*keys).agg(
        F.flatten(F.collect_list("colors")).alias("candidates"))


def _in_block(rows: DataFrame, bits: int) -> DataFrame:
    """The box of ``block`` (its smallest colour), and those of the row's candidates within reach of it."""
    half = ((1 << bits) - 1) / 2
    mids = {f"mid_{c}": F.expr(f"{_part('block', c)} + {half}D") for c in CHANNELS}
    return _nearer(rows.withColumns(mids).withColumns({f"half_{c}": F.lit(half) for c in CHANNELS}))


def _nearer(rows: DataFrame) -> DataFrame:
    """Only those of the row's ``candidates`` that are within reach of its box, and how far that is: ``upper``."""
    upper = f"array_min(transform(candidates, p -> {_largest(COLORS)}))"
    near = f"transform(array({upper}), upper -> named_struct('upper', upper, 'near', filter(candidates, p -> {_least(COLORS)} <= upper)))[0]"
    return rows.withColumn("reach", computed_once(F.expr(near))).withColumns(
        {"candidates": F.col("reach.near"), "upper": F.col("reach.upper")}).drop("reach")


def _best(rows: DataFrame) -> DataFrame:
    """Adds ``best``: the least squared distance from ``value`` to a candidate, times ``KEY``, plus the smallest candidate that far away."""
    own = rows.withColumns({f"mid_{c}": F.expr(_part("value", c)) for c in CHANNELS})
    square = " + ".join(f"pow({_part('p', c)} - mid_{c}, 2D)" for c in CHANNELS)
    return own.withColumn("best", computed_once(F.expr(f"CAST(array_min(transform(candidates, p -> ({square}) * {KEY} + p)) AS BIGINT)")))


def nearest(queries: DataFrame, palette: DataFrame) -> DataFrame:
    """``(batch_id, value, near, dist2)`` for distinct ``(batch_id, value)`` queries."""
    asked, known = _cells(queries), _cells(palette)
    # every batch goes in slices by red, to sixteen copies of its outline
    outlines = _outline(known).withColumn("slice", F.expr("explode(sequence(0, 240, 16))"))
    sliced = asked.drop("colors").withColumn("slice", F.expr("shiftright(cell, 16)"))
    outlines, on = _dealt(outlines, "batch_id", "slice"), ["batch_id", "slice"]
    measured = _measured(_dealt(sliced, *on).join(outlines, on), [*on, "cell"])
    reached = _reached(measured, outlines, on)
    rows = _nearer(asked.join(_candidates(reached, known, ["batch_id", "cell"]), ["batch_id", "cell"]))
    for bits in BLOCKS:
        corner = _cell("v", bits)
        parted = rows.withColumn("block", F.expr(f"explode(array_distinct(transform(colors, v -> {corner})))"))
        rows = _in_block(parted.withColumn("colors", F.expr(f"filter(colors, v -> {corner} = block)")), bits)
    found = _best(rows.withColumn("value", F.explode("colors")))
    return found.selectExpr("batch_id", "value", f"CAST(best % {KEY} AS INT) AS near", f"CAST(best DIV {KEY} AS INT) AS dist2")


def allowed_colors(spark: SparkSession, max_brightness: int, min_sat: float, max_sat: float) -> DataFrame:
    """Allowed colours of the cube, from the limits alone: at most 256 cubed rows."""
    side = max_brightness + 1
    cube = spark.range(side ** 3).selectExpr(
        f"CAST(id DIV {side * side} AS INT) AS r", f"CAST(id DIV {side} % {side} AS INT) AS g", f"CAST(id % {side} AS INT) AS b"
    )
    allowed = cube.filter(is_muted(F.col("r"), F.col("g"), F.col("b"), max_brightness, min_sat, max_sat))
    return allowed.selectExpr("(shiftleft(r, 16) | shiftleft(g, 8) | b) AS value")


def _allowed_cells(spark: SparkSession, limits: tuple) -> DataFrame:
    """Cells that hold allowed colours, each with its box and the allowed colour nearest to its middle."""
    middle = (1 << CELL) // 2
    away = " + ".join(f"pow({_part('value', c)} - {_part(_cell('value', CELL), c)} - {middle}, 2D)" for c in CHANNELS)
    return allowed_colors(spark, *limits).groupBy(F.expr(_cell("value", CELL)).alias("cell")).agg(
        *_boxed(), F.expr(f"min(struct({away} AS away, value)).value").alias("pick"))


def _grid(step: int, n: int) -> str:
    """Rows for the places of an ``n`` by ``n`` by ``n`` grid, ``step`` colours apart, as packed colours."""
    red, green, blue = (f"CAST(i DIV {n ** k} % {n} * {step} AS INT)" for k in (2, 1, 0))
    return f"explode(transform(sequence(0, {n ** 3 - 1}), i -> shiftleft({red}, 16) | shiftleft({green}, 8) | {blue}))"


def farthest(palette: DataFrame, max_brightness: int, min_sat: float, max_sat: float) -> DataFrame:
    """``(batch_id, value, dist2)``: per batch the allowed colour farthest from its palette.

    ``palette`` holds distinct ``(batch_id, value)`` rows. No rows come back when nothing is allowed.
    """
    limits = (max_brightness, min_sat, max_sat)
    known = _cells(palette)
    # proven bound: 4,096 rows
    places = F.broadcast(_allowed_cells(palette.sparkSession, limits))
    corners = F.expr(_grid(1 << CELL, 1 + (max_brightness >> CELL)))
    outline = _outline(known)
    pick = [(f"abs(p.mid_{c} - {_part('pick', c)})", f"p.half_{c}") for c in CHANNELS]
    measured = _measured(outline.withColumn("cell", corners).join(places, "cell"), ["batch_id", "cell"], sure=f"min({_least(pick)})")
    # a batch's cells lie together already, at most 4,096 of them
    best = measured.groupBy("batch_id").agg(F.collect_list(F.struct("cell", *BOX, "upper")).alias("cells"), F.max("sure").alias("bound"))
    left = best.selectExpr("batch_id", "bound", "explode(filter(cells, c -> c.upper >= bound)) AS c").select("batch_id", "bound", "c.*")
    reached = _reached(left, outline, ["batch_id"])
    rows = _nearer(_candidates(reached, known, ["batch_id", "bound", "cell", *BOX]))
    above, corner = CELL, "cell"
    for bits in BLOCKS:
        parted = rows.filter("upper >= bound").withColumn("spot", F.expr(_grid(1 << bits, 1 << above - bits)))
        rows = _in_block(parted.withColumn("block", F.expr(f"{corner} | spot")), bits)
        above, corner = bits, "block"
    points = rows.filter("upper >= bound").withColumn("spot", F.expr(_grid(1, 1 << above))).withColumn("value", F.expr("block | spot"))
    r, g, b = (F.expr(_part("value", c)) for c in CHANNELS)
    allowed = points.filter((F.greatest(r, g, b) <= max_brightness) & is_muted(r, g, b, *limits))
    distances = _best(allowed).selectExpr("batch_id", "value", f"CAST(best DIV {KEY} AS INT) AS dist2")
    return (
        distances.groupBy("batch_id").agg(F.expr("max(struct(dist2, -value AS opposite))").alias("best"))
        .selectExpr("batch_id", "-best.opposite AS value", "best.dist2")
    )
