"""Filling closed paths into masks, one scan line at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from frameops.operators.runs import union_runs

#: Sequence numbers that are lined up together.
RUN = 10_000


def path_edges(polygons: DataFrame) -> DataFrame:
    """Directed edges of each path, the last point joined to the first.

    A point's successor is the next larger ``seq``, whatever the gap. Points are lined up in runs of ``RUN`` numbers, so a
    long path is no single sorted group; only the first point of every run is lined up per path.
    """
    point = F.struct("px", "py")
    runs = polygons.withColumn("_run", F.floor(F.col("seq") / RUN))
    firsts = runs.groupBy("poly_id", "_run").agg(F.min_by(point, "seq").alias("_first"))
    line = Window.partitionBy("poly_id").orderBy("_run")
    firsts = firsts.select("poly_id", "_run", F.lead("_first").over(line).alias("_after"))
    within = Window.partitionBy("poly_id", "_run").orderBy("seq")
    along = (
        runs.withColumn("_next", F.lead(point).over(within)).join(firsts, ["poly_id", "_run"])
        .withColumn("_next", F.coalesce("_next", "_after")).filter("_next is not null")
        .select("poly_id", F.col("px").alias("x1"), F.col("py").alias("y1"), F.col("_next.px").alias("x2"), F.col("_next.py").alias("y2"))
    )
    return along.unionByName(closing_edges(polygons))


def closing_edges(polygons: DataFrame) -> DataFrame:
    """The edge of each path from its last point to its first; of a single point, to itself."""
    point = F.struct("px", "py")
    return polygons.groupBy("poly_id").agg(
        F.max_by(point, "seq").alias("last"), F.min_by(point, "seq").alias("first")
    ).select("poly_id", F.col("last.px").alias("x1"), F.col("last.py").alias("y1"),
             F.col("first.px").alias("x2"), F.col("first.py").alias("y2"))


def stroke_runs(edges: DataFrame, dims: DataFrame, radius: float) -> DataFrame:
    """Runs of the pixels whose centres lie within ``radius`` of an edge: a straight stroke of a round brush.

    A scan line cuts a stroke in one stretch. Its ends follow from the two round caps and the four sides of the body; each is
    moved by one pixel at most, so that distances decide and not the rounding of the ends.
    """
    placed = edges.join(dims.select("poly_id", "width", "height"), "poly_id").selectExpr(
        "*", "x2 - x1 AS dx", "y2 - y1 AS dy", "nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0D) AS square")
    first = f"greatest(0, CAST(ceil(least(y1, y2) - {radius}D - 0.5D) AS INT))"
    last = f"least(height - 1, CAST(floor(greatest(y1, y2) + {radius}D - 0.5D) AS INT))"
    lines = placed.withColumn("y", F.expr(f"explode(CASE WHEN {first} <= {last} THEN sequence({first}, {last}) END)")).withColumn(
        "cy", F.expr("y + 0.5D"))

    def cap(x: str, y: str) -> list[str]:
        across = f"sqrt(greatest(0D, {radius * radius}D - (cy - {y}) * (cy - {y})))"
        return [f"CASE WHEN abs(cy - {y}) <= {radius}D THEN {x} {sign} {across} END" for sign in "-+"]

    def side(xa: str, ya: str, xb: str, yb: str) -> str:
        at = f"{xa} + (cy - ({ya})) / nullif(({yb}) - ({ya}), 0D) * (({xb}) - ({xa}))"
        return f"CASE WHEN (cy - ({ya})) * (cy - ({yb})) <= 0 THEN {at} END"

    # corners of the body: the ends moved by the radius at right angles to the edge
    corners = {f"{end}{sign}": (f"x{end} {sign} dy / sqrt(square) * {radius}D", f"y{end} {'-' if sign == '+' else '+'} dx / sqrt(square) * {radius}D")
               for end in "12" for sign in "+-"}
    sides = [side(*corners[a], *corners[b]) for a, b in (("1+", "2+"), ("1-", "2-"), ("1+", "1-"), ("2+", "2-"))]
    ends = F.expr(f"array_compact(array({', '.join([*cap('x1', 'y1'), *cap('x2', 'y2'), *sides])}))")
    cut = lines.withColumn("ends", ends).selectExpr(
        "*", "CAST(ceil(array_min(ends) - 0.5D) AS INT) AS low", "CAST(floor(array_max(ends) - 0.5D) AS INT) AS high")

    def touched(x: str) -> str:
        along = f"greatest(0D, least(1D, coalesce((({x} + 0.5D - x1) * dx + (cy - y1) * dy) / square, 0D)))"
        return (f"pow({x} + 0.5D - (x1 + {along} * dx), 2D) + pow(cy - (y1 + {along} * dy), 2D) <= {radius * radius}D")

    def nearest_touched(steps: list[str]) -> str:
        return "CASE " + " ".join(f"WHEN {touched(f'({x})')} THEN {x}" for x in steps) + " END"

    found = cut.selectExpr("poly_id", "width", "y", f"{nearest_touched(['low - 1', 'low', 'low + 1'])} AS x_first",
                           f"{nearest_touched(['high + 1', 'high', 'high - 1'])} AS x_last")
    return found.filter("x_first IS NOT NULL AND x_last IS NOT NULL").selectExpr("poly_id", "y", "greatest(0, x_first) AS x_from", "least(width, x_last + 1) AS x_to").filter("x_to > x_from")


def lasso_runs(polygons: DataFrame, dims: DataFrame, brush: float | None = None) -> DataFrame:
    """Filled runs of each path and, with the radius of a ``brush``, the stroke that closes it."""
    filled = _filled_runs(polygons, dims)
    if brush is None:
        return filled
    return union_runs(filled.unionByName(stroke_runs(closing_edges(polygons), dims, brush)), ("poly_id",))


def _filled_runs(polygons: DataFrame, dims: DataFrame) -> DataFrame:
    """Filled runs ``[x_from, x_to)`` of each scan line, by non-zero winding at pixel centres.

    An edge is cut by the scan lines between its ends. At each cut, the pixels left of it gain the edge's
    direction, so the winding number changes only at cuts: summing along a line gives the runs without
    testing a single pixel. Cuts beyond the frame count at its edge, so a line sums at most ``width + 1``
    places however long the path is. ``dims`` has ``poly_id``, ``width``, ``height``.
    """
    edges = path_edges(polygons).join(dims.select("poly_id", "width", "height"), "poly_id")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first = F.greatest(F.lit(0), F.ceil(low - 0.5).cast("int"))
    last = F.least(F.col("height") - 1, F.ceil(high - 0.5).cast("int") - 1)
    cuts = edges.filter(F.col("y1") != F.col("y2")).withColumn(
        "y", F.explode(F.when(first <= last, F.sequence(first, last)))
    )
    rise, run = F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")
    cy = F.col("y") + F.lit(0.5)
    up = F.col("y1") <= cy

    def gains(x):
        """Whether the pixel is on the side of the edge that gains its direction."""
        side = run * (cy - F.col("y1")) - (x + F.lit(0.5) - F.col("x1")) * rise
        return F.when(up, side > 0).otherwise(side < 0)

    guess = F.ceil(F.col("x1") + run * (cy - F.col("y1")) / F.nullif(rise, F.lit(0.0)) - 0.5)
    end = F.when(gains(F.col("guess")), F.col("guess") + 1).when(
        ~gains(F.col("guess") - 1), F.col("guess") - 1).otherwise(F.col("guess"))
    turns = (
        cuts.withColumn("guess", guess)
        .select("poly_id", "width", "y", F.greatest(F.lit(0), F.least(F.col("width"), end.cast("int"))).alias("x"),
                F.when(up, F.lit(1)).otherwise(F.lit(-1)).alias("turn"))
        .groupBy("poly_id", "width", "y", "x").agg(F.sum("turn").alias("turn"))
    )
    line = Window.partitionBy("poly_id", "y").orderBy("x")
    spans = turns.withColumns({
        "winding": F.sum("turn").over(line.rowsBetween(Window.unboundedPreceding, 0)),
        "next": F.lead("x").over(line),
    }).filter((F.col("winding") != 0) & F.col("next").isNotNull())
    return spans.select(
        "poly_id", "y", F.col("x").alias("x_from"), F.col("next").alias("x_to")
    )


def lasso_mask(polygons: DataFrame, dims: DataFrame, brush: float | None = None) -> DataFrame:
    """Filled positions of each path."""
    return lasso_runs(polygons, dims, brush).select(
        "poly_id", "y", F.explode(F.sequence(F.col("x_from"), F.col("x_to") - 1)).alias("x")
    )
