"""Rows for every position of a rectangle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from frameops.session import wide


def _upto(size: Column) -> Column:
    return F.sequence(F.lit(0), size.cast("int") - 1)


def lattice(df: DataFrame, width: str | Column, height: str | Column, y: str = "y", x: str = "x") -> DataFrame:
    """One row per position ``(y, x)`` of each input row's rectangle.

    Lines are dealt over the cluster before they expand into positions, so neither many small
    rectangles in one input partition nor a single huge one ends in a single task.
    """
    width = F.col(width) if isinstance(width, str) else width
    height = F.col(height) if isinstance(height, str) else height
    lines = df.filter((width > 0) & (height > 0)).withColumn(y, F.explode(_upto(height)))
    lines = lines.repartition(wide(df.sparkSession), *lines.columns)
    return lines.withColumn(x, F.explode(_upto(width)))
