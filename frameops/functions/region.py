"""Region expressions: payload text to region, region to frame."""

from pyspark.sql import Column, DataFrame, functions as F

from frameops.functions.text import int_text

SIDES = ("x", "y", "width", "height")


def _whole_number(document: Column, key: str) -> Column:
    """``key`` as bigint: numbers are cut toward zero, booleans are 0/1, integer texts count.

    An absent key is 0, anything else null.
    """
    path = f"$.{key}"
    number = F.coalesce(
        F.try_variant_get(document, path, "bigint"), int_text(F.try_variant_get(document, path, "string"))
    )
    absent = F.try_variant_get(document, path, "variant").isNull()
    return F.when(absent, F.lit(0).cast("bigint")).otherwise(number)


def computed_once(value: Column) -> Column:
    """Keeps the optimiser from copying a costly expression into every use of its result."""
    return F.explode(F.array(value))


def with_region(df: DataFrame, payload: str, or_empty: bool = False) -> DataFrame:
    """Add the ``region`` struct of a JSON payload.

    Absent, empty, non-object or unparsable payloads and objects holding a value that is no
    whole number give null, or the empty region with ``or_empty``; a missing key counts as 0.
    """
    filled = F.col(payload).rlike(r"^\s*\{") & ~F.col(payload).rlike(r"^\s*\{\s*\}\s*$")
    numbers = F.struct(*(_whole_number(F.col("_document"), key).alias(key) for key in SIDES))
    usable = F.col("_document").isNotNull() & filled
    for key in SIDES:
        usable = usable & F.col(f"_numbers.{key}").isNotNull()
    region = F.when(usable, F.col("_numbers"))
    if or_empty:
        region = F.coalesce(region, empty_region())
    return (
        df.withColumn("_document", computed_once(F.try_parse_json(F.col(payload))))
        .withColumn("_numbers", computed_once(numbers))
        .withColumn("region", region).drop("_document", "_numbers")
    )


def empty_region() -> Column:
    return F.struct(*(F.lit(0).cast("bigint").alias(k) for k in SIDES))


def clamp_region(region: Column, max_width: Column, max_height: Column) -> Column:
    """Region inside a frame: the corner moves first, then the size shrinks, nothing below 0; null where a size is unknown."""
    zero = F.lit(0).cast("bigint")
    w, h = max_width.cast("bigint"), max_height.cast("bigint")
    x = F.greatest(zero, F.least(region["x"], w - 1))
    y = F.greatest(zero, F.least(region["y"], h - 1))
    width = F.greatest(zero, F.least(region["width"], w - x))
    height = F.greatest(zero, F.least(region["height"], h - y))
    clamped = F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))
    return F.when(region.isNotNull() & w.isNotNull() & h.isNotNull(), clamped)
