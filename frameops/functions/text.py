"""Text to number, with the rules scripting-language integers follow."""

from pyspark.sql import Column, functions as F

# Code points counted as white space at either end of a text.
WHITE = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)))
EDGE = f"[{WHITE}]*"
# Optional sign, digits, single underscores between digits.
INTEGER = f"^{EDGE}[+-]?[0-9]+(_[0-9]+)*{EDGE}$"
PLAIN_INTEGER = r"^ *[+-]?[0-9]+ *$"


def int_text(text: Column) -> Column:
    """``text`` as bigint, null where it is not an integer or does not fit.

    The cast itself copes with spaces, so only unusual integers are trimmed and cleaned.
    """
    unusual = F.replace(F.btrim(text, F.lit(WHITE)), F.lit("_"), F.lit(""))
    return F.when(text.rlike(PLAIN_INTEGER), text).when(text.rlike(INTEGER), unusual).try_cast("bigint")


def int_param(text: Column, default: int, minimum: int | None = None, maximum: int | None = None) -> Column:
    """A text parameter as integer: unparsable gives the default, then the bounds apply."""
    value = F.coalesce(int_text(text), F.lit(default).cast("bigint"))
    if minimum is not None:
        value = F.greatest(value, F.lit(minimum).cast("bigint"))
    if maximum is not None:
        value = F.least(value, F.lit(maximum).cast("bigint"))
    return value
