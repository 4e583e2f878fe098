import colorsys

import pytest
from hypothesis import given, settings, strategies as st

from frameops.functions.color import parse_hex_literal
from frameops.operators import colors as C

INVALID = (0, "Invalid", "0, 0, 0")
EDGE = [
    ("3883558", (3883558, "#3B4226", "59, 66, 38")), ("255", (597, "#000255", "0, 2, 85")),
    ("#FFF", (4095, "#000FFF", "0, 15, 255")), ("+1234567", (1234567, "#12D687", "18, 214, 135")),
    ("1_000_000", (1000000, "#0F4240", "15, 66, 64")), ("1__000_000", INVALID), ("16777215", (16777215, "#FFFFFF", "255, 255, 255")),
    ("16777216", INVALID), ("-1", INVALID), ("0x1F", INVALID), ("", INVALID), (None, INVALID), ("#", INVALID),
    ("\t #abc  ", (2748, "#000ABC", "0, 10, 188")), ("00000000255", (255, "#0000FF", "0, 0, 255")),
    ("99999999999999999999", INVALID), ("-0", (0, "#000000", "0, 0, 0")), ("##12", INVALID), ("12.5", INVALID),
    ("\u3000255\u00a0", (597, "#000255", "0, 2, 85")), ("\x1c 1000000\n", (1000000, "#0F4240", "15, 66, 64")),
    ("\u20281_000_000\v", (1000000, "#0F4240", "15, 66, 64")), ("1 2", INVALID), ("+ 5", INVALID), ("_1000000", INVALID),
]


def test_standardize_edges(spark):
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(EDGE)], "i int, text string")
    got = {r.i: (r.value, r.hex, r.rgb) for r in C.color_standardize(df, "text").collect()}
    assert got == {i: want for i, (_, want) in enumerate(EDGE)}


def test_rejects_are_the_invalid_rows(spark):
    df = spark.createDataFrame([(text,) for text, _ in EDGE], "text string")
    report = {r.path: r.n_rows for r in C.color_reject_report(df, "text").collect()}
    assert report["invalid"] == C.color_rejects(df, "text").count() == sum(want == INVALID for _, want in EDGE)


def test_hex_pads_and_falls_back(spark):
    df = spark.createDataFrame([("#FFF",), ("junk",), (None,), (" 0a0B0c ",)], "t string")
    got = [(r.r, r.g, r.b) for r in C.hex_to_rgb(df, "t", (1, 2, 3)).collect()]
    assert got == [(0, 15, 255), (1, 2, 3), (1, 2, 3), (10, 11, 12)]
    assert [parse_hex_literal(t, (1, 2, 3)) for t in ("#FFF", "junk", None, " 0a0B0c ", "#")] == [*got, (1, 2, 3)]


def test_unpack_modes(spark):
    df = spark.createDataFrame([(0x010203,), (-1,), (1 << 24,)], "v long")
    assert [(r.r, r.g, r.b) for r in C.unpack_rgb24(df, "v", "drop").collect()] == [(1, 2, 3)]
    assert [r.r for r in C.unpack_rgb24(df, "v", "null").collect()] == [1, None, None]
    for failing in (C.unpack_rgb24(df, "v"), C.range24_filter(df, "v", "error"), C.format_color(df, "v")):
        with pytest.raises(Exception, match="16777215"):
            failing.collect()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 255)] * 3), min_size=1, max_size=200))
def test_hsv_and_packing(spark, colors):
    df = spark.createDataFrame(colors, "r int, g int, b int")
    for row in C.rgb_to_hsv(C.pack_rgb24(df)).collect():
        h, s, v = colorsys.rgb_to_hsv(row.r / 255, row.g / 255, row.b / 255)
        assert (row.h, row.s, row.v) == pytest.approx((h * 360, s, v), abs=1e-9)
    back = C.unpack_rgb24(C.pack_rgb24(df).select("value"), "value")
    assert sorted(tuple(r)[1:] for r in back.collect()) == sorted(colors)
