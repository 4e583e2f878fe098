import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from frameops.operators import geometry as G
from frameops.operators.lasso import lasso_mask
from frameops.operators.resize import resize_pixels, tap_table

PIXELS = "batch_id long, image_id long, y int, x int, r int, g int, b int"
IMAGES = "image_id long, batch_id long, width int, height int"


def picture(width, height, seed=0):
    return np.random.default_rng(seed).integers(0, 256, size=(height, width, 3))


def tables(spark, pictures, batch=1):
    pixels = [(batch, i, y, x, *map(int, p[y, x])) for i, p in pictures.items() for y in range(p.shape[0]) for x in range(p.shape[1])]
    images = [(i, batch, p.shape[1], p.shape[0]) for i, p in pictures.items()]
    return spark.createDataFrame(pixels, PIXELS), spark.createDataFrame(images, IMAGES)


def arrays(df):
    out = {}
    for r in df.collect():
        spots = out.setdefault(r.image_id, {})
        assert (r.y, r.x) not in spots
        spots[r.y, r.x] = (r.r, r.g, r.b)
    shaped = {}
    for i, spots in out.items():
        height, width = 1 + max(y for y, _ in spots), 1 + max(x for _, x in spots)
        assert len(spots) == height * width
        shaped[i] = np.array([[spots[y, x] for x in range(width)] for y in range(height)])
    return shaped


@pytest.mark.parametrize("degrees,turn", [(0, 0), (360, 0), (-360, 0), (90, -1), (-90, 1), (180, 2), (-180, 2), (270, 1)])
def test_quarter_turns(spark, degrees, turn):
    square = picture(5, 5)
    got = arrays(G.rotate_pixels(*tables(spark, {1: square}), degrees))[1]
    assert (got == np.rot90(square, turn)).all()


def rotated(source, degrees, fill):
    """Fixed-point nearest-neighbour rotation, position by position."""
    height, width = source.shape[:2]
    t = math.radians(degrees % 360)
    c, s = round(math.cos(t), 15), round(math.sin(t), 15)
    fix = lambda v: math.floor(v * 65536 + 0.5)
    out = np.empty_like(source)
    for y in range(height):
        for x in range(width):
            sx = (fix(-c * width / 2 - s * height / 2 + width / 2 + c / 2 + s / 2) + x * fix(c) + y * fix(s)) >> 16
            sy = (fix(s * width / 2 - c * height / 2 + height / 2 - s / 2 + c / 2) + x * fix(-s) + y * fix(c)) >> 16
            out[y, x] = source[sy, sx] if 0 <= sx < width and 0 <= sy < height else fill
    return out


@pytest.mark.parametrize("degrees", [-137, 7, 30, 45, 89, 90, 91, 200, 314])
def test_any_turn_covers_the_canvas(spark, degrees):
    pictures = {1: picture(9, 6, 1), 2: picture(3, 2, 2), 3: picture(3, 3, 3), 4: picture(40, 1, 4)}
    got = arrays(G.rotate_pixels(*tables(spark, pictures), degrees, "#0A0B0C"))
    for i, source in pictures.items():
        assert (got[i] == rotated(source, degrees, (10, 11, 12))).all()


def test_rotation_without_broadcast(no_broadcast):
    source = picture(8, 5)
    assert (arrays(G.rotate_pixels(*tables(no_broadcast, {1: source}), 33))[1] == rotated(source, 33, (0, 0, 0))).all()


@pytest.mark.parametrize("size", [(7, 9), (3, 2), (4, 11), (6, 4)])
def test_fit_pads_and_crops(spark, size):
    source, (width, height) = picture(6, 5), size
    got = arrays(G.fit_to_size(*tables(spark, {1: source}), width, height, "#010203"))[1]
    left, top = (width - 6) // 2, (height - 5) // 2
    for y in range(height):
        for x in range(width):
            sy, sx = y - top, x - left
            want = source[sy, sx] if 0 <= sy < 5 and 0 <= sx < 6 else (1, 2, 3)
            assert (got[y, x] == want).all()


def test_crop_undoes_pad(spark):
    source = picture(6, 5)
    pixels, images = tables(spark, {1: source})
    padded = G.fit_to_size(pixels, images, 10, 9)
    grown = spark.createDataFrame([(1, 1, 10, 9)], IMAGES)
    assert (arrays(G.fit_to_size(padded, grown, 6, 5))[1] == source).all()


def posed(source, mask, fill, dw, dh, ox, oy, only):
    """The window cut around a mask, position by position."""
    ys, xs = np.nonzero(mask)
    width, height = max(1, xs.max() + 1 - xs.min() + dw), max(1, ys.max() + 1 - ys.min() + dh)
    x0, y0 = xs.min() - dw // 2 - ox, ys.min() - dh // 2 - oy
    out = np.empty((height, width, 3), dtype=int)
    for y in range(height):
        for x in range(width):
            sy, sx = y + y0, x + x0
            inside = 0 <= sy < source.shape[0] and 0 <= sx < source.shape[1]
            out[y, x] = source[sy, sx] if inside and (mask[sy, sx] or not only) else fill
    return out


@pytest.mark.parametrize("only", [False, True])
@pytest.mark.parametrize("change", [(0, 0, 0, 0), (5, -3, 4, -2), (-3, 7, -1, 2), (-99, -99, 0, 0), (1, 1, 50, 0)])
def test_pose(spark, only, change):
    source, mask = picture(8, 6), np.zeros((6, 8))
    mask[2:4, 3:6], mask[3, 4] = 0.51, 0.5
    pixels, images = tables(spark, {1: source, 2: picture(8, 6, 5)})
    members = [(1, k, y, x, float(mask[y, x]) if k == (y + x) % 2 else 0.0) for k in (0, 1) for y in range(6) for x in range(8)]
    masks = spark.createDataFrame(members, "batch_id long, mask_idx long, y int, x int, m double")
    got = arrays(G.pose_setup(pixels, images, masks, "#070809", *change, only_fill=only))
    assert (got[1] == posed(source, mask > 0.5, (7, 8, 9), *change, only)).all()
    assert got[2].shape == got[1].shape


@pytest.mark.parametrize("change", [(0, 0, 0, 0), (40, 3, 70, -1)])
def test_pose_across_words(no_broadcast, change):
    source = picture(150, 3)
    mask = (np.random.default_rng(3).random((3, 150)) > 0.6).astype(float)
    pixels, images = tables(no_broadcast, {1: source, 2: source[:, ::-1]})
    masks = no_broadcast.createDataFrame([(1, 0, y, x, float(mask[y, x])) for y in range(3) for x in range(150)],
                                         "batch_id long, mask_idx long, y int, x int, m double")
    got = arrays(G.pose_setup(pixels, images, masks, "#070809", *change, only_fill=True))
    assert (got[1] == posed(source, mask > 0.5, (7, 8, 9), *change, True)).all()
    assert (got[2] == posed(source[:, ::-1], mask > 0.5, (7, 8, 9), *change, True)).all()


def test_pose_without_and_with_empty_mask(spark):
    source = picture(4, 3)
    pixels, images = tables(spark, {1: source})
    none = spark.createDataFrame([], "batch_id long, mask_idx long, y int, x int, m double")
    empty = spark.createDataFrame([(1, 0, y, x, 0.5) for y in range(3) for x in range(4)], none.schema)
    for only in (False, True):
        whole = arrays(G.pose_setup(pixels, images, none, "#000000", 2, 2, only_fill=only))[1]
        assert (whole == posed(source, np.ones((3, 4)), (0, 0, 0), 2, 2, 0, 0, only)).all()
        assert (arrays(G.pose_setup(pixels, images, empty, "#000000", 2, 2, only_fill=only))[1] == source).all()


def test_fill_channels(spark):
    df = spark.createDataFrame([(n, [1, 2, 3]) for n in range(1, 7)], "n int, rgb array<int>")
    got = [r.fill for r in G.fill_channels(df, "n", "rgb").orderBy("n").collect()]
    assert got == [[1], [1, 2], [1, 2, 3], [1, 2, 3, 3], [1, 2, 3, 3, 3], [1, 2, 3, 3, 3, 3]]


def test_levels_survive_the_round_trip(spark):
    df = spark.createDataFrame([(k, k) for k in range(256)], "k int, v int")
    back = G.quantize_pixels(G.dequantize_pixels(df, ["v"]), ["v"])
    assert all(r.k == r.v for r in back.collect())
    clipped = G.quantize_pixels(spark.createDataFrame([(-0.5,), (1.5,), (0.999,)], "v double"), ["v"], clip=True)
    assert [r.v for r in clipped.collect()] == [0, 255, 254]


# Resampling

def resampled(source, width, height):
    """Integer-weight resampling with plain loops."""
    def axis(src, dst):
        weights = np.zeros((dst, src), dtype=np.int64)
        for o in range(dst):
            at = np.float32((o + 0.5) * (src / dst) - 0.5)
            base = math.floor(at)
            part = float(np.float32(at - np.float32(base)))
            raw = [math.sin(math.pi * d) * math.sin(math.pi * d / 4) * 4 / (math.pi * d) ** 2 if abs(d) >= 1e-6 else 1.0
                   for d in (part + 3 - i for i in range(8))]
            for i, w in enumerate(raw):
                weights[o, min(max(base - 3 + i, 0), src - 1)] += round(w / sum(raw) * 2048)
        return weights
    full = np.einsum("ox,yxc->yoc", axis(source.shape[1], width), source)
    full = np.einsum("oy,yxc->oxc", axis(source.shape[0], height), full)
    return np.clip((full + (1 << 21)) >> 22, 0, 255)


def resize(spark, pictures, sizes):
    pixels, images = tables(spark, pictures)
    targets = spark.createDataFrame([(i, *wh) for i, wh in sizes.items()], "image_id long, target_width int, target_height int")
    return arrays(resize_pixels(pixels, images, targets))


def test_resize_matches_loops(spark):
    pictures = {1: picture(9, 7, 1), 2: picture(16, 16, 2), 3: picture(5, 4, 3), 4: picture(1, 1, 4)}
    sizes = {1: (16, 8), 2: (8, 24), 3: (5, 4), 4: (8, 8)}
    got = resize(spark, pictures, sizes)
    for i, size in sizes.items():
        want = pictures[i] if i == 3 else resampled(pictures[i], *size)
        assert (got[i] == want).all()


def test_resize_keeps_constants_and_ramps(spark):
    ramp = np.repeat(np.arange(0, 240, 10)[None, :, None], 3, axis=2).repeat(6, axis=0)
    got = resize(spark, {1: np.full((5, 7, 3), 200), 2: ramp}, {1: (24, 16), 2: (48, 8)})
    assert (got[1] == 200).all()
    inner = got[2][:, 12:-12, 0]
    assert (np.diff(inner, axis=1) >= 4).all() and (np.diff(inner, axis=1) <= 6).all()


def test_resize_without_broadcast(no_broadcast):
    source = picture(6, 5)
    assert (resize(no_broadcast, {1: source}, {1: (8, 16)})[1] == resampled(source, 8, 16)).all()


def test_resize_far_and_in_many_blocks(spark):
    """Sizes of several blocks of lines, twenty times smaller and larger, single lines and columns."""
    pictures = {1: picture(90, 140, 1), 2: picture(3, 100, 2), 3: picture(100, 3, 3), 4: picture(1, 50, 4), 5: picture(33, 1, 5)}
    sizes = {1: (4, 7), 2: (60, 70), 3: (5, 65), 4: (3, 200), 5: (40, 33)}
    got = resize(spark, pictures, sizes)
    for i, size in sizes.items():
        assert (got[i] == resampled(pictures[i], *size)).all(), i


def test_missing_pixels_count_as_black(spark):
    source = picture(6, 5)
    pixels, images = tables(spark, {1: source})
    source[2, 3] = source[4, 1] = 0
    targets = spark.createDataFrame([(1, 9, 7)], "image_id long, target_width int, target_height int")
    got = arrays(resize_pixels(pixels.filter("NOT (y = 2 AND x = 3) AND NOT (y = 4 AND x = 1)"), images, targets))
    assert (got[1] == resampled(source, 9, 7)).all()


def test_taps_cover_every_output(spark):
    sizes = spark.createDataFrame([(7, 24), (24, 7), (1, 8)], "src int, dst int")
    for src, dst in ((7, 24), (24, 7), (1, 8)):
        total = {}
        for r in tap_table(sizes).filter(f"src = {src} AND dst = {dst}").collect():
            assert len(r.taps) == 8 and all(0 <= t.at < src for t in r.taps)
            total[r.to] = sum(t.w for t in r.taps)
        assert set(total) == set(range(dst)) and all(abs(w - 2048) <= 4 for w in total.values())


# Lasso

def winding_fill(path, width, height):
    filled = set()
    for y in range(height):
        for x in range(width):
            cx, cy, winding = x + 0.5, y + 0.5, 0
            for (x1, y1), (x2, y2) in zip(path, path[1:] + path[:1]):
                side = (x2 - x1) * (cy - y1) - (cx - x1) * (y2 - y1)
                winding += (y1 <= cy < y2 and side > 0) - (y2 <= cy < y1 and side < 0)
            if winding:
                filled.add((y, x))
    return filled


coordinate = st.integers(-12, 60).map(lambda v: v / 4)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.tuples(coordinate, coordinate), min_size=1, max_size=9), min_size=1, max_size=12))
def test_lasso_matches_winding(spark, paths):
    points = [(i, k, float(x), float(y)) for i, path in enumerate(paths) for k, (x, y) in enumerate(path)]
    polygons = spark.createDataFrame(points, "poly_id long, seq int, px double, py double")
    dims = spark.createDataFrame([(i, 12, 10) for i in range(len(paths))], "poly_id long, width int, height int")
    got = {}
    for r in lasso_mask(polygons, dims).collect():
        assert (r.y, r.x) not in got.setdefault(r.poly_id, set())
        got[r.poly_id].add((r.y, r.x))
    for i, path in enumerate(paths):
        assert got.get(i, set()) == winding_fill(path, 12, 10)


def test_a_null_level_stays_null(spark):
    df = spark.createDataFrame([(None,), (0.5,), (2.0,), (-1.0,)], "m double")
    assert [r.m for r in G.quantize_pixels(df, ["m"], clip=True).collect()] == [None, 127, 255, 0]


def test_gaps_in_a_path_lose_no_edge(spark):
    corners = [(10.0, 1.0), (18.0, 9.0), (10.0, 17.0), (2.0, 9.0)]
    dims = spark.createDataFrame([(1, 24, 20), (2, 24, 20)], "poly_id long, width int, height int")
    rows = [(1, i, *c) for i, c in enumerate(corners)] + [(2, i * i * 7000, *c) for i, c in enumerate(corners)]
    got = lasso_mask(spark.createDataFrame(rows, "poly_id long, seq int, px double, py double"), dims)
    one, two = ({(r.y, r.x) for r in got.filter(f"poly_id = {p}").collect()} for p in (1, 2))
    assert one == two and len(one) == 128


def test_pixels_of_unknown_images_are_reported(spark):
    pixels = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "image_id long, x int")
    images = spark.createDataFrame([(2,)], "image_id long")
    assert [tuple(r) for r in G.orphan_pixels(pixels, images).collect()] == [(1, 2)]


def stroke(a, b, radius, width, height):
    """Pixels whose centres are within the radius of a segment."""
    touched, (x1, y1), (x2, y2) = set(), a, b
    square = (x2 - x1) ** 2 + (y2 - y1) ** 2
    for y in range(height):
        for x in range(width):
            along = max(0.0, min(1.0, ((x + 0.5 - x1) * (x2 - x1) + (y + 0.5 - y1) * (y2 - y1)) / square)) if square else 0.0
            if (x + 0.5 - x1 - along * (x2 - x1)) ** 2 + (y + 0.5 - y1 - along * (y2 - y1)) ** 2 <= radius ** 2:
                touched.add((y, x))
    return touched


@pytest.mark.parametrize("radius", [0.25, 0.5, 1.0, 2.5, 30.0])
def test_closing_stroke(spark, radius):
    rng = np.random.default_rng(int(radius * 4))
    paths = [[tuple((rng.integers(-20, 140, 2) / 4).tolist()) for _ in range(n)] for n in (1, 2, 2, 3, 5, 8)]
    paths += [[(3.0, 4.0), (20.0, 4.0)], [(3.5, 4.5), (3.5, 15.5)], [(5.0, 5.0), (5.0, 5.0)], [(-9.0, -9.0), (-8.0, -30.0)]]
    width, height = 30, 25
    points = spark.createDataFrame([(k, i, float(x), float(y)) for k, path in enumerate(paths) for i, (x, y) in enumerate(path)],
                                   "poly_id long, seq int, px double, py double")
    dims = spark.createDataFrame([(k, width, height) for k in range(len(paths))], "poly_id long, width int, height int")
    got = {k: set() for k in range(len(paths))}
    for r in lasso_mask(points, dims, brush=radius).collect():
        assert (r.y, r.x) not in got[r.poly_id]
        got[r.poly_id].add((r.y, r.x))
    for k, path in enumerate(paths):
        assert got[k] == winding_fill(path, width, height) | stroke(path[-1], path[0], radius, width, height), (k, path)
