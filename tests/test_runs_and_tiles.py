import numpy as np
import pytest
from pyspark.sql import functions as F

from frameops.operators import geometry as G, regions as M, runs as R, tiles as T

MASK = "batch_id long, mask_idx long, y int, x int, m double"
RUN = "batch_id long, mask_idx long, y int, x_from int, x_to int"


SEEN = {}


def stage_totals(spark):
    """Rows read from files and rows written to exchanges, over all stages so far; Spark may have forgotten the first of them."""
    context, jvm = spark.sparkContext, spark._jvm
    none = context._gateway.new_array(context._gateway.jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, none, jvm.java.util.ArrayList())
    seen = SEEN.setdefault(context.applicationId, {})
    for s in (stages.apply(i) for i in range(stages.size())):
        seen[s.stageId(), s.attemptId()] = s.inputRecords(), s.shuffleWriteRecords()
    return tuple(map(sum, zip(*seen.values()))) or (0, 0)


def plain_runs(mask):
    found = []
    for y, line in enumerate(mask):
        edges = np.flatnonzero(np.diff(line.astype(np.int8), prepend=0, append=0))
        found += [(y, int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]
    return found


def mask_rows(batch, index, mask):
    return [(batch, index, y, x, float(v)) for y, line in enumerate(mask) for x, v in enumerate(line)]


@pytest.mark.parametrize("width", [1, 63, 64, 65, 200])
def test_runs_of_masks(spark, rows, width):
    rng = np.random.default_rng(width)
    members = [rng.random((5, width)) * (rng.random((5, width)) > 0.4) for _ in range(3)] + [np.ones((5, width)), np.zeros((5, width))]
    members[3][2] = 0
    df = spark.createDataFrame([r for b, parts in ((1, members[:3]), (2, members[3:4]), (3, members[4:])) for k, m in enumerate(parts)
                                for r in mask_rows(b, k, m)], MASK)
    got = rows(R.mask_runs(df), "batch_id", "y", "x_from", "x_to")
    united = np.max(members[:3], axis=0) > 0.5
    assert got == sorted([(1, *r) for r in plain_runs(united)] + [(2, y, 0, width) for y in (0, 1, 3, 4)] + [(3, 0, 0, 0)])
    single = R.union_runs(R.mask_runs(df, ("batch_id", "mask_idx")).drop("mask_idx"))
    assert rows(single, "batch_id", "y", "x_from", "x_to") == got
    frames = spark.createDataFrame([(b, width, 5) for b in (1, 2, 3, 4)], "batch_id long, width int, height int")
    assert rows(R.spelt_out(single, frames)) == rows(G.mask_union(df))
    assert rows(R.run_bbox(single)) == rows(G.mask_bbox(G.mask_union(df)))


def test_touching_overlapping_and_nested_runs(spark, rows):
    parts = [(0, 5), (5, 7), (9, 20), (10, 12), (15, 25), (30, 30), (31, 32)]
    df = spark.createDataFrame([(1, k, 3, a, b) for k, (a, b) in enumerate(parts)] + [(2, 0, 4, 0, 0), (2, 1, 9, 0, 0)], RUN)
    assert rows(R.union_runs(df)) == [(1, 3, 0, 7), (1, 3, 9, 25), (1, 3, 31, 32), (2, 4, 0, 0)]
    assert R.union_runs(df.limit(0)).collect() == []


def test_a_thousand_masks_shuffle_only_runs(spark):
    """Rectangles of half a 400 x 300 frame: 60,000 positions each, 150 runs."""
    runs = spark.range(1000).selectExpr("1L AS batch_id", "id AS mask_idx", "CAST(id % 150 AS INT) AS top", "CAST(id * 7 % 200 AS INT) AS x_from").selectExpr(
        "batch_id", "mask_idx", "explode(sequence(top, top + 149)) AS y", "x_from", "x_from + 200 AS x_to")
    before = stage_totals(spark)[1]
    united = R.union_runs(runs).collect()
    moved = stage_totals(spark)[1] - before
    want = np.zeros((300, 400), dtype=bool)
    for i in range(1000):
        want[i % 150: i % 150 + 150, i * 7 % 200: i * 7 % 200 + 200] = True
    assert sorted((r.y, r.x_from, r.x_to) for r in united) == plain_runs(want)
    assert 0 < moved <= 2 * 150 * 1000


def test_pose_from_runs(spark, rows):
    rng = np.random.default_rng(1)
    pixels = spark.createDataFrame([(b, b * 10 + k, y, x, y, x, k) for b in (1, 2, 3) for k in (0, 1) for y in range(9) for x in range(80)],
                                   "batch_id long, image_id long, y int, x int, r int, g int, b int")
    images = spark.createDataFrame([(b * 10 + k, b, 80, 9) for b in (1, 2, 3) for k in (0, 1)], "image_id long, batch_id long, width int, height int")
    mask = (rng.random((9, 80)) > 0.5).astype(float)
    mask[:, :20] = mask[:3] = 0
    masks = spark.createDataFrame(mask_rows(1, 0, mask) + mask_rows(2, 0, mask * 0), MASK)
    for only in (False, True):
        change = dict(width_change=3, height_change=-2, offset_x=5, offset_y=-1, only_fill=only)
        assert rows(G.pose_setup(pixels, images, R.mask_runs(masks), **change)) == rows(G.pose_setup(pixels, images, masks, **change))


def test_boxes_of_batches_with_and_without_masks(spark, rows):
    images = spark.createDataFrame([(1, 1, 8, 6), (1, 1, 8, 6), (2, 2, 8, 6), (3, 3, 8, 6), (4, 3, 9, 5), (5, None, 8, 6)],
                                   "image_id long, batch_id long, width int, height int")
    masks = spark.createDataFrame([(b, 0, y, x, 0.9 if b != 2 else 0.1) for b in (1, 2, 7, None) for y in (2, 3) for x in (4, 5)], MASK)
    for given in (masks, R.mask_runs(masks)):
        got = {tuple(r) for r in G.batch_bbox(given, images).collect()}
        assert got == {(1, 4, 6, 2, 4), (3, 0, 9, 0, 6), (None, 0, 8, 0, 6)}


@pytest.fixture(scope="module")
def tiled(spark, tmp_path_factory):
    """24 images of 60 x 60 in tiles of 6 x 6, 12 images to a zone."""
    tiling = T.Tiling(side=6, images=12)
    path = str(tmp_path_factory.mktemp("tiles") / "t")
    images = spark.range(24).selectExpr("id AS image_id", "id DIV 12 AS batch_id", "60 AS width", "60 AS height")
    pixels = images.selectExpr("batch_id", "image_id", "explode(sequence(0, 59)) AS y").selectExpr(
        "*", "explode(sequence(0, 59)) AS x").selectExpr("batch_id", "image_id", "y", "x", "y AS r", "x AS g", "CAST(image_id AS INT) AS b")
    T.write_tiles(pixels, path, tiling)
    return tiling, T.read_tiles(spark, path), pixels, images


def test_tiles_hold_all_pixels(tiled, rows):
    _, table, pixels, _ = tiled
    assert rows(table, *G.PIXEL) == rows(pixels)


def test_a_crop_reads_its_tiles_only(spark, tiled, rows):
    """A crop of one hundredth, the same for all images of a node: at most four of a hundred tiles are read."""
    tiling, table, pixels, images = tiled
    regions = images.selectExpr("image_id", "named_struct('x', 20L + batch_id, 'y', 33L, 'width', 6L, 'height', 6L) AS region")
    cropped = M.region_crop(T.touched(table, T.region_boxes(images, regions), tiling), images, regions)
    before = stage_totals(spark)[0]
    got = rows(cropped)
    read = stage_totals(spark)[0] - before
    assert got == rows(M.region_crop(pixels, images, regions)) and len(got) == 24 * 36
    assert 0 < read <= 0.05 * 24 * 3600


def test_images_cropped_elsewhere_and_not_at_all(tiled, rows):
    tiling, table, pixels, images = tiled
    regions = images.filter("image_id % 3 <> 0").selectExpr(
        "image_id", "named_struct('x', image_id * 3 - 5, 'y', 58 - image_id, 'width', image_id - 2, 'height', 9L) AS region")
    cropped = M.region_crop(T.touched(table, T.region_boxes(images, regions), tiling), images, regions)
    assert rows(cropped) == rows(M.region_crop(pixels, images, regions))


def test_pose_reads_its_window_only(spark, tiled, rows):
    tiling, table, pixels, images = tiled
    masks = spark.createDataFrame([(0, 0, y, x, 0.9) for y in (7, 8) for x in range(30, 34)], MASK)
    change = dict(width_change=2, offset_y=1)
    boxes = T.pose_boxes(images.filter("batch_id = 0"), masks, **change)
    before = stage_totals(spark)[0]
    some = images.filter("batch_id = 0")
    got = rows(G.pose_setup(T.touched(table, boxes, tiling), some, masks, **change))
    assert 0 < stage_totals(spark)[0] - before <= 0.1 * 24 * 3600
    assert got == rows(G.pose_setup(pixels.filter("batch_id = 0"), some, masks, **change))


def test_extra_columns_and_hidden_names_do_no_harm(tiled, rows):
    _, _, pixels, images = tiled
    odd = pixels.withColumns({name: F.lit(7) for name in ("zone", "mask_x", "_x", "word", "tile_y")})
    regions = images.limit(3).selectExpr("image_id", "named_struct('x', 1L, 'y', 2L, 'width', 3L, 'height', 4L) AS region")
    assert rows(M.region_crop(odd, images, regions)) == rows(M.region_crop(pixels, images, regions))
