import datetime as dt
import random

import pytest

from frameops.operators import masklog as E, regions as M
from frameops.sources import sinks

EDGE = [
    ('{"x":1,"y":2,"width":3,"height":4}', (1, 2, 3, 4)), ('{"x":5}', (5, 0, 0, 0)), ('{"y":"12"}', (0, 12, 0, 0)),
    ('{"x":"3.7"}', None), ('{"x":null}', None), ('{"x":true,"y":false}', (1, 0, 0, 0)), ('{"x":-3.7,"y":3.7}', (-3, 3, 0, 0)),
    ("[1]", None), ("not json", None), ("{}", None), (None, None), ("", None), ('{"other":1}', (0, 0, 0, 0)),
    ('{"x":[1]}', None), ('{"x":{}}', None), ('{"x":" +1_0 "}', (10, 0, 0, 0)), ("5", None), ('"text"', None), ("null", None),
    ('{"x":1e3}', (1000, 0, 0, 0)), ('{"x":5000000000}', (5000000000, 0, 0, 0)),
]


def as_tuple(region):
    return None if region is None else (region.x, region.y, region.width, region.height)


def test_region_edges(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(EDGE)], "i int, p string")
    got = {r.i: as_tuple(r.region) for r in M.region_from_json(df, "p").collect()}
    assert got == {i: want for i, (_, want) in enumerate(EDGE)}


def test_clamp_edges(spark):
    cases = [((-10, 2, 20, 3), (0, 2, 20, 3)), ((99, 0, 5, 5), (31, 0, 1, 5)), ((30, 20, 50, 50), (30, 20, 2, 4)),
             ((3, 3, -2, 4), (3, 3, 0, 4)), ((0, 0, 0, 0), (0, 0, 0, 0))]
    df = spark.createDataFrame([(i, region) for i, (region, _) in enumerate(cases)],
                               "i int, region struct<x:long,y:long,width:long,height:long>").selectExpr("*", "32 AS w", "24 AS h")
    got = {r.i: as_tuple(r.region) for r in M.clamp_regions(df, "w", "h").collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_mask_positions_and_coverage(spark):
    frames = spark.createDataFrame([(1, 0), (1, 4), (2, 0), (3, 0)], "video_id long, frame_index long")
    sizes = spark.createDataFrame([(1, 8, 6), (2, 8, 6), (3, 8, 6)], "video_id long, target_width int, target_height int")
    regions = spark.createDataFrame([(1, (6, 4, 9, 9)), (3, (1, 1, 0, 5))], "video_id long, region struct<x:long,y:long,width:long,height:long>")
    masks = M.region_mask(frames, regions, sizes)
    positions = M.mask_positions(M.mask_lines(masks)).collect()
    assert len(positions) == 4 * 48
    assert {(r.video_id, r.frame_index, r.y, r.x) for r in positions if r.m == 1.0} == {
        (1, f, y, x) for f in (0, 4) for y in (4, 5) for x in (6, 7)}
    assert {r.video_id: round(r.coverage, 6) for r in M.mask_coverage(masks).collect()} == {1: round(4 / 48, 6), 2: 0.0, 3: 0.0}


def test_crop_moves_the_corner(spark):
    pixels = spark.createDataFrame([(1, i, y, x, y, x, 0) for i in (1, 2, 3) for y in range(3) for x in range(4)],
                                   "batch_id long, image_id long, y int, x int, r int, g int, b int")
    images = spark.createDataFrame([(i, 1, 4, 3) for i in (1, 2, 3)], "image_id long, batch_id long, width int, height int")
    regions = spark.createDataFrame([(1, (1, 2, 2, 9)), (2, (1, 1, 0, 2))], "image_id long, region struct<x:long,y:long,width:long,height:long>")
    got = {i: [] for i in (1, 2, 3)}
    for r in M.region_crop(pixels, images, regions).collect():
        got[r.image_id].append((r.y, r.x, r.r, r.g))
    assert sorted(got[1]) == [(0, 0, 2, 1), (0, 1, 2, 2)] and len(got[2]) == len(got[3]) == 12
    ones = M.mask_positions(M.mask_lines(M.crop_mask(images, regions))).collect()
    assert [(r.image_id, r.m) for r in ones] == [(1, 1.0)] * 2


EVENTS = "event_id long, ts timestamp_ntz, node_id string, video string, op string, payload string"
START = dt.datetime(2024, 1, 1)


def log(spark, entries):
    return spark.createDataFrame([(i, START + dt.timedelta(milliseconds=ms), *rest) for i, (ms, *rest) in enumerate(entries)], EVENTS)


def test_last_write_wins(spark):
    region = '{"x":1,"width":2}'
    events = log(spark, [
        (0, "a", "v", "set", region), (5, "a", "v", "clear", None), (3, "b", "v", "clear", None), (4, "b", "w", "set", "{}"),
        (9, None, "w", "set", region), (1, "", "", "set", region), (2, "c", None, "set", region), (2, "c", None, "clear", None),
        (7, "d", "w", "param", None),
    ])
    nodes = {r.node_id: as_tuple(r.region) for r in E.latest_region(events).collect()}
    assert nodes == {"b": (0, 0, 0, 0), "": (1, 0, 2, 0)}
    assert {r.video: as_tuple(r.region) for r in E.latest_region(events, "video").collect()} == {"v": (1, 0, 2, 0), "w": (0, 0, 0, 0)}
    assert {r.node_id: r.version for r in E.mask_version(events).collect()} == {"a": 2, "b": 2, "c": 2}


def test_fingerprints_and_stale(spark, rows):
    videos = spark.createDataFrame([(1, "a.mp4", "1"), (2, "b.mp4", "2"), (3, "c.mp4", "3")], "video_id long, name string, node_id string")
    files = spark.createDataFrame([("a.mp4", 1700000060000), ("b.mp4", 1700000060120)], "name string, mtime_ms long")
    versions = spark.createDataFrame([("1", 3)], "node_id string, version long")
    prints = E.change_fingerprint(videos, versions, files)
    assert rows(prints) == [(1, "1700000060.0_3"), (2, "1700000060.12_0"), (3, "missing_0")]
    before = spark.createDataFrame([(1, "1700000060.0_3"), (2, "1700000060.12_1")], "video_id long, fingerprint string")
    assert sorted(r.video_id for r in E.stale_videos(prints, before).collect()) == [2, 3]


def debounced(entries, gap_ms):
    """Event numbers a restarting timer fires for."""
    fired, by_node = [], {}
    for i, (ms, node, *_) in enumerate(entries):
        by_node.setdefault(node, []).append((ms, i))
    for node, times in by_node.items():
        if node is not None:
            times.sort()
            fired += [i for (ms, i), nxt in zip(times, [*times[1:], (None, None)]) if nxt[0] is None or nxt[0] - ms >= gap_ms]
    return sorted(fired)


@pytest.mark.parametrize("spread_ms", [3000, 8_000_000])
def test_debounce_across_hours(spark, spread_ms):
    rng = random.Random(spread_ms)
    entries = [(3_600_000 * rng.randint(0, 1) + rng.randint(-spread_ms, spread_ms), rng.choice(["a", "b", None]), None, "param", None) for _ in range(300)]
    gap = spread_ms // 20
    got = E.debounce_changes(log(spark, entries), f"{gap} milliseconds")
    assert sorted(r.event_id for r in got.collect()) == debounced(entries, gap)


def test_write_frames(spark, tmp_path):
    chosen = spark.createDataFrame([(1, 10 * k, k, bytes([k])) for k in range(5)], "video_id long, frame_index long, position long, data binary")
    sinks.write_frames(chosen, str(tmp_path / "out"))
    back = {r.file_name: r.data for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert back == {f"vme_frame_1_{k:04d}.png": bytearray([k]) for k in range(5)}
