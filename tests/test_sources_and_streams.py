import datetime as dt
import json
import struct
import zlib

import pandas as pd
from pyspark.sql import functions as F

from frameops.operators import masklog as E
from frameops.plans import video as plans
from frameops.sources import images, media
from frameops.streaming.masklog import BurstEnds, current_state, debounce_stream, debounce_timers, mask_state_changes
from frameops.streaming.media import stream_new_media
from frameops.streaming.tables import StateTable, StreamTable
from workload import fixtures as X

SF = "/root/testdata/sf0.001"


def png(width, height, pixels):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = b"".join(b"\x00" + bytes(v for x in range(width) for v in pixels[y][x]) for y in range(height))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))


def test_png_to_pixels(spark, tmp_path):
    pixels = [[(1, 2, 3), (250, 0, 7)], [(9, 8, 7), (0, 255, 128)]]
    (tmp_path / "a.png").write_bytes(png(2, 2, pixels))
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in images.read_image_pixels(spark, str(tmp_path)).collect()}
    assert got == {(y, x): pixels[y][x] for y in range(2) for x in range(2)}


def test_unpack_grey_alpha_and_long_images(spark):
    packed = spark.createDataFrame([
        (1, 1, 1, 2, 1, bytes([5, 6])), (1, 2, 1, 1, 4, bytes([1, 2, 3, 99])), (1, 3, 700, 300, 3, bytes(630000)), (1, 4, 0, 0, 3, b""),
    ], "batch_id long, image_id long, height int, width int, nChannels int, data binary")
    got = images.unpack_images(packed.withColumn("line", F.lit("a user's")))
    assert got.filter("image_id = 3").select("y", "x").distinct().count() == 210000
    small = sorted(tuple(r) for r in got.filter("image_id <> 3").collect())
    assert small == [(1, 1, 0, 0, 5, 5, 5), (1, 1, 0, 1, 6, 6, 6), (1, 2, 0, 0, 3, 2, 1)]


def test_catalogue_of_a_directory(spark, tmp_path):
    for name in ("b.MP4", "a.webm", "c.txt", "gif", "d.tar.mov", "noext"):
        (tmp_path / name).write_bytes(b"xy")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.mp4").write_bytes(b"z")
    got = media.read_media_catalog(spark, str(tmp_path)).collect()
    assert [r.name for r in got] == ["a.webm", "b.MP4", "d.tar.mov", "gif"]
    assert all(r.length == 2 and abs(r.mtime_ms / 1000 - (tmp_path / r.name).stat().st_mtime) < 2 for r in got)


def test_new_media_are_reported_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.mp4").write_bytes(b"1")
    (folder / "b.txt").write_bytes(b"1")
    stream = stream_new_media(media.read_media_stream(spark, str(folder)))
    table = StreamTable(spark, "arrivals", str(tmp_path))
    assert [r.name for r in table.drain(stream, "append").collect()] == ["a.mp4"]
    (folder / "c.gif").write_bytes(b"22")
    assert sorted((r.name, r.length) for r in table.drain(stream, "append").collect()) == [("a.mp4", 1), ("c.gif", 2)]


def event_files(spark, folder, parts=3):
    events = X.mask_events(spark, SF)
    for i in range(parts):
        events.filter(F.col("event_id") % parts == parts - 1 - i).coalesce(1).write.parquet(str(folder / f"part{i}"))
    return events, (
        spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))
    )


def test_stream_state_equals_batch_in_any_arrival_order(spark, tmp_path):
    events, stream = event_files(spark, tmp_path / "events")
    changes = StreamTable(spark, "state", str(tmp_path)).drain(mask_state_changes(stream), "update")
    assert changes.select("batch").distinct().count() >= 3
    state = current_state(changes)
    assert {r.node_id: r.version for r in state.filter("version > 0").collect()} == versions(events)
    assert [r.version for r in state.filter("node_id = ''").collect()] in ([], [0])
    held = {r.node_id: tuple(r.region) for r in state.filter("op = 'set'").collect()}
    assert held == {r.node_id: tuple(r.region) for r in E.latest_region(events).collect()}


def versions(events):
    return {r.node_id: r.version for r in E.mask_version(events).collect()}


def test_a_stopped_stream_goes_on_and_stays_small(spark, tmp_path):
    folder = tmp_path / "events"
    events, stream = event_files(spark, folder)
    late = tmp_path / "late"
    (folder / "part2").rename(late)
    first = StateTable(spark, "state", "node_id", str(tmp_path))
    assert first.read(mask_state_changes(stream)).collect() == []
    first.drain(mask_state_changes(stream), "update")
    late.rename(folder / "part2")
    # another object of the same name finds table and checkpoint
    again = StateTable(spark, "state", "node_id", str(tmp_path))
    state = current_state(again.drain(mask_state_changes(stream), "update"))
    assert {r.node_id: r.version for r in state.filter("version > 0").collect()} == versions(events)
    held = {r.node_id: tuple(r.region) for r in state.filter("op = 'set'").collect()}
    assert held == {r.node_id: tuple(r.region) for r in E.latest_region(events).collect()}
    assert len(list((tmp_path / "frameops" / "state" / "table").glob("batch=*"))) <= 2


def test_files_without_an_image_are_listed(spark, tmp_path):
    (tmp_path / "bad.png").write_bytes(b"no image")
    got = images.undecodable_images(spark, str(tmp_path)).collect()
    assert [(r.name, r.error) for r in got] == [("bad.png", "Could not decode image")]


def test_stream_debounce_equals_batch(spark, tmp_path):
    events = X.mask_events(spark, SF).filter("op = 'param'")
    # one much later event per node moves the watermark past every burst
    last = events.agg(F.max("ts")).first()[0] + dt.timedelta(days=3)
    late = spark.createDataFrame([(10 ** 9, last, "late", None, "param", None)], events.schema)
    events.coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    late.coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    for i, extra in enumerate((1, 2)):
        later = late.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {extra} DAYS"))
        later.coalesce(1).write.parquet(str(tmp_path / "in" / f"c{i}"))
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fired = StreamTable(spark, "bursts", str(tmp_path)).drain(debounce_stream(stream, "6 hours", "1 hour"), "append")
    got = sorted(r.event_id for r in fired.filter("node_id <> 'late'").collect())
    assert got == sorted(r.event_id for r in E.debounce_changes(events, "6 hours").collect())


def test_timers_end_the_last_burst(spark, tmp_path):
    """No event comes after the last burst of any node, and none of a far future is planted."""
    events = X.mask_events(spark, SF).filter("op = 'param'")
    late = F.lit("2024-01-20").cast("timestamp_ntz")
    events.filter(F.col("ts") < late).coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    table = StreamTable(spark, "bursts", str(tmp_path))
    first = table.settle(debounce_timers(stream, "6 hours", idle="1 second"), "update")
    ends = sorted(map(tuple, E.debounce_changes(events.filter(F.col("ts") < late), "6 hours").collect()))
    assert sorted(map(tuple, first.select(events.columns).collect())) == ends and ends
    # the same stream goes on with what comes later
    events.filter(F.col("ts") >= late).coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    again = StreamTable(spark, "bursts", str(tmp_path)).settle(debounce_timers(stream, "6 hours", idle="1 second"), "update")
    both = ends + list(map(tuple, E.debounce_changes(events.filter(F.col("ts") >= late), "6 hours").collect()))
    assert sorted(map(tuple, again.select(events.columns).collect())) == sorted(both)


def test_held_events_are_prolonged_across_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp_ntz, node_id string, video string"
    parts = [[(0, "a"), (30, "a"), (0, "b")], [(80, "a"), (500, "b")], [(170, "a"), (171, None), (700, "b")]]
    n = 0
    for i, part in enumerate(parts):
        rows = [(n + k, start + dt.timedelta(milliseconds=ms), node, f"v{ms}") for k, (ms, node) in enumerate(part)]
        n += len(part)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = StreamTable(spark, "bursts", str(tmp_path)).settle(debounce_timers(stream, "100 milliseconds", idle="8 seconds"), "update")
    assert sorted((r.node_id, r.video) for r in got.collect()) == [("a", "v170"), ("b", "v0"), ("b", "v500"), ("b", "v700")]


class _Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


class _Store:
    """State and timers of one bucket; ``calls`` counts what a real one would be asked."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def _bucket(gap=100, idle=50):
    ends, store = BurstEnds(gap, idle), _Store()
    ends.init(store)

    def arrive(now, *events):
        parts = [pd.DataFrame([e], columns=["key", "at", "event_id", "body"]).assign(bucket=3) for e in events]
        return sorted(r for out in ends.handleInputRows((3,), iter(parts), _Clock(now)) for r in out[["key", "event_id"]].itertuples(index=False, name=None))

    def expire(now):
        due = store.timers.pop()
        assert due <= now and not store.timers
        return sorted(r for out in ends.handleExpiredTimer((3,), _Clock(now), None) for r in out[["key", "event_id"]].itertuples(index=False, name=None))

    return store, arrive, expire


def test_keys_of_a_bucket_keep_times_of_their_own():
    store, arrive, expire = _bucket()
    assert arrive(1000, ("a", 0, 1, "{}"), ("b", 0, 2, "{}"), ("a", 30, 3, "{}")) == [] and store.timers == [1050]
    # a is prolonged, b is not; c has a burst that ends at once
    assert arrive(1040, ("a", 120, 4, "{}"), ("c", 0, 5, "{}"), ("c", 500, 6, "{}")) == [("c", 5)] and store.timers == [1050]
    assert expire(1060) == [("b", 2)] and store.timers == [1090]
    assert arrive(1070, ("b", 900, 7, "{}"), ("a", 221, 8, "{}")) == [("a", 4)] and store.timers == [1090]
    assert expire(1095) == [("c", 6)] and store.timers == [1120]
    assert expire(1120) == [("a", 8), ("b", 7)] and store.timers == [] and store.value is None


def test_state_is_asked_for_per_bucket_and_not_per_key():
    calls = []
    for n in (1, 500):
        store, arrive, expire = _bucket()
        arrive(1000, *((f"k{i}", 0, i, "{}") for i in range(n)))
        assert expire(1050) == sorted((f"k{i}", i) for i in range(n))
        calls.append(store.calls)
    assert calls[0] == calls[1]


def test_settling_ends_although_batches_follow_without_a_pause(spark, tmp_path, monkeypatch):
    start, schema = dt.datetime(2024, 1, 1), "event_id long, ts timestamp_ntz, node_id string, video string"
    spark.createDataFrame([(1, start, "a", "v")], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    seen, settled = [], StreamTable._settled

    def watched(query):
        done = settled(query)
        if done:
            seen.append(query.lastProgress.batchId)
        return done

    monkeypatch.setattr(StreamTable, "_settled", staticmethod(watched))
    table = StreamTable(spark, "bursts", str(tmp_path))
    got = table.settle(debounce_timers(stream, "6 hours", idle="1 second"), "update", every="1 millisecond", most_seconds=60)
    assert [r.event_id for r in got.collect()] == [1]
    assert max(int(p.name) for p in (tmp_path / "frameops" / "bursts" / "checkpoint" / "commits").glob("[0-9]*")) <= seen[0] + 2


def test_loading_whole_videos(spark):
    videos, params, frames = X.videos(spark, SF), X.video_params(spark, SF), X.frames(spark, SF)
    loaded = plans.load_videos(videos, params, frames, X.mask_events(spark, SF))
    chosen, failed = loaded.selected.select("video_id").distinct().count(), loaded.failed.count()
    assert chosen + failed == videos.count() and loaded.stats.count() == chosen
    assert loaded.masks.count() == loaded.selected.count()
    previews = plans.preview_videos(videos, params, frames)
    assert previews.documents.count() + previews.failed.count() == videos.count()
    for r in previews.documents.collect():
        document = json.loads(r.document)
        assert all(f["width"] > 0 and f["height"] > 0 for f in document["frames"])
        assert [f["index"] for f in document["frames"]] == list(range(r.n_frames)) and r.n_frames <= 120
        assert document["frame_count"] == r.frame_count and len(document["selected_frame_indices"]) == r.n_frames


def test_previews_probe_sizes_first(spark):
    videos = spark.createDataFrame([(v, 2, 24.0, 0, 0) for v in (1, 2)], "video_id long, total_frames long, original_fps double, width int, height int")
    params = spark.createDataFrame([(1, 0, 0, 0, 0, 0, 1, None)], "video_id long, framerate int, custom_width int, custom_height int, "
                                   "frame_load_cap long, skip_first_frames long, select_every_nth long, max_preview_text string")
    frames = spark.createDataFrame([(1, 0, True, 64, 48, "a"), (1, 1, True, 64, 48, "b"), (2, 0, False, None, None, "c")],
                                   "video_id long, frame_index long, readable boolean, probe_width int, probe_height int, payload_text string")
    previews = plans.preview_videos(videos, params, frames)
    (only,) = previews.documents.collect()
    assert [(f["width"], f["height"], f["data"]) for f in json.loads(only.document)["frames"]] == [(64, 48, "YQ=="), (64, 48, "Yg==")]
    assert [tuple(r) for r in previews.failed.collect()] == [(2, "Could not read video frame to determine dimensions")]


def test_rerun_list_is_empty_without_changes(spark):
    named, files, events = X.named_videos(spark, SF), X.media_files(spark, SF), X.mask_events(spark, SF)
    now = E.change_fingerprint(named, E.mask_version(events), files)
    assert plans.videos_to_rerun(named, files, events, now).count() == 0
    assert plans.videos_to_rerun(named, files, events.filter("op <> 'clear'"), now).count() > 0


def test_loading_pixels(spark):
    videos = spark.createDataFrame([(1, 4, 24.0, 6, 5), (2, 1, 24.0, 6, 5)], "video_id long, total_frames long, original_fps double, width int, height int")
    params = spark.createDataFrame([(v, 0, 16, 8, 0, 1, 2) for v in (1, 2)], "video_id long, framerate int, custom_width int, "
                                   "custom_height int, frame_load_cap long, skip_first_frames long, select_every_nth long")
    frames = spark.createDataFrame([(1, i, True, 6, 5) for i in range(4)] + [(2, 0, True, 6, 5)],
                                   "video_id long, frame_index long, readable boolean, probe_width int, probe_height int")
    events = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "1", None, "set", '{"x":2,"y":3,"width":4,"height":99}')],
                                   "event_id long, ts timestamp_ntz, node_id string, video string, op string, payload string")
    held = spark.createDataFrame([(10 * v + i, v, 6, 5, v, i) for v, n in ((1, 4), (2, 1)) for i in range(n)],
                                 "image_id long, batch_id long, width int, height int, video_id long, frame_index long")
    pixels = held.selectExpr("batch_id", "image_id", "explode(sequence(0, 4)) AS y").selectExpr("*", "explode(sequence(0, 5)) AS x").selectExpr(
        "*", "CAST(image_id AS INT) AS r", "9 AS g", "7 AS b")
    loaded = plans.load_videos(videos, params, frames, events)
    whole = plans.load_pixels(loaded, pixels, held).groupBy("image_id").agg(F.count("*").alias("n"), F.max("r").alias("r"))
    assert sorted(tuple(r) for r in whole.collect()) == [(11, 128, 11), (13, 128, 13)]
    cut = plans.load_pixels(loaded, pixels, held, crop_to_mask=True).groupBy("image_id").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.count("*").alias("n"))
    assert sorted(tuple(r) for r in cut.collect()) == [(11, 3, 4, 20), (13, 3, 4, 20)]
    assert [r.video_id for r in loaded.failed.collect()] == [2]
