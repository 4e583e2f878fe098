import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from frameops.functions import sampling as S
from frameops.operators import frames as V
from frameops.operators.lattice import lattice
from frameops.sources.frame_store import FrameStore

VIDEOS = "video_id long, total_frames long, original_fps double, width int, height int"
PARAMS = ("video_id long, framerate int, custom_width int, custom_height int, frame_load_cap long, "
          "skip_first_frames long, select_every_nth long, max_preview_text string")


def stepwise(n, bad, fps, framerate, cap, skip, nth, preview=None):
    """Selection as a reading loop makes it."""
    step = max(1, round(fps / framerate)) if framerate and fps > 0 else 1
    stride, lead, limit, out = max(1, nth) * step, int(step > 1), cap if cap > 0 else None, []
    if preview is not None:
        limit = preview if limit is None else min(limit, preview)
    for i in range(n):
        if i in bad:
            break
        if i < skip or (lead and i == skip) or (i - skip - lead) % stride:
            continue
        out.append(i)
        if limit is not None and len(out) >= limit:
            break
    return out


case = st.tuples(
    st.integers(0, 60), st.sets(st.integers(0, 60), max_size=2), st.sampled_from([0.0, 12.0, 23.976, 25.0, 29.97, 30.0, 60.0]),
    st.integers(0, 60), st.integers(0, 6), st.integers(0, 9), st.integers(0, 4), st.sampled_from([None, "x", "-1", "3", "500", " 7 "]),
)


def check_selection(spark, cases):
    frames = [(v, i, i not in c[1]) for v, c in enumerate(cases) for i in range(c[0])]
    videos = [(v, c[0], c[2], 64, 48) for v, c in enumerate(cases)]
    params = [(v, c[3], 0, 0, c[4], c[5], c[6], c[7]) for v, c in enumerate(cases)]
    frames = spark.createDataFrame(frames, "video_id long, frame_index long, readable boolean")
    plan = V.sampling_plan(spark.createDataFrame(videos, VIDEOS), spark.createDataFrame(params, PARAMS))

    def grouped(df):
        out = {}
        for r in df.orderBy("video_id", "frame_index").collect():
            assert r.position == len(out.setdefault(r.video_id, []))
            out[r.video_id].append(r.frame_index)
        return out

    full = grouped(V.select_frames(frames, plan))
    shown = grouped(V.preview_frames(frames, plan, spark.createDataFrame(params, PARAMS)))
    for v, (n, bad, fps, rate, cap, skip, nth, text) in enumerate(cases):
        limit = {None: 48, "x": 48, "-1": 1, "3": 3, "500": 120, " 7 ": 7}[text]
        assert full.get(v, []) == stepwise(n, bad, fps, rate, cap, skip, nth)
        assert shown.get(v, []) == stepwise(n, bad, fps, rate, cap, skip, nth, limit)


@settings(max_examples=4, deadline=None)
@given(st.lists(case, min_size=1, max_size=30))
def test_selection_equals_a_reading_loop(spark, cases):
    check_selection(spark, cases)


def test_selection_without_broadcast(no_broadcast):
    check_selection(no_broadcast, [(40, {30}, 30.0, 12, 4, 3, 2, None), (50, set(), 24.0, 0, 0, 0, 1, "3")])


def test_target_size_edges(spark):
    cases = {(1920, 1080, 0, 0): (1920, 1080), (1920, 1080, 500, 0): (504, 280), (3, 3, 0, 0): (0, 0),
             (1920, 1080, 0, 540): (960, 544), (1920, 1080, 100, 50): (104, 48), (10, 10, 12, 12): (16, 16)}
    df = spark.createDataFrame(list(cases), "w int, h int, cw int, ch int")
    wide, high = S.target_size(*(F.col(c) for c in ("w", "h", "cw", "ch")))
    for r in df.select("*", wide.alias("tw"), high.alias("th")).collect():
        assert (r.tw, r.th) == cases[r.w, r.h, r.cw, r.ch]


def test_padded_length(spark):
    cases = {0: 1, 1: 1, 2: 5, 5: 5, 6: 9, 81: 81, 82: 85}
    df = spark.createDataFrame([(n,) for n in cases], "n long").withColumn("wan", S.padded_length(F.col("n")))
    assert {r.n: r.wan for r in df.collect()} == cases


def test_probe_needs_a_readable_first_frame(spark):
    videos = spark.createDataFrame([(1, 2, 24.0, 0, 0), (2, 2, 24.0, 0, 5), (3, 2, 24.0, 9, 9), (4, 0, 24.0, 0, 0)], VIDEOS)
    frames = spark.createDataFrame(
        [(1, 0, True, 7, 8), (1, 1, True, 1, 1), (2, 0, False, 7, 8), (2, 1, True, 7, 8), (3, 0, True, 1, 1)],
        "video_id long, frame_index long, readable boolean, probe_width int, probe_height int")
    got = {r.video_id: (r.width, r.height, r.error is None) for r in V.probe_dimensions(videos, frames).collect()}
    assert got == {1: (7, 8, True), 2: (None, None, False), 3: (9, 9, True), 4: (None, None, False)}


def test_frame_lookup(spark, rows):
    frames = spark.createDataFrame([(1, 0, True, "a"), (1, 1, False, "b"), (1, 2, True, "c")],
                                   "video_id long, frame_index long, readable boolean, data string")
    asked = spark.createDataFrame([(10, 1, -5), (11, 1, 1), (12, 1, 2), (13, 2, 0)], "request_id long, video_id long, n long")
    got = {r.request_id: r.data for r in V.frame_lookup(asked, frames).collect()}
    assert got == {10: "a", 11: None, 12: "c", 13: None}


def test_videos_without_params_have_the_defaults(spark):
    videos = spark.createDataFrame([(1, 9, 30.0, 640, 480), (2, 9, 30.0, 640, 480)], VIDEOS)
    params = spark.createDataFrame([(2, 10, 0, 0, 2, 1, 2, "7")], PARAMS)
    plans = {r.video_id: (r.combined_step, r.start_index, r.frame_load_cap) for r in V.sampling_plan(videos, params).collect()}
    assert plans == {1: (1, 0, 0), 2: (6, 2, 2)}
    sizes = {r.video_id: (r.target_width, r.target_height) for r in V.target_size(videos, params).collect()}
    assert sizes == {1: (640, 480), 2: (640, 480)}
    frames = spark.createDataFrame([(v, i, True) for v in (1, 2) for i in range(60)], "video_id long, frame_index long, readable boolean")
    shown = V.preview_frames(frames, V.sampling_plan(videos, params), params).groupBy("video_id").count()
    assert {r.video_id: r["count"] for r in shown.collect()} == {1: 48, 2: 2}



def rows_read(spark):
    context = spark.sparkContext
    none = context._gateway.new_array(context._gateway.jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).inputRecords() for i in range(stages.size()))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """12 videos of 2,000 frames in runs of 50, four videos to a zone; every third one breaks off."""
    frames = spark.range(24_000).selectExpr("id DIV 2000 AS video_id", "id % 2000 AS frame_index", "NOT (id DIV 2000 % 3 = 0 AND id % 2000 = 700) AS readable")
    store = FrameStore(spark, str(tmp_path_factory.mktemp("frames") / "s"), frames.schema, run=50, videos=4).write(frames)
    return store, frames


@pytest.mark.parametrize("cap, skip, nth, most", [(10, 0, 1, 0.04), (40, 0, 1, 0.04), (20, 90, 3, 0.06), (0, 1990, 1, 0.04), (5, 0, 200, 0.25), (0, 0, 1, 1.0)])
def test_stored_frames_are_read_up_to_the_cap(spark, stored, cap, skip, nth, most):
    store, frames = stored
    videos = spark.createDataFrame([(v, 2000, 24.0, 64, 48) for v in range(12)], VIDEOS)
    params = spark.createDataFrame([(v, 0, 0, 0, cap, skip, nth, "3") for v in range(12)], PARAMS)
    plan = V.sampling_plan(videos, params)
    chosen = store.select(plan)
    before = rows_read(spark)
    got = sorted(tuple(r) for r in chosen.collect())
    # the list of runs is read twice, too
    assert rows_read(spark) - before <= most * 24_000 + (100 if most < 1 else 1000)
    assert got == sorted(tuple(r) for r in V.select_frames(frames, plan).collect())
    shown = sorted(tuple(r) for r in store.preview(plan, params).collect())
    assert shown == sorted(tuple(r) for r in V.preview_frames(frames, plan, params).collect())


def test_hidden_names_are_the_users(spark):
    videos = spark.createDataFrame([(1, 0, 0, 77, "k", 9), (2, 8, 6, 78, "l", 9)], "video_id long, width int, height int, _w int, _h string, first int")
    frames = spark.createDataFrame([(1, 0, True, 64, 48)], "video_id long, frame_index long, readable boolean, probe_width int, probe_height int")
    got = V.probe_dimensions(videos, frames)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 64, 48, 77, "k", 9, None), (2, 8, 6, 78, "l", 9, None)]
    spots = lattice(videos.filter("video_id = 2"), "width", "height")
    assert spots.columns == [*videos.columns, "y", "x"] and {(r._w, r._h) for r in spots.collect()} == {(78, "l")} and spots.count() == 48
