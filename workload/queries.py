"""The registered queries: every operator over the whole derived tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from frameops.functions.sampling import SIZE_MULTIPLE
from frameops.operators import colors as C, frames as V, geometry as G, masklog as E, palette as P, regions as M, runs as R, tiles as T
from frameops.operators.lasso import lasso_mask
from frameops.operators.resize import resize_pixels as resample
from frameops.plans.video import preview_videos as previews
from frameops.session import drop_at_exit, shared_dir
from frameops.sources.frame_store import FrameStore
from frameops.sources import images as image_source, media, sinks
from frameops.streaming.masklog import current_state, debounce_stream as settled, debounce_timers, mask_state_changes
from frameops.streaming.media import stream_new_media as new_media
from frameops.streaming.tables import StateTable, StreamTable
from workload import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DIGITS = 6
POSE = dict(width_change=5, height_change=-3, offset_x=4, offset_y=-2)
FILL = "#102030"
BURST_GAP = "6 hours"
LAST_RUN = "2024-01-16"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), DIGITS) for c in cols})


def _region_columns(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in df.columns if c != "region"), *(F.col(f"region.{s}").alias(s) for s in M.SIDES))


def _probed(spark, d):
    """Videos whose size is known from the header or the first frame."""
    return V.probe_dimensions(X.videos(spark, d), X.frames(spark, d)).filter("error IS NULL").drop("error")


# Sources and sinks

@query
def media_catalog(spark, d):
    return media.media_catalog(X.media_files(spark, d)).select("file_id", "name", "mtime_ms")


@query
def missing_media(spark, d):
    return media.missing_media(X.media_requests(spark, d), X.media_files(spark, d)).select("request_id", "name", "message")


@query
def image_pixels(spark, d):
    return image_source.unpack_images(X.packed_images(spark, d))


@query
def frame_sink_manifest(spark, d):
    return sinks.frame_sink_manifest(_selected(spark, d)).select("video_id", "position", "frame_index", "file_name")


@query
def preview_manifest(spark, d):
    plan, params = _plan(spark, d), X.video_params(spark, d)
    shown = V.preview_frames(X.frames(spark, d), plan, params)
    sizes = V.target_size(_probed(spark, d), params)
    return _rounded(sinks.preview_manifest(shown, sinks.preview_fps(plan), sizes), "fps")


@query
def preview_failures(spark, d):
    return previews(X.videos(spark, d), X.video_params(spark, d), X.frames(spark, d)).failed


# Colour columns

@query
def color_standardize(spark, d):
    return C.color_standardize(X.color_strings(spark, d), "color_text").select("row_id", "value", "hex", "rgb")


@query
def color_reject_report(spark, d):
    return C.color_reject_report(X.color_strings(spark, d), "color_text")


@query
def color_rejects(spark, d):
    return C.color_rejects(X.color_strings(spark, d), "color_text").select("row_id", "color_text")


@query
def hex_to_rgb(spark, d):
    return C.hex_to_rgb(X.color_strings(spark, d), "color_text").select("row_id", "r", "g", "b")


@query
def pack_rgb24(spark, d):
    return C.pack_rgb24(X.pixels(spark, d)).select("image_id", "y", "x", "value")


@query
def unpack_rgb24(spark, d):
    return C.unpack_rgb24(X.color_strings(spark, d), "color_int", "null").select("row_id", "r", "g", "b")


@query
def range24_filter(spark, d):
    return C.range24_filter(X.color_strings(spark, d), "color_int").select("row_id", "color_int")


@query
def format_color(spark, d):
    inside = C.range24_filter(X.color_strings(spark, d), "color_int")
    return C.format_color(inside, "color_int").select("row_id", "color_int", "hex", "rgb")


@query
def rgb_to_hsv(spark, d):
    return _rounded(C.rgb_to_hsv(X.pixels(spark, d)), "h", "s", "v").select("image_id", "y", "x", "h", "s", "v")


# Palettes

@query
def pixel_grid_sample(spark, d):
    return P.pixel_grid_sample(X.pixels(spark, d))


@query
def distinct_palette(spark, d):
    return P.distinct_palette(X.pixels(spark, d))


@query
def muted_color_filter(spark, d):
    return P.muted_color_filter(P.distinct_palette(X.pixels(spark, d)))


@query
def nearest_palette_color(spark, d):
    pixels = X.pixels(spark, d)
    return _rounded(P.nearest_palette_color(pixels, P.pixel_grid_sample(pixels)), "distance")


@query
def farthest_color(spark, d):
    return P.farthest_color(X.pixels(spark, d))


@query
def farthest_color_fallback(spark, d):
    return P.farthest_color(X.pixels(spark, d), min_sat=0.5, max_sat=0.3)


@query
def farthest_color_summary(spark, d):
    return _rounded(P.farthest_color_summary(X.pixels(spark, d)), "h", "s", "v", "distance")


# Geometry

@query
def rotate_pixels(spark, d):
    return G.rotate_pixels(X.sized_pixels(spark, d), X.images(spark, d), 30, "#204060")


@query
def fit_to_size(spark, d):
    return G.fit_to_size(X.sized_pixels(spark, d), X.images(spark, d), 31, 13, FILL)


@query
def mask_union(spark, d):
    return G.mask_union(X.mask_pixels(spark, d))


@query
def mask_runs(spark, d):
    return R.mask_runs(X.mask_pixels(spark, d))


@query
def mask_union_runs(spark, d):
    """The united masks spelt out from the runs of every single mask."""
    single = R.mask_runs(X.mask_pixels(spark, d), ("batch_id", "mask_idx"))
    united = R.union_runs(single.drop("mask_idx"))
    return R.spelt_out(united, X.images(spark, d).select("batch_id", "width", "height").distinct())


@query
def mask_default_full(spark, d):
    return G.mask_or_full(X.mask_pixels(spark, d), X.images(spark, d))


@query
def mask_bbox(spark, d):
    return G.mask_bbox(G.mask_union(X.mask_pixels(spark, d)))


@query
def empty_mask_passthrough(spark, d):
    return G.empty_mask_passthrough(X.pixels(spark, d), X.mask_pixels(spark, d), X.images(spark, d))


@query
def pose_window(spark, d):
    return G.pose_window(G.batch_bbox(X.mask_pixels(spark, d), X.images(spark, d)), **POSE)


@query
def pose_crop_fill(spark, d):
    return G.pose_setup(X.pixels(spark, d), X.images(spark, d), X.mask_pixels(spark, d), FILL, **POSE)


@query
def pose_only_fill(spark, d):
    return G.pose_setup(X.pixels(spark, d), X.images(spark, d), X.mask_pixels(spark, d), FILL, **POSE, only_fill=True)


@query
def pose_only_fill_runs(spark, d):
    runs = R.mask_runs(X.mask_pixels(spark, d))
    return G.pose_setup(X.pixels(spark, d), X.images(spark, d), runs, FILL, **POSE, only_fill=True)


TILING = T.Tiling(side=8, images=64)


def _tiled(spark, d):
    """The pixels stored in tiles, in a folder of this run."""
    path = f"{shared_dir(spark)}/tiles-{uuid.uuid4().hex}"
    T.write_tiles(X.pixels(spark, d), path, TILING)
    drop_at_exit(spark, path)
    return T.read_tiles(spark, path)


@query
def tiled_pose_crop(spark, d):
    images, masks = X.images(spark, d), X.mask_pixels(spark, d)
    pixels = T.touched(_tiled(spark, d), T.pose_boxes(images, masks, **POSE), TILING)
    return G.pose_setup(pixels, images, masks, FILL, **POSE)


@query
def fill_channels(spark, d):
    colors = X.pixels(spark, d).select(
        "image_id", "y", "x", (F.lit(1) + F.col("image_id") % 5).cast("int").alias("n_channels"), F.array("r", "g", "b").alias("rgb")
    )
    filled = G.fill_channels(colors, "n_channels", "rgb")
    return filled.select("image_id", "y", "x", "n_channels", F.array_join(F.col("fill").cast("array<string>"), ",").alias("fill"))


@query
def quantize_pixels(spark, d):
    levels = G.quantize_pixels(X.mask_pixels(spark, d), ["m"], clip=True).withColumnRenamed("m", "level")
    back = G.dequantize_pixels(levels.withColumn("back", F.col("level")), ["back"])
    return back.select(
        "batch_id", "mask_idx", "y", "x", "level", F.round(F.col("back").cast("double"), DIGITS).alias("back")
    )


@query
def resize_pixels(spark, d):
    return resample(X.pixels(spark, d), X.images(spark, d), X.resize_targets(spark, d))


@query
def lasso_fill(spark, d):
    return lasso_mask(X.polygons(spark, d), X.polygon_frames(spark, d))


QUERIES["lasso_mask"] = QUERIES.pop("lasso_fill")


@query
def lasso_stroke(spark, d):
    return lasso_mask(X.polygons(spark, d), X.polygon_frames(spark, d), brush=1.75)


# Frame sequences

def _plan(spark, d):
    return V.sampling_plan(X.videos(spark, d), X.video_params(spark, d))


def _selected(spark, d):
    return V.select_frames(X.frames(spark, d), _plan(spark, d))


def _stats(spark, d):
    return V.sequence_stats(_selected(spark, d), _plan(spark, d))


@query
def readable_prefix(spark, d):
    return V.readable_prefix(X.frames(spark, d)).select("video_id", "frame_index", "payload_text")


@query
def target_size(spark, d):
    return V.target_size(_probed(spark, d), X.video_params(spark, d), SIZE_MULTIPLE)


@query
def probe_dimensions(spark, d):
    return V.probe_dimensions(X.videos(spark, d), X.frames(spark, d)).select("video_id", "width", "height", "error")


@query
def sampling_plan(spark, d):
    return _plan(spark, d).select("video_id", "frame_step", "combined_step", "lead_in", "start_index")


@query
def select_frames(spark, d):
    return V.select_frames(X.frames(spark, d), _plan(spark, d), use_cap=False).select(
        "video_id", "frame_index", "position", "payload_text"
    )


@query
def frame_cap(spark, d):
    return _selected(spark, d).select("video_id", "frame_index", "position")


def _stored_frames(spark, d):
    """The frames stored in runs, in a folder of this run."""
    frames = X.frames(spark, d)
    path = f"{shared_dir(spark)}/frames-{uuid.uuid4().hex}"
    store = FrameStore(spark, path, frames.schema, run=16, videos=32).write(frames)
    drop_at_exit(spark, path)
    return store


@query
def stored_frame_cap(spark, d):
    return _stored_frames(spark, d).select(_plan(spark, d)).select("video_id", "frame_index", "position")


@query
def stored_preview_frames(spark, d):
    shown = _stored_frames(spark, d).preview(_plan(spark, d), X.video_params(spark, d))
    return shown.select("video_id", "frame_index", "position")


@query
def preview_frames(spark, d):
    return V.preview_frames(X.frames(spark, d), _plan(spark, d), X.video_params(spark, d)).select(
        "video_id", "frame_index", "position"
    )


@query
def bgr_to_rgb(spark, d):
    return G.bgr_to_rgb(X.pixels(spark, d))


@query
def sequence_stats(spark, d):
    return _rounded(_stats(spark, d), "effective_fps")


@query
def empty_selection_report(spark, d):
    return V.empty_selection_report(_plan(spark, d), _selected(spark, d))


@query
def frame_lookup(spark, d):
    return V.frame_lookup(X.frame_requests(spark, d), X.frames(spark, d)).select("request_id", "video_id", "n", "payload_text")


@query
def frame_timeline(spark, d):
    timeline = V.frame_timeline(_selected(spark, d), _stats(spark, d))
    return _rounded(timeline, "duration_ms", "start_ms", "end_ms").select(
        "video_id", "frame_index", "position", "duration_ms", "start_ms", "end_ms"
    )


@query
def frame_at_time(spark, d):
    return V.frame_at_time(X.playback_probes(spark, d), _stats(spark, d)).select(
        "probe_id", "video_id", "position", "frame_index"
    )


@query
def wan_frames(spark, d):
    return V.padded_frames(_stats(spark, d)).select("video_id", "frame_count", "wan_frames", "pad_frames")


@query
def load_params_clean(spark, d):
    return V.load_params_clean(X.raw_params(spark, d), V.LOAD_PARAMS)


# Region masks

def _video_regions(spark, d):
    latest = E.latest_region(X.mask_events(spark, d))
    return latest.select(F.col("node_id").try_cast("bigint").alias("video_id"), "region")


def _masks(spark, d):
    sizes = V.target_size(_probed(spark, d), X.video_params(spark, d))
    return M.region_mask(_selected(spark, d), _video_regions(spark, d), sizes)


@query
def region_from_json(spark, d):
    sets = X.mask_events(spark, d).filter("op = 'set'")
    return _region_columns(M.region_from_json(sets, "payload").select("event_id", "region"))


@query
def clamp_region(spark, d):
    sets = X.mask_events(spark, d).filter("op = 'set'")
    sizes = _probed(spark, d).select(F.col("video_id").cast("string").alias("node_id"), "width", "height")
    bounded = M.clamp_regions(M.region_from_json(sets, "payload").join(sizes, "node_id").select(
        "event_id", "region", F.col("width").alias("frame_width"), F.col("height").alias("frame_height")
    ), "frame_width", "frame_height")
    return _region_columns(bounded)


@query
def region_mask(spark, d):
    return _masks(spark, d).select(
        "video_id", "frame_index", "target_width", "target_height", *(f"mask_{s}" for s in M.SIDES)
    )


@query
def region_mask_lines(spark, d):
    sizes = V.target_size(_probed(spark, d), X.video_params(spark, d))
    return M.mask_lines(M.video_masks(_video_regions(spark, d), sizes)).select("video_id", "y", "x_from", "x_to", "target_width")


@query
def region_crop(spark, d):
    latest = E.latest_region(X.mask_events(spark, d)).select(F.col("node_id").try_cast("bigint").alias("image_id"), "region")
    return M.region_crop(X.pixels(spark, d), X.images(spark, d), latest)


@query
def tiled_region_crop(spark, d):
    latest = E.latest_region(X.mask_events(spark, d)).select(F.col("node_id").try_cast("bigint").alias("image_id"), "region")
    images = X.images(spark, d)
    return M.region_crop(T.touched(_tiled(spark, d), T.region_boxes(images, latest), TILING), images, latest)


@query
def crop_mask(spark, d):
    latest = E.latest_region(X.mask_events(spark, d)).select(F.col("node_id").try_cast("bigint").alias("image_id"), "region")
    return M.crop_mask(X.images(spark, d), latest)


@query
def mask_coverage(spark, d):
    return _rounded(M.mask_coverage(_masks(spark, d)), "coverage")


# Mask-region log

@query
def latest_region_by_node(spark, d):
    return _region_columns(E.latest_region(X.mask_events(spark, d)))


@query
def latest_region_by_video(spark, d):
    return _region_columns(E.latest_region(X.mask_events(spark, d), "video"))


@query
def mask_version(spark, d):
    return E.mask_version(X.mask_events(spark, d))


def _fingerprints(spark, d, events):
    return E.change_fingerprint(X.named_videos(spark, d), E.mask_version(events), X.media_files(spark, d))


@query
def change_fingerprint(spark, d):
    return _fingerprints(spark, d, X.mask_events(spark, d))


@query
def stale_videos(spark, d):
    events = X.mask_events(spark, d)
    last_run = events.filter(F.col("ts") < F.lit(LAST_RUN).cast("timestamp_ntz"))
    return E.stale_videos(_fingerprints(spark, d, events), _fingerprints(spark, d, last_run))


@query
def stream_mask_state(spark, d):
    changes = mask_state_changes(X.mask_events_of(X.table_stream(spark, d, "events")))
    return _region_columns(current_state(StateTable(spark, "mask-state", "node_id", temporary=True).drain(changes, "update")))


@query
def debounce_changes(spark, d):
    changes = X.mask_events(spark, d).filter("op = 'param'")
    last = E.debounce_changes(changes, BURST_GAP)
    return last.select("node_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "video")


@query
def debounce_stream(spark, d):
    """Some events are followed by one of a far future, so that the watermark passes the last burst."""
    changes = X.mask_events_of(X.table_stream(spark, d, "events")).filter("op = 'param' and node_id is not null")
    ends = F.struct(F.lit("end").alias("node_id"), (F.col("ts") + F.expr("INTERVAL 3650 DAYS")).alias("ts"))
    here = F.struct("node_id", "ts")
    both = changes.withColumn("both", F.explode(F.when(F.col("event_id") % 101 == 0, F.array(here, ends)).otherwise(F.array(here))))
    last = settled(both.select("both.node_id", "event_id", "video", "both.ts"), BURST_GAP)
    # filtered where it is written: a filter on the stream would be moved below the watermark
    written = StreamTable(spark, "bursts", temporary=True).drain(last, "append").filter("node_id <> 'end'")
    return written.select("node_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "video")


@query
def debounce_timer_stream(spark, d):
    """Nothing follows the last burst of a node: a timer ends it."""
    changes = X.mask_events_of(X.table_stream(spark, d, "events")).filter("op = 'param'")
    last = debounce_timers(changes, BURST_GAP, idle="1 second")
    written = StreamTable(spark, "timed-bursts", temporary=True).settle(last, "update")
    return written.select("node_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "video")


@query
def stream_new_media(spark, d):
    arrived = new_media(X.media_files_of(X.table_stream(spark, d, "customer")))
    return StreamTable(spark, "new-media", temporary=True).drain(arrived, "append").drop("batch")
