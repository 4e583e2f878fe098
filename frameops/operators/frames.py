"""Selecting frames of many videos at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from frameops.functions import sampling as S
from frameops.functions.text import int_param


def _per_video(frames: DataFrame, videos: DataFrame, how: str = "inner") -> DataFrame:
    return frames.join(videos, "video_id", how)


def first_unreadable(frames: DataFrame) -> DataFrame:
    """Index of the first frame of each video that cannot be read; only bad frames travel."""
    return frames.filter(~F.col("readable")).groupBy("video_id").agg(F.min("frame_index").alias("first_bad"))


def readable_prefix(frames: DataFrame) -> DataFrame:
    """Frames before the first unreadable one of their video."""
    marked = _per_video(frames, first_unreadable(frames), "left")
    return marked.filter(F.col("first_bad").isNull() | (F.col("frame_index") < F.col("first_bad"))).drop("first_bad")


def with_params(videos: DataFrame, params: DataFrame) -> DataFrame:
    """Videos with their load parameters; a video without a row, or with a null in it, has the defaults."""
    defaults = {name: F.coalesce(F.col(name), F.lit(default)) for name, (default, _, _) in LOAD_PARAMS.items() if name in params.columns}
    return videos.join(params, "video_id", "left").withColumns(defaults)


def target_size(videos: DataFrame, params: DataFrame, multiple: int = S.SIZE_MULTIPLE) -> DataFrame:
    """Output size per video; ``vanished`` marks sizes that round to 0. Unknown header sizes have to be probed before."""
    wide, high = S.target_size(*(F.col(c) for c in ("width", "height", "custom_width", "custom_height")), multiple)
    joined = with_params(videos, params.select("video_id", "custom_width", "custom_height"))
    return joined.select("video_id", wide.alias("target_width"), high.alias("target_height")).withColumn(
        "vanished", (F.col("target_width") == 0) | (F.col("target_height") == 0)
    )


def probe_dimensions(videos: DataFrame, frames: DataFrame) -> DataFrame:
    """Fill missing header sizes from the first frame; an unreadable first frame is an ``error`` row."""
    unknown = (F.col("width") <= 0) | (F.col("height") <= 0)
    asked = videos.filter(unknown).select("video_id")
    first = (
        _per_video(frames, asked).groupBy("video_id")
        .agg(F.min_by(F.struct("readable", "probe_width", "probe_height"), "frame_index").alias("first"))
        .filter("first.readable")
        .select(F.col("video_id").alias("probed_id"), "first")
    )
    # the struct keeps the probed size apart from whatever columns the videos have
    known = videos.alias("v").join(first.alias("f"), F.col("v.video_id") == F.col("f.probed_id"), "left")
    width, height = F.col("f.first.probe_width"), F.col("f.first.probe_height")
    unknown = (F.col("v.width") <= 0) | (F.col("v.height") <= 0)
    filled = {
        "width": F.when(unknown, width).otherwise(F.col("v.width")),
        "height": F.when(unknown, height).otherwise(F.col("v.height")),
    }
    error = F.when(unknown & width.isNull(), F.lit("Could not read video frame to determine dimensions"))
    return known.select(*(filled.get(c, F.col(f"v.{c}")).alias(c) for c in videos.columns), error.alias("error"))


def sampling_plan(videos: DataFrame, params: DataFrame) -> DataFrame:
    """Steps, lead-in, first index and limits of each video's selection."""
    step, every = F.col("frame_step"), S.at_least_one(F.col("select_every_nth"))
    lead = F.when(step > 1, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return (
        with_params(videos, params)
        .withColumn("frame_step", S.frame_step(F.col("original_fps"), F.col("framerate")))
        .select(
            "video_id", "total_frames", "original_fps", "framerate", "select_every_nth", "frame_load_cap", "frame_step",
            (every * step).alias("combined_step"), lead.alias("lead_in"),
            (F.col("skip_first_frames") + lead).alias("start_index"),
        )
    )


def selection_bounds(plan: DataFrame, use_cap: bool = True, limit: Column | None = None) -> DataFrame:
    """Start, stride, cap and limit of every video's selection."""
    return plan.select(
        "video_id", "start_index", "combined_step",
        (F.col("frame_load_cap") if use_cap else F.lit(0)).cast("bigint").alias("cap"),
        (limit if limit is not None else F.lit(None)).cast("bigint").alias("limit"),
    )


def select_frames(frames: DataFrame, plan: DataFrame, use_cap: bool = True, limit: Column | None = None,
                  unreadable: DataFrame | None = None) -> DataFrame:
    """Readable frames the plan selects, with their ``position`` in the selection.

    The position follows from the index alone, so a cap per video is a filter: no window, no sort.
    ``limit`` is one more cap, as a column of the plan. ``unreadable`` (``video_id, first_bad``) saves looking for it; frames
    stored by ``frame_store`` are read up to the cap only.
    """
    known = first_unreadable(frames) if unreadable is None else unreadable
    bounds = selection_bounds(plan, use_cap, limit).join(known, "video_id", "left")
    offset = F.col("frame_index") - F.col("start_index")
    chosen = (
        (F.col("first_bad").isNull() | (F.col("frame_index") < F.col("first_bad")))
        & (offset >= 0) & (offset % F.col("combined_step") == 0)
        & ((F.col("cap") <= 0) | (F.col("position") < F.col("cap")))
        & (F.col("limit").isNull() | (F.col("position") < F.col("limit")))
    )
    position = F.floor(offset / F.col("combined_step")).cast("bigint")
    return (
        _per_video(frames, bounds).withColumn("position", position).filter(chosen)
        .select(*frames.columns, "position")
    )


def preview_limit(text: Column) -> Column:
    """Preview size from a request text."""
    return int_param(text, S.PREVIEW_DEFAULT, 1, S.PREVIEW_MAX)


def preview_frames(frames: DataFrame, plan: DataFrame, params: DataFrame, limit_text: str = "max_preview_text") -> DataFrame:
    """The selection of each video, cut to its preview size as well."""
    asked = plan.join(params.select("video_id", limit_text), "video_id", "left")
    return select_frames(frames, asked, limit=preview_limit(F.col(limit_text)))


def sequence_stats(selected: DataFrame, plan: DataFrame) -> DataFrame:
    """Selection size and speed per video with at least one selected frame.

    Selected indices form a progression; first, last and step state it whatever its length.
    """
    counts = selected.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("frame_count"), F.min("frame_index").alias("first_index"),
        F.max("frame_index").alias("last_index"),
    )
    fps = S.effective_fps(F.col("original_fps"), F.col("framerate"), F.col("select_every_nth"))
    return counts.join(plan, "video_id").select(
        "video_id", "frame_count", "first_index", "last_index", fps.alias("effective_fps"),
        F.col("original_fps").cast("bigint").alias("original_fps"), "total_frames", "frame_step", "combined_step",
    )


def empty_selection_report(plan: DataFrame, selected: DataFrame) -> DataFrame:
    """Videos no frame was selected from."""
    return plan.join(selected.select("video_id").distinct(), "video_id", "left_anti").select(
        "video_id", F.lit("No frames loaded from video").alias("error")
    )


def frame_lookup(requests: DataFrame, frames: DataFrame) -> DataFrame:
    """One frame per request; numbers below 0 mean the first frame, unreadable or absent frames give null."""
    keys = ["video_id", "frame_index"]
    wanted = requests.withColumn("frame_index", F.greatest(F.lit(0).cast("bigint"), F.col("n")))
    return wanted.join(frames.filter("readable").drop("readable"), keys, "left")


def _lasting(stats: DataFrame, *cols: str) -> DataFrame:
    return stats.select("video_id", "frame_count", S.playback_ms(F.col("effective_fps")).alias("duration_ms"), *cols)


def frame_timeline(selected: DataFrame, stats: DataFrame) -> DataFrame:
    """Time span each selected frame is shown for, in milliseconds."""
    return _per_video(selected, _lasting(stats)).withColumns({
        "start_ms": F.col("position") * F.col("duration_ms"),
        "end_ms": (F.col("position") + 1) * F.col("duration_ms"),
    })


def frame_at_time(probes: DataFrame, stats: DataFrame) -> DataFrame:
    """The frame a looping playback shows ``at_ms`` after its start.

    Position and index follow from the video's progression, so the frames themselves are not read.
    """
    shown = probes.join(_lasting(stats, "first_index", "combined_step"), "video_id")
    position = F.pmod(F.floor(F.col("at_ms") / F.col("duration_ms")), F.col("frame_count")).cast("bigint")
    return shown.withColumn("position", position).select(
        *probes.columns, "position", (F.col("first_index") + F.col("position") * F.col("combined_step")).alias("frame_index")
    )


def padded_frames(stats: DataFrame, col: str = "frame_count") -> DataFrame:
    """Length each selection is padded to, and by how many frames."""
    return stats.withColumn("wan_frames", S.padded_length(F.col(col))).withColumn(
        "pad_frames", F.col("wan_frames") - F.col(col)
    )


def load_params_clean(df: DataFrame, spec: dict[str, tuple[int, int | None, int | None]]) -> DataFrame:
    """Text parameters to integers; ``spec`` maps a column to (default, minimum, maximum)."""
    return df.withColumns({name: int_param(F.col(name), *bounds) for name, bounds in spec.items()})


# Defaults and bounds of the load parameters.
LOAD_PARAMS = {
    "framerate": (0, 0, None),
    "custom_width": (0, 0, None),
    "custom_height": (0, 0, None),
    "frame_load_cap": (0, 0, None),
    "skip_first_frames": (0, 0, None),
    "select_every_nth": (1, 1, None),
    "max_preview_frames": (S.PREVIEW_DEFAULT, 1, S.PREVIEW_MAX),
}
