"""Writing selected frames and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from frameops.functions import sampling as S

# Fixed value: name of a written frame, from the node and the position in the selection.
FRAME_NAME = "vme_frame_%s_%04d.png"
FRAMES_PER_FILE = 4096


def frame_sink_manifest(selected: DataFrame) -> DataFrame:
    """Selected frames with the name each is written under."""
    return selected.withColumn(
        "file_name", F.format_string(FRAME_NAME, F.col("video_id").cast("string"), F.col("position"))
    )


def write_frames(selected: DataFrame, path: str) -> None:
    """Write selected frames with their names; bytes stay as they are.

    Frames are clustered by video in runs of ``FRAMES_PER_FILE``, so a long video is several runs.
    """
    run = F.floor(F.col("position") / FRAMES_PER_FILE)
    (
        frame_sink_manifest(selected).withColumn("run", run)
        .repartition("video_id", "run").sortWithinPartitions("video_id", "position")
        .drop("run").write.mode("overwrite").parquet(path)
    )


def preview_manifest(preview: DataFrame, stats: DataFrame, sizes: DataFrame, data: str = "payload_text") -> DataFrame:
    """One JSON document per video with its preview frames.

    ``frame_count`` is the container's total, not the number of frames in the preview. ``preview`` holds
    at most the preview limit per video, which bounds the list.
    """
    sized = preview.join(sizes.select("video_id", "target_width", "target_height"), "video_id")
    frame = F.struct(
        F.col("position").alias("index"), F.base64(F.col(data).cast("binary")).alias("data"),
        F.col("target_width").alias("width"), F.col("target_height").alias("height"),
    )
    lists = sized.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("position", "frame_index", frame.alias("frame")))).alias("f"))
    document = F.to_json(F.struct(
        F.col("f.frame").alias("frames"), F.col("effective_fps").alias("fps"), "original_fps",
        F.col("f.frame_index").alias("selected_frame_indices"), F.col("total_frames").alias("frame_count"),
    ))
    return lists.join(stats, "video_id").select(
        "video_id", F.array_join(F.col("f.frame_index").cast("array<string>"), ",").alias("selected_frame_indices"),
        F.array_join(F.col("f.frame.data"), ",").alias("frame_data"), F.size("f").cast("bigint").alias("n_frames"),
        F.col("effective_fps").alias("fps"), "original_fps", F.col("total_frames").alias("frame_count"),
        document.alias("document"),
    )


def preview_fps(plan: DataFrame) -> DataFrame:
    """The speed and totals a preview reports."""
    fps = S.effective_fps(F.col("original_fps"), F.col("framerate"), F.col("select_every_nth"))
    return plan.select("video_id", fps.alias("effective_fps"), F.col("original_fps").cast("bigint").alias("original_fps"), "total_frames")
