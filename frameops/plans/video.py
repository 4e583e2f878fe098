"""Whole jobs over many videos: loading, previewing, finding what to run again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from frameops.operators import frames as FR, masklog as L, regions as R
from frameops.operators.resize import resize_pixels
from frameops.sources import sinks


@dataclass(frozen=True)
class LoadedVideos:
    selected: DataFrame
    stats: DataFrame
    masks: DataFrame
    failed: DataFrame


def load_videos(videos: DataFrame, params: DataFrame, frames: DataFrame, events: DataFrame) -> LoadedVideos:
    """Select every video's frames by its parameters and give each the mask of its node.

    A node's id is the video's id as text. ``failed`` lists videos without dimensions or without frames.
    """
    sized = FR.probe_dimensions(videos, frames)
    known = sized.filter(F.col("error").isNull()).drop("error")
    plan = FR.sampling_plan(known, params)
    selected = FR.select_frames(frames, plan)
    stats = FR.sequence_stats(selected, plan)
    regions = L.latest_region(events).select(F.col("node_id").try_cast("bigint").alias("video_id"), "region")
    masks = R.region_mask(selected, regions, FR.target_size(known, params))
    failed = sized.filter(F.col("error").isNotNull()).select("video_id", "error").unionByName(
        FR.empty_selection_report(plan, selected)
    )
    return LoadedVideos(selected, stats, masks, failed)


def load_pixels(loaded: LoadedVideos, pixels: DataFrame, frame_images: DataFrame, crop_to_mask: bool = False) -> DataFrame:
    """Pixels of the selected frames at their target size, cut to the mask's rectangle if wanted.

    ``frame_images`` says which image holds which frame: ``image_id, batch_id, width, height, video_id,
    frame_index``. Frames without a rectangle are never cut. Images of other frames are left out first.
    """
    masks = loaded.masks.select("video_id", "frame_index", "target_width", "target_height", *(f"mask_{s}" for s in R.SIDES))
    chosen = frame_images.join(masks, ["video_id", "frame_index"])
    images = chosen.select("image_id", "batch_id", "width", "height")
    wanted = pixels.join(images.select("image_id"), "image_id", "left_semi")
    resized = resize_pixels(wanted, images, chosen.select("image_id", "target_width", "target_height"))
    if not crop_to_mask:
        return resized
    rectangles = chosen.select(
        "image_id", F.struct(*(F.col(f"mask_{s}").cast("bigint").alias(s) for s in R.SIDES)).alias("region")
    )
    sized = chosen.select("image_id", "batch_id", F.col("target_width").alias("width"), F.col("target_height").alias("height"))
    return R.region_crop(resized, sized, rectangles)


@dataclass(frozen=True)
class Previews:
    documents: DataFrame
    failed: DataFrame


def preview_videos(videos: DataFrame, params: DataFrame, frames: DataFrame, data: str = "payload_text") -> Previews:
    """Preview document of every video that has frames; parameters carry ``max_preview_text``.

    Sizes missing from a header are probed first. ``failed`` lists videos without dimensions or without frames.
    """
    sized = FR.probe_dimensions(videos, frames)
    known = sized.filter(F.col("error").isNull()).drop("error")
    plan = FR.sampling_plan(known, params)
    shown = FR.preview_frames(frames, plan, params)
    documents = sinks.preview_manifest(shown, sinks.preview_fps(plan), FR.target_size(known, params), data)
    failed = sized.filter(F.col("error").isNotNull()).select("video_id", "error").unionByName(FR.empty_selection_report(plan, shown))
    return Previews(documents, failed)


def videos_to_rerun(videos: DataFrame, files: DataFrame, events: DataFrame, previous: DataFrame) -> DataFrame:
    """Videos whose file or mask changed since the ``previous`` fingerprints."""
    return L.stale_videos(L.change_fingerprint(videos, L.mask_version(events), files), previous)
