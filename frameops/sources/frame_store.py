"""Frames stored in runs of a video, so that a selection reads the runs it touches and stops at its cap.

A zone's folder holds one run of indices of a number of neighbouring videos, sorted by video and index. Where a video
stops being readable is stored beside, so no selection scans for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from frameops.operators import frames as FR
from frameops.sources.zones import pruned

#: Runs of a video; a zone's number holds the run in as many bits.
MOST_RUNS = 1 << 24


@dataclass(frozen=True)
class FrameStore:
    """Frames under ``path``. Files suit a cluster best when ``run * videos`` frames make about 100 MB."""

    spark: SparkSession
    path: str
    schema: StructType
    run: int = 256
    videos: int = 64

    def _zone(self, video_id: Column, part: Column) -> Column:
        return F.floor(video_id / self.videos).cast("long") * MOST_RUNS + part

    def write(self, frames: DataFrame) -> "FrameStore":
        """Store ``frames``: every zone by one task, at most ``run * videos`` frames."""
        part = F.floor(F.col("frame_index") / self.run).cast("long")
        placed = frames.withColumn("zone", self._zone(F.col("video_id"), part)).repartition("zone")
        placed.sortWithinPartitions("zone", "video_id", "frame_index").write.partitionBy("zone").parquet(f"{self.path}/frames")
        FR.first_unreadable(self.frames()).write.parquet(f"{self.path}/unreadable")
        return self

    def frames(self) -> DataFrame:
        """All frames with their ``zone``."""
        return self.spark.read.schema(StructType([*self.schema.fields]).add("zone", "long")).parquet(f"{self.path}/frames")

    def unreadable(self) -> DataFrame:
        """``video_id, first_bad`` of videos that hold an unreadable frame."""
        return self.spark.read.schema("video_id long, first_bad long").parquet(f"{self.path}/unreadable")

    def select(self, plan: DataFrame, use_cap: bool = True, limit: Column | None = None) -> DataFrame:
        """``frames.select_frames`` of the stored frames. Runs before the start and after the last frame within the cap are not read."""
        bounds = FR.selection_bounds(plan, use_cap, limit).join(self.unreadable(), "video_id", "left")
        most = F.least(F.when(F.col("cap") > 0, F.col("cap")), F.col("limit"))
        last = F.least(F.col("total_frames") - 1, F.col("first_bad") - 1, F.col("start_index") + (most - 1) * F.col("combined_step"))
        ends = bounds.join(plan.select("video_id", "total_frames"), "video_id").select("video_id", "start_index", "combined_step", last.alias("last"))
        hit = ends.filter((F.col("start_index") >= 0) & (F.col("start_index") <= F.col("last")))
        parts = hit.withColumn("part", F.explode(F.sequence(
            F.floor(F.col("start_index") / self.run).cast("long"), F.floor(F.col("last") / self.run).cast("long"))))
        # a wide stride steps over whole runs
        first_in = F.col("start_index") + F.ceil((F.greatest(F.col("start_index"), F.col("part") * self.run) - F.col("start_index"))
                                                 / F.col("combined_step")) * F.col("combined_step")
        touched = parts.filter((first_in < (F.col("part") + 1) * self.run) & (first_in <= F.col("last")))
        wanted = touched.select("video_id", self._zone(F.col("video_id"), F.col("part")).alias("zone"), "part")
        frames = pruned(self.frames(), wanted, ["video_id"]).select(*self.schema.names)
        return FR.select_frames(frames, plan, use_cap, limit, self.unreadable())

    def preview(self, plan: DataFrame, params: DataFrame, limit_text: str = "max_preview_text") -> DataFrame:
        """``frames.preview_frames`` of the stored frames."""
        asked = plan.join(params.select("video_id", limit_text), "video_id", "left")
        return self.select(asked, limit=FR.preview_limit(F.col(limit_text)))
