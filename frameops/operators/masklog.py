"""State kept by a log of mask-region events.

Events are ordered by ``(ts, event_id)``, so results do not depend on arrival order. Every state is an
aggregate that is combined before the shuffle: one node with most of the events costs each task one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from frameops.functions.region import with_region

ORDER = ("ts", "event_id")


def writes(events: DataFrame) -> DataFrame:
    """Accepted set and clear events: those that name a node."""
    return events.filter(F.col("op").isin("set", "clear") & F.col("node_id").isNotNull())


def latest_region(events: DataFrame, key: str = "node_id") -> DataFrame:
    """Last region per node, or per video.

    A clear removes a node's region. Videos only remember sets; clears do not reach them. A set without a
    usable payload leaves the empty region. Only the last payload of each key is parsed.
    """
    accepted = writes(events)
    if key == "video":
        accepted = accepted.filter((F.col("op") == "set") & (F.coalesce(F.col("video"), F.lit("")) != ""))
    last = accepted.groupBy(key).agg(F.max_by(F.struct("op", "payload"), F.struct(*ORDER)).alias("last"))
    sets = last.filter("last.op = 'set'").select(key, F.col("last.payload").alias("payload"))
    return with_region(sets, "payload", or_empty=True).select(key, "region")


def mask_version(events: DataFrame) -> DataFrame:
    """How often each node was set or cleared."""
    return writes(events).filter(F.col("node_id") != "").groupBy("node_id").agg(F.count(F.lit(1)).alias("version"))


def mtime_text(mtime_ms: Column) -> Column:
    """Seconds as a decimal text with at least one digit after the point."""
    fraction = F.lpad(F.pmod(mtime_ms, F.lit(1000)).cast("string"), 3, "0")
    fraction = F.regexp_replace(fraction, "(?<=.)0+$", "")
    return F.concat(F.floor(mtime_ms / 1000).cast("bigint").cast("string"), F.lit("."), fraction)


def change_fingerprint(videos: DataFrame, versions: DataFrame, files: DataFrame) -> DataFrame:
    """Text that changes whenever a video's file or its mask does.

    ``videos`` has ``video_id, name, node_id``, ``files`` has ``name, mtime_ms``.
    """
    known = videos.join(files.select("name", "mtime_ms"), "name", "left")
    known = known.join(versions, "node_id", "left")
    stamp = F.coalesce(mtime_text(F.col("mtime_ms")), F.lit("missing"))
    version = F.coalesce(F.col("version"), F.lit(0)).cast("string")
    return known.select("video_id", F.concat_ws("_", stamp, version).alias("fingerprint"))


def stale_videos(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Videos to run again: new ones and those whose fingerprint differs from the last run's."""
    before = previous.select("video_id", F.col("fingerprint").alias("previous"))
    return current.join(before, "video_id", "left").filter(~F.col("fingerprint").eqNullSafe(F.col("previous")))


def debounce_changes(events: DataFrame, gap: str = "250 milliseconds", key: str = "node_id") -> DataFrame:
    """Last event of each burst per key: the next one is at least ``gap`` later, or there is none.

    Time is cut into cells of the gap's length. Only the last event of a cell can end a burst, and only the first event
    of the next cell can still prolong it. So cells are summed up, combined before the shuffle, and joined with the
    next cell: nothing is sorted, and a key with all its events in one hour is no larger a group than any other.
    """
    width = F.expr(f"INTERVAL '{gap}'")
    micros = F.unix_micros(F.lit(0).cast("timestamp") + width)
    cell = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / micros)
    row = F.struct(*(c for c in events.columns if c != key))
    cells = events.filter(F.col(key).isNotNull()).groupBy(F.col(key), cell.alias("_cell")).agg(
        F.max_by(row, F.struct(*ORDER)).alias("_last"), F.min("ts").alias("_first"))
    following = cells.select(key, (F.col("_cell") - 1).alias("_cell"), F.col("_first").alias("_next"))
    ends = cells.join(following, [key, "_cell"], "left").filter(F.col("_next").isNull() | (F.col("_next") >= F.col("_last.ts") + width))
    return ends.select(key, "_last.*").select(*events.columns)
