"""The mask-region log as running queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from frameops.functions.region import with_region
from frameops.operators.masklog import ORDER, writes


def mask_state_changes(events: DataFrame) -> DataFrame:
    """Running last write and write count per node; emit in update mode. A node without a name has no versions: 0.

    State is one row per node. Order comes from ``(ts, event_id)``, so late rows need no watermark: an old
    write never replaces a newer one.
    """
    return (
        writes(events).groupBy("node_id")
        .agg(F.max_by(F.struct("op", "payload"), F.struct(*ORDER)).alias("last"), F.count_if(F.col("node_id") != "").alias("version"))
    )


def current_state(changes: DataFrame) -> DataFrame:
    """Newest change per node: its region, null after a clear, and its version.

    A node's last batch carries its complete state, so the newest row per node is the table.
    """
    newest = changes.groupBy("node_id").agg(F.max_by(F.struct("last", "version"), "batch").alias("state"))
    flat = newest.select("node_id", "state.last.op", "state.last.payload", "state.version")
    held = F.when(F.col("op") == "set", F.col("region"))
    return with_region(flat, "payload", or_empty=True).select("node_id", "op", held.alias("region"), "version")


def debounce_stream(events: DataFrame, gap: str = "250 milliseconds", delay: str = "1 second", key: str = "node_id") -> DataFrame:
    """Last event of each burst per key; a burst is emitted once the watermark has passed it."""
    timed = events.filter(F.col(key).isNotNull()).withColumn("ts", F.col("ts").cast("timestamp"))
    payload = F.struct(*[c for c in timed.columns if c != key])
    return (
        timed.withWatermark("ts", delay)
        .groupBy(key, F.session_window("ts", gap))
        .agg(F.max_by(payload, F.struct(*ORDER)).alias("last"))
        .select(key, "last.*")
    )


EVENT = T.StructType([T.StructField("key", T.StringType()), T.StructField("at", T.LongType()),
                      T.StructField("event_id", T.LongType()), T.StructField("body", T.StringType())])
#: Held events of one bucket as a list per column, each with the time its timer runs out.
HELD = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in [*EVENT.fields, T.StructField("due", T.LongType())]])
#: Keys that share a state and a timer. Fixed for the life of a checkpoint.
BUCKETS = 1024


class BurstEnds(StatefulProcessor):
    """Last event of each burst of every key of a bucket. The newest event of a key is held until one comes a gap later, or its time runs out.

    A call to the state store costs the same for one key as for many, so the keys of a bucket are held together, each with a time of its own;
    the bucket's one timer is set to the earliest. Events of a micro-batch are summed up in cells of the gap's length, as ``debounce_changes``
    does, so a busy key costs memory for its cells and not for its events.
    """

    def __init__(self, gap_micros: int, idle_ms: int):
        self.gap, self.idle = gap_micros, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)

    def _cells(self, events: pd.DataFrame) -> pd.DataFrame:
        """One row per key and cell, in order: the last event and the time of the first."""
        ordered = events.assign(k=pd.factorize(events["key"])[0]).sort_values(["k", "cell", "at", "event_id"], na_position="first")
        cells = ordered.drop_duplicates(["k", "cell"], keep="last")
        return cells.assign(first=ordered.groupby(["k", "cell"], sort=False)["first"].min().to_numpy())

    def _timed(self, events: pd.DataFrame) -> pd.DataFrame:
        """Events that have a time, as cells of their own."""
        timed = events.loc[events["at"].notna(), EVENT.names].astype({"at": "int64", "event_id": "Int64"})
        return timed.assign(cell=timed["at"] // self.gap, first=timed["at"])

    def _known(self) -> pd.DataFrame:
        columns = self.held.get() if self.held.exists() else [[] for _ in HELD]
        return pd.DataFrame(dict(zip(HELD.names, map(list, columns)))).astype({"at": "int64", "event_id": "Int64", "due": "int64"})

    def _hold(self, held: pd.DataFrame) -> None:
        self.held.update(tuple([None if v is pd.NA else v for v in held[name].tolist()] for name in HELD.names))
        due, timers = int(held["due"].min()), list(self.handle.listTimers())
        for timer in timers:
            if timer != due:
                self.handle.deleteTimer(timer)
        if due not in timers:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cells = None
        for part in rows:
            part = self._cells(self._timed(part))
            cells = part if cells is None else self._cells(pd.concat([cells, part]))
        if cells is None or cells.empty:
            return
        known = self._known()
        touched = known["key"].isin(cells["key"])
        if touched.any():
            cells = self._cells(pd.concat([cells, self._timed(known[touched])]))
        goes_on = cells["k"].eq(cells["k"].shift(-1))
        apart = cells["cell"].shift(-1).ne(cells["cell"] + 1) | cells["first"].shift(-1).ge(cells["at"] + self.gap)
        newest = cells.loc[~goes_on, EVENT.names].assign(due=timerValues.getCurrentProcessingTimeInMs() + self.idle)
        self._hold(newest if touched.all() else pd.concat([known[~touched], newest]))
        done = cells.loc[goes_on & apart, EVENT.names]
        if not done.empty:
            yield done

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._known()
        over = known["due"] <= timerValues.getCurrentProcessingTimeInMs()
        if over.all():
            self.held.clear()
        else:
            self._hold(known[~over])
        if over.any():
            yield known.loc[over, EVENT.names]

    def close(self) -> None:
        pass


def debounce_timers(events: DataFrame, gap: str = "250 milliseconds", idle: str | None = None, key: str = "node_id") -> DataFrame:
    """Last event of each burst per key, the newest one as soon as its key has been quiet for ``idle`` (by the clock; ``gap`` by default).

    No later event is needed, as a watermark would. An event that comes after a newer one of its burst was held changes nothing; one that
    is a gap or more older than anything held is a burst of its own. Events without a key are left out. Emit in update mode.
    """
    spark = events.sparkSession
    micros = spark.range(1).select(*(F.unix_micros(F.lit(0).cast("timestamp") + F.expr(f"INTERVAL '{t}'")) for t in (gap, idle or gap))).first()
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    body = F.to_json(F.struct(*(c for c in events.columns if c not in (key, "ts", "event_id"))))
    packed = events.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("key"), at.alias("at"), F.col("event_id").cast("long"), body.alias("body"))
    bucketed = packed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    ends = bucketed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=BurstEnds(micros[0], max(1, micros[1] // 1000)), outputStructType=EVENT, outputMode="Update", timeMode="ProcessingTime")
    kinds = {f.name: f.dataType for f in events.schema.fields}
    others = T.StructType([f for f in events.schema.fields if f.name not in (key, "ts", "event_id")])
    whole = ends.withColumn("body", F.from_json("body", others))
    return whole.select(*(
        F.col("key").cast(kinds[c]).alias(c) if c == key else F.timestamp_micros("at").cast(kinds[c]).alias(c) if c == "ts"
        else F.col("event_id").cast(kinds[c]) if c == "event_id" else F.col(f"body.{c}") for c in events.columns))
