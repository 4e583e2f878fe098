"""Tables written by running queries."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from frameops.session import DEFAULTS, drop_at_exit, shared_dir

STORE = "spark.sql.streaming.stateStore.providerClass"


class StreamTable:
    """A table in the shared folder that one streaming query writes.

    Each micro-batch writes its own folder and overwrites it when it is repeated after a failure, so
    every batch counts once. Table and checkpoint are found again by ``name``, so a stopped query goes on where it
    was. A ``temporary`` table has a folder of its own, which is removed when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str, root: str | None = None, temporary: bool = False):
        self.spark = spark
        own = f"{name}-{uuid.uuid4().hex}" if temporary else name
        self.base = f"{(root or shared_dir(spark)).rstrip('/')}/frameops/{own}"
        self.path, self.checkpoint = f"{self.base}/table", f"{self.base}/checkpoint"
        if temporary:
            drop_at_exit(spark, self.base)

    def _folder(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self) -> list[int]:
        """Batches that are written completely."""
        folder, files = self._folder(self.path)
        names = [s.getPath() for s in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(int(n.getName().split("=")[1]) for n in names if n.getName().startswith("batch=")
                      and files.exists(self._folder(f"{n}/_SUCCESS")[0]))

    def _write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def start(self, stream: DataFrame, output_mode: str, available_now: bool = False):
        writer = (
            stream.writeStream.outputMode(output_mode).foreachBatch(self._write)
            .option("checkpointLocation", self.checkpoint)
        )
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def drain(self, stream: DataFrame, output_mode: str) -> DataFrame:
        """Process everything available now and return what was written."""
        self.start(stream, output_mode, available_now=True).awaitTermination()
        return self.read(stream)

    @staticmethod
    def _settled(query) -> bool:
        """Whether the last batch found nothing new and left nothing held."""
        last = query.lastProgress
        return last is not None and last.numInputRows == 0 and not any(state.numRowsTotal for state in last.stateOperators)

    def settle(self, stream: DataFrame, output_mode: str, every: str = "500 milliseconds", most_seconds: float = 3600) -> DataFrame:
        """Process everything there is, wait until no key is held by a timer any more, and return what was written."""
        writer = stream.writeStream.outputMode(output_mode).foreachBatch(self._write).option("checkpointLocation", self.checkpoint)
        # a query takes the settings of the moment it starts; only this store keeps timers
        before = self.spark.conf.get(STORE)
        self.spark.conf.set(STORE, DEFAULTS[STORE])
        try:
            query = writer.trigger(processingTime=every).start()
        finally:
            self.spark.conf.set(STORE, before)
        try:
            # timers keep empty batches going, so the query never counts as having processed all there is
            end = time.monotonic() + most_seconds
            while not self._settled(query):
                if query.exception() or time.monotonic() > end:
                    raise query.exception() or TimeoutError(f"keys are still held after {most_seconds} seconds")
                time.sleep(0.1)
            # let the batch of this moment end, but no more: batches longer than ``every`` follow each other without a pause
            settled = query.lastProgress.batchId
            while query.status["isTriggerActive"] and query.lastProgress.batchId <= settled and time.monotonic() < end:
                time.sleep(0.01)
        finally:
            query.stop()
        return self.read(stream)

    def read(self, stream: DataFrame) -> DataFrame:
        """What complete batches wrote, with its ``batch``; empty before the first batch."""
        schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
        done = self._batches()
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*(f"{self.path}/batch={b}" for b in done))


class StateTable(StreamTable):
    """The newest row per key of a query in update mode, folded batch by batch: it is as large as its keys.

    A batch is merged with the state before it into a folder of its own; older states go. A repeated
    batch starts from the state before it again.
    """

    def __init__(self, spark: SparkSession, name: str, key: str, root: str | None = None, temporary: bool = False):
        super().__init__(spark, name, root, temporary)
        self.key = key

    def _write(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("_at", F.lit(batch_id).cast("long"))
        before = [b for b in self._batches() if b < batch_id]
        if before:
            rows = rows.unionByName(self.spark.read.schema(rows.schema).parquet(f"{self.path}/batch={before[-1]}"))
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*rows.columns), "_at").alias("row")).select("row.*")
        newest.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        for old in before[:-1]:
            folder, files = self._folder(f"{self.path}/batch={old}")
            files.delete(folder, True)

    def read(self, stream: DataFrame) -> DataFrame:
        """The state after the last batch, with the ``batch`` that last changed a row."""
        schema = T.StructType([*stream.schema.fields, T.StructField("_at", T.LongType())])
        done = self._batches()
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/batch={done[-1]}") if done else \
            self.spark.createDataFrame([], schema)
        return rows.withColumnRenamed("_at", "batch")
