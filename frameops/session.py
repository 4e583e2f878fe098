"""Session settings and the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot partition even when that costs one more exchange further up
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # one row per node may outgrow the executors' heaps
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "frameops", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings these jobs are written for; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return root or spark.conf.get("spark.sql.warehouse.dir")


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Remove ``path`` when the application ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


def wide(spark: SparkSession) -> int:
    """Partition count for rows that are few now and explode into many later.

    Adaptive execution would coalesce them by their small size of today, so the
    count is given explicitly. A cluster may still be growing when it is asked for its cores.
    """
    context = spark.sparkContext
    if context.master.startswith("local"):
        return context.defaultParallelism
    return max(context.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
