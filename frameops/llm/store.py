"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local session without the setting gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and lost executors lose nothing.

    The table goes when the application ends, or earlier with :func:`dropped`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder, system = _folder(spark, path)
    system.deleteOnExit(folder)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def dropped(table: DataFrame) -> None:
    """Remove a table made by :func:`stored` that nothing reads any more."""
    folder, system = _folder(table.sparkSession, table._stored_at)
    system.delete(folder, True)
