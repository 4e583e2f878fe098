"""Tables in one folder per zone, read by a list of what is wanted."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from frameops.session import drop_at_exit, shared_dir


def pruned(table: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``table`` whose ``keys`` and ``zone`` are listed in ``wanted``; only the listed zones' folders are read.

    ``wanted`` has distinct ``(*keys, zone)`` rows and ``part``, the number of the part that a zone holds, 0 or more. It is stored
    first: it is read twice, and folders are pruned only by a plain scan and filter.
    """
    spark = table.sparkSession
    path = f"{shared_dir(spark)}/wanted-{uuid.uuid4().hex}"
    wanted.write.parquet(path)
    drop_at_exit(spark, path)
    listed = spark.read.schema(wanted.schema).parquet(path).filter("part >= 0").drop("part")
    # proven bound: a number per folder of the table, which the driver lists in any case
    zones = F.broadcast(listed.select("zone").distinct())
    return table.join(zones, "zone").join(listed, [*keys, "zone"])
