"""Operators on enlarged tables in which one key holds a third of all rows.

Prints, per operator, the seconds taken and the share of the result that its fullest partition holds.
Broadcasting is switched off, so every lookup takes the shuffled path.
Usage: python stress.py [sf_dir] [copies]
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, functions as F

from frameops import build_session
from frameops.operators import frames as V, geometry as G, masklog as E, palette as P
from frameops.operators.lattice import lattice
from frameops.operators.resize import resize_pixels
from workload import fixtures as X

PARTITIONS = 32


def busiest_share(df: DataFrame) -> tuple[int, float]:
    """Rows of the result and the share of the partition holding most of them."""
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return sum(counts), max(counts) / max(1, sum(counts))


def main(sf_dir: str = "/root/testdata/sf0.1", copies: int = 20) -> None:
    spark = build_session(
        "stress", "local[8]", spark__sql__shuffle__partitions=str(PARTITIONS), spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g", spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    events = X.read(spark, sf_dir, "events")
    many = events.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumns({
        "event_id": F.col("event_id") * copies + F.col("copy"),
        "ts": F.col("ts") + F.make_dt_interval(secs=F.col("copy")),
        "user_id": F.when(F.col("event_id") % 3 == 0, F.lit(7)).otherwise(F.col("user_id")).cast("bigint"),
    })
    folder = f"{spark.sparkContext.getCheckpointDir() or '/tmp'}/stress-{int(time.time())}"
    many.drop("copy").write.parquet(f"{folder}/events.parquet")
    spark.read.parquet(f"{sf_dir}/supplier.parquet").withColumn(
        "s_nationkey", F.when(F.col("s_suppkey") % 3 == 0, F.lit(7)).otherwise(F.col("s_nationkey")).cast("int")
    ).write.parquet(f"{folder}/supplier.parquet")

    frames, videos, params = X.frames(spark, folder), X.videos(spark, folder), X.video_params(spark, folder)
    log = X.mask_events(spark, folder)
    images = X.images(spark, folder)
    huge = spark.createDataFrame([(1, 1, 1600, 1200), (2, 1, 800, 600), (3, 2, 900, 900)], "image_id long, batch_id long, width int, height int")
    scene = lattice(huge, "width", "height").selectExpr(
        "batch_id", "image_id", "y", "x", "CAST((x*7 + y) % 256 AS INT) r", "CAST((x + y*3) % 256 AS INT) g", "CAST((x*y) % 256 AS INT) b")
    plan = V.sampling_plan(videos, params)
    jobs = {
        "skewed join": lambda: frames.join(videos, "video_id"),
        "select_frames": lambda: V.select_frames(frames, plan, use_cap=False),
        "debounce_changes": lambda: E.debounce_changes(log.filter("op = 'param'"), "100 milliseconds"),
        "latest_region": lambda: E.latest_region(log),
        "rotate_pixels, one image with half of the pixels": lambda: G.rotate_pixels(scene, huge, 30),
        "resize_pixels, the same image": lambda: resize_pixels(scene, huge, huge.selectExpr(
            "image_id", "CAST(width / 2 AS INT) AS target_width", "CAST(height / 2 AS INT) AS target_height")),
        "pose_only_fill, hot batch": lambda: G.pose_setup(
            X.pixels(spark, folder), images, X.mask_pixels(spark, folder), "#102030", 5, -3, 4, -2, only_fill=True),
        "distinct_palette, hot batch": lambda: P.distinct_palette(X.pixels(spark, folder)),
        "nearest_palette_color, hot batch": lambda: P.nearest_palette_color(X.pixels(spark, folder), P.pixel_grid_sample(X.pixels(spark, folder))),
        "fit_to_size": lambda: G.fit_to_size(X.pixels(spark, folder), images, 31, 13),
    }
    for name, job in jobs.items():
        start = time.time()
        rows, share = busiest_share(job())
        print(f"{name}: {rows} rows, {time.time() - start:.1f}s, busiest of {PARTITIONS} partitions holds {share:.1%}", flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:2], *map(int, sys.argv[2:3]))
