"""Times the headline queries: one JSON line with seconds per query, the faster of two runs each."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from frameops import build_session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

RUNS = 2
HEADLINE = [
    "color_standardize", "rgb_to_hsv", "distinct_palette", "nearest_palette_color", "farthest_color", "rotate_pixels",
    "fit_to_size", "mask_union", "pose_crop_fill", "pose_only_fill", "resize_pixels", "lasso_mask", "readable_prefix",
    "select_frames", "sequence_stats", "preview_manifest", "frame_at_time", "wan_frames", "region_mask", "region_crop",
    "latest_region_by_node", "mask_version", "stale_videos", "stream_mask_state", "debounce_changes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds = {}
    for name in names:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    print(json.dumps({
        "metric": "total time of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus), "runs": RUNS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
