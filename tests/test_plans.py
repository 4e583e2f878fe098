"""What the registered queries' plans may not contain."""

import re

import pytest

from workload import fixtures as X
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
ROWWISE = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroups", "MapInPandas", "MapInArrow", "PythonUDF")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_pairs_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", *ROWWISE):
        assert bad not in plan


def test_scans_read_only_what_is_used(spark):
    plan = plan_of(QUERIES["mask_version"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan
    plan = plan_of(QUERIES["media_catalog"](spark, SF))
    assert "ReadSchema: struct<c_custkey:bigint>" in plan


def test_turning_and_fitting_do_not_shuffle_pixels(no_broadcast):
    for name in ("rotate_pixels", "fit_to_size"):
        plan = plan_of(QUERIES[name](no_broadcast, SF))
        # the only exchanges deal lines of images, before they expand into pixels
        assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 2
        assert "Join" not in plan


@pytest.mark.parametrize("name, joins", [("pose_crop_fill", 1), ("pose_only_fill", 1), ("pose_only_fill_runs", 1), ("resize_pixels", 2)])
def test_pixels_are_not_broadcast(spark, name, joins):
    """Pixels expand from few rows, so the optimiser takes them to be few as well."""
    plan = plan_of(QUERIES[name](spark, SF))
    assert len(re.findall(r"ShuffledHashJoin \[image_id#\d+L\], \[image_id#\d+L\], Inner, BuildRight", plan)) == joins
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next(x for x in lines[i + 1:] if "Project" not in x)
            assert "Generate" not in below


@pytest.mark.parametrize("name, joins", [("pose_only_fill", 2), ("pose_only_fill_runs", 2), ("mask_union_runs", 1)])
def test_mask_bits_are_not_broadcast(spark, name, joins):
    """Words of bits expand from few rows, so the optimiser takes them to be few as well."""
    plan = plan_of(QUERIES[name](spark, SF))
    by_word = r"HashJoin \[batch_id#\d+L, y#\d+, word#\d+\], \[batch_id#\d+L, y#\d+, word#\d+\], (?:Inner|LeftOuter), BuildRight"
    assert len(re.findall("Shuffled" + by_word, plan)) == joins
    assert not re.findall("Broadcast" + by_word, plan)


@pytest.mark.parametrize("name, exchanges", [("pose_crop_fill", 18), ("pose_only_fill", 33), ("pose_only_fill_runs", 60)])
def test_driver_holds_neither_summaries_nor_a_mask_per_use(spark, name, exchanges):
    """Summaries and windows grow with the batches. The driver also keeps the plan, and makes a new one after every stage."""
    plan = plan_of(QUERIES[name](spark, SF))
    # ids of images whose masks select nothing
    assert plan.count("BroadcastExchange") == 1
    assert plan.count("Exchange hashpartitioning") <= exchanges


def test_runs_are_made_from_one_pass_over_positions_and_one_over_masks(spark):
    assert plan_of(QUERIES["mask_runs"](spark, SF)).count("FileScan") == 2


def test_images_are_dealt_out_before_they_are_spelt_out(spark):
    plan = plan_of(QUERIES["image_pixels"](spark, SF))
    assert plan.count("array_join(") == 1
    assert "REPARTITION_BY_NUM" in plan.split("array_join(")[1]
    assert X.packed_images(spark, SF).rdd.getNumPartitions() == 8


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("stream_", "tiled_", "stored_")) and not n.endswith("_stream")])
def test_building_a_query_starts_no_job(spark, name):
    QUERIES[name](spark, SF)  # looks schemas up
    tracker, group = spark.sparkContext.statusTracker(), f"building {name}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        QUERIES[name](spark, SF)
        assert list(tracker.getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_debouncing_sorts_nothing(spark):
    plan = plan_of(QUERIES["debounce_changes"](spark, SF))
    assert "Window" not in plan


@pytest.mark.parametrize("name", ["nearest_palette_color", "farthest_color"])
def test_colour_search_has_a_fixed_number_of_rounds(spark, name):
    df = QUERIES[name](spark, SF)
    df.collect()
    final = plan_of(df).split("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning") <= 12 and "Window" not in final
