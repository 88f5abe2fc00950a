"""Plans that a hot recording must not break."""

import pytest

from cuesheet.plans import PLANS


@pytest.mark.parametrize("name", ["a6_low_confidence_share", "a7_stage_counts", "u5_forced_grabs"])
def test_counts_combine_before_the_shuffle(spark, folder, name):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = PLANS[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # Read bottom up: rows are counted within their task before any exchange by recording.
    lines = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "HashAggregate" in line or "FileScan" in line]
    for i, line in enumerate(lines):
        if "Exchange" in line:
            assert "HashAggregate" in lines[i + 1], plan


@pytest.mark.parametrize("name,most", [("u1_candidate_pool", 4), ("u6_missing_deciles", 4), ("g2_decile_fills", 4), ("g1_scene_samples", 4)])
def test_inputs_are_read_few_times(spark, folder, name, most):
    plan = PLANS[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= most
