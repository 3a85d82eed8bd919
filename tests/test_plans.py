"""Physical-plan checks: no Python UDF in feature or decision plans, no
cartesian product in the sweeps, pruned scans, broadcast of small fitted tables."""

import pytest
from pyspark.sql import functions as F

from scorewise.plans.catalog import REGISTRY

NO_PYTHON = ["oof_metrics", "derived_features", "gate_sweep", "alpha_sweep", "blend_search",
             "oof_target_encoding", "calibration_summary", "fold_assignment", "clean_survey",
             "ordinal_encode", "freeze_categories", "target_encoding_map", "target_encode_lookup"]


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_PYTHON)
def test_no_python_udf_no_cartesian(spark, sf, name):
    p = plan_text(REGISTRY[name][0](spark, sf))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in p, (name, bad)


def test_scan_prunes_columns(spark, sf):
    p = plan_text(REGISTRY["oof_metrics"][0](spark, sf))
    assert "ReadSchema: struct<o_orderkey:bigint>" in p


def test_small_fitted_tables_are_broadcast(spark, sf):
    assert "BroadcastHashJoin" in plan_text(REGISTRY["derived_features"][0](spark, sf))
    assert "BroadcastHashJoin" in plan_text(REGISTRY["fold_assignment"][0](spark, sf))


def test_input_is_spread_only_where_the_session_says_so(spark):
    from scorewise.session import spread_input
    key = "spark.scorewise.inputPartitions"
    old = spark.conf.get(key, None)
    one = spark.range(0, 1000, 1, 1)
    try:
        spark.conf.set(key, "5")
        assert spread_input(one).rdd.getNumPartitions() == 5
        spark.conf.unset(key)
        assert spread_input(one) is one
    finally:
        if old is not None:
            spark.conf.set(key, old)


@pytest.mark.parametrize("name,scans", [("model_comparison", 2), ("fold_overlap_check", 2)])
def test_scans_of_the_score_table(spark, sf, name, scans):
    """The rows are read once, and once more for the sizes of the fold rank."""
    p = plan_text(REGISTRY[name][0](spark, sf))
    big = [line for line in p.splitlines() if "FileScan parquet" in line and ("o_orderkey" in line or "c_custkey" in line)]
    assert 1 <= len(big) <= scans * (1 if name == "model_comparison" else 2), p


def test_decisions_read_the_rows_once(spark, sf):
    """decision_summary reads its checkpointed cells only; those come from one scan."""
    from scorewise.operators import decide as de
    from scorewise.plans.q_decide import rows
    assert "o_orderkey" not in plan_text(REGISTRY["decision_summary"][0](spark, sf))
    assert plan_text(de.decision_cells(rows(spark, sf))).count("FileScan parquet") == 1


def test_broadcast_is_checked_in_bytes(spark):
    from scorewise.operators.joins import checked_broadcast
    t = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    probe = spark.range(1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan_text(probe.join(checked_broadcast(t), "id"))
        assert "BroadcastHashJoin" not in plan_text(probe.join(checked_broadcast(t, max_bytes=50_000), "id"))
        assert "BroadcastHashJoin" not in plan_text(probe.join(checked_broadcast(t, max_rows=99), "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
