"""Golden values: expected results of the decision chain on the sf0.01 score
fixture (FIXTURES B2), and arithmetic on published numbers (FIXTURES A3)."""

import pytest
from pyspark.sql import functions as F

from scorewise.operators import decide as de
from scorewise.operators import metrics as me
from scorewise.operators import report as rp
from scorewise.sources import fixtures as fx
from tests.conftest import SF_MID


@pytest.fixture(scope="module")
def rows(spark):
    return de.decision_input(fx.oof(spark, SF_MID)).cache()


def test_equal_blend_metrics(rows):
    m = me.metric_bundle(rows.withColumn("pred", me.argmax3("p0", "p1", "p2"))).first()
    assert round(m["wf1"], 5) == 0.97329 and round(m["hrec"], 4) == 0.7891 and m["phc"] == 586


def test_recoverable_route(rows):
    r = de.recoverable_high(rows).first()
    assert (r["n_missed"], r["recoverable"], r["route"]) == (155, 71, "ALPHA_SWEEP_ONCE")


def test_alpha_sweep_all_pass_best_last(rows):
    sw = de.alpha_sweep(rows)
    assert sw.filter("accept = 1").count() == 7
    assert de.alpha_select(sw).first()["best_alpha"] == 1.15


def test_gate_sweep(rows):
    sel = de.gate_select(de.gate_sweep(rows)).first()
    assert sel["tried_count"] == 121 and sel["passing_count"] == 5 and round(sel["best_wf1"], 5) == 0.97580


def test_published_arithmetic(spark):
    # population std of the published per-fold WF1 of the first model
    folds = spark.createDataFrame([(x,) for x in (0.82809, 0.86582, 0.84579, 0.84582, 0.85623)], "wf1 double")
    assert round(folds.agg(F.stddev_pop("wf1")).first()[0], 5) == 0.01258
    # seed stability: predicted-High counts 461/456/456 -> std 2.357
    per_seed = spark.createDataFrame([(42, 0.8622, 0.6979, 461), (123, 0.8610, 0.6957, 456),
                                      (2025, 0.8609, 0.6872, 456)], "seed int, wf1 double, hrec double, phc bigint")
    s = rp.seed_stability(per_seed).first()
    assert round(s["phc_std"], 5) == 2.35702 and s["instability_flag"] == 0
    # prediction ceiling truncates: int(471 * 1.25) = 588
    assert int(471 * 1.25) == 588
