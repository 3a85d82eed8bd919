"""Registered output and stability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewise.config import SEED_STABILITY_STD_WARN
from scorewise.functions.columns import argmax3
from scorewise.operators import calibrate as ca
from scorewise.operators import decide as de
from scorewise.operators import metrics as me
from scorewise.operators import report as rp
from scorewise.operators import select as se
from scorewise.plans import sql as S
from scorewise.plans.queries import BLEND_WEIGHTS, R, oof_long5, oracle, register
from scorewise.sources import fixtures as fx
from scorewise.sources.tables import load

dbl = S.dbl
SOURCES5 = ("long", " UNION ALL ".join([S.long_select(), S.eq_select(), S.blend_select(BLEND_WEIGHTS)]))
LABEL_SQL = ("CASE " + S.argmax() + " WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END")


@register("oof_scores_long", oracle(S.oof_cte(), SOURCES5, body=f"""
SELECT id, y, model, {R('~p0, ~p1, ~p2')} FROM long"""))
def q_oof_scores_long(spark, d):
    return me.rounded(oof_long5(spark, d))


@register("submission_labels", oracle(S.oof_cte(), SOURCES5, body=f"""
SELECT id, model, {LABEL_SQL} AS Target FROM long"""))
def q_submission_labels(spark, d):
    return rp.submission_labels(oof_long5(spark, d))


@register("submission_counts", oracle(S.oof_cte(), SOURCES5, body=f"""
SELECT model, {LABEL_SQL} AS Target, COUNT(*) AS n FROM long GROUP BY model, Target"""))
def q_submission_counts(spark, d):
    return rp.submission_counts(rp.submission_labels(oof_long5(spark, d)))


@register("submission_from_template", oracle(S.oof_cte(), body=f"""
SELECT o_orderkey AS id, p.Target FROM orders LEFT JOIN (
  SELECT id, {LABEL_SQL} AS Target FROM ({S.eq_select()}) e
  WHERE id IN (SELECT l_orderkey FROM lineitem)) p ON o_orderkey = p.id"""))
def q_submission_from_template(spark, d):
    # predictions exist for orders that have line items; the template lists
    # every order, so orders without lines keep a NULL label
    scored = fx.oof(spark, d).join(
        load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")), "id", "left_semi")
    labels = rp.submission_labels(me.scores_long(scored, {"eq": [
        (F.col(f"cb{c}") + F.col(f"lg{c}") + F.col(f"xg{c}")) / 3 for c in range(3)]}))
    template = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return rp.submission_from_template(template, labels)


@register("fold_averaged_scores", oracle(("fs", fx.FOLD_SCORES_DUCK), body=f"""
SELECT id, {R('~p0, ~p1, ~p2')}, CAST({S.argmax()} AS INTEGER) AS pred
FROM (SELECT id, AVG(p0) AS p0, AVG(p1) AS p1, AVG(p2) AS p2 FROM fs GROUP BY id) a"""))
def q_fold_averaged_scores(spark, d):
    avg = fx.fold_scores(spark, d).groupBy("id").agg(*[F.avg(f"p{c}").alias(f"p{c}") for c in range(3)])
    return me.rounded(avg.withColumn("pred", argmax3("p0", "p1", "p2").cast("int")))


def _seed_long(spark, d):
    eq = {"eq": [(F.col(f"cb{c}") + F.col(f"lg{c}") + F.col(f"xg{c}")) / 3 for c in range(3)]}
    return me.scores_long(fx.oof_seeds(spark, d), eq, keep=("seed", "id", "y"))


_SEED_M = ("sm", S.bundle(S.with_pred(S.eq_select("os", extra="seed")), ["seed"]))


@register("seed_metrics", oracle(("os", fx.OOF_SEEDS_DUCK), _SEED_M, body=f"""
SELECT seed, {R('~wf1, ~hrec')}, phc FROM sm"""))
def q_seed_metrics(spark, d):
    return me.rounded(rp.seed_metrics(_seed_long(spark, d)))


@register("seed_stability", oracle(("os", fx.OOF_SEEDS_DUCK), _SEED_M, body=f"""
SELECT {R('~wf1_mean, ~wf1_std, ~hrec_mean, ~hrec_std, ~phc_mean, ~phc_std')}, n_seeds,
  CAST(CASE WHEN wf1_std > {dbl(SEED_STABILITY_STD_WARN)} OR hrec_std > {dbl(SEED_STABILITY_STD_WARN)}
       THEN 1 ELSE 0 END AS INTEGER) AS instability_flag
FROM (SELECT AVG(wf1) AS wf1_mean, STDDEV_POP(wf1) AS wf1_std, AVG(hrec) AS hrec_mean,
        STDDEV_POP(hrec) AS hrec_std, AVG(CAST(phc AS DOUBLE)) AS phc_mean,
        STDDEV_POP(CAST(phc AS DOUBLE)) AS phc_std, COUNT(*) AS n_seeds FROM sm) s"""))
def q_seed_stability(spark, d):
    return me.rounded(rp.seed_stability(rp.seed_metrics(_seed_long(spark, d))))


@register("evidence_pack", None)
def q_evidence_pack(spark, d):
    """One JSON document assembled from the decision queries (rows-only check)."""
    oof = fx.oof(spark, d)
    rows = de.decision_input(oof)
    search = se.blend_search(oof)
    return rp.evidence_pack({
        "oof_metrics": me.oof_metrics(oof_long5(spark, d)),
        "blend": me.rounded(se.select_blend(search)),
        "medium_baseline": de.medium_baseline(rows),
        "calibration": me.rounded(ca.calibration_summary(rows)),
        "recoverable_high": de.recoverable_high(rows),
        "alpha": me.rounded(de.alpha_select(de.alpha_sweep(rows))),
        "gate": me.rounded(de.gate_select(de.gate_sweep(rows))),
        "seed_stability": me.rounded(rp.seed_stability(rp.seed_metrics(_seed_long(spark, d)))),
    })
