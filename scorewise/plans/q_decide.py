"""Registered decision queries: blends, guardrails, sweeps, selections,
weight search, trial windows, calibration (D1-D11, T2-T7, W2, W3, A10-A14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewise.config import (ALPHA_ACCEPT_HREC, ALPHA_WF1_DELTA, ALPHAS, EARLY_STOP_PATIENCE,
                              ENTROPY_EPS, GATE_FPR_MAX, GATE_HIGH_FLOOR, GATE_TPR_MIN,
                              HREC_FLAT_RANGE, MODEL_NAMES, RECOVERABLE_ALPHA_MIN,
                              RECOVERABLE_GATE_MIN, SEED, WF1_BAND)
from scorewise.functions.columns import argmax3
from scorewise.operators import calibrate as ca
from scorewise.operators import decide as de
from scorewise.operators import metrics as me
from scorewise.operators import select as se
from scorewise.plans import sql as S
from scorewise.plans.queries import BLEND_WEIGHTS, R, oracle, register, source_columns
from scorewise.sources import fixtures as fx

dbl = S.dbl
AM = S.argmax


def rows(spark, d):
    return de.decision_input(fx.oof(spark, d))


ROWS = ("rows", "SELECT id, y, " + ", ".join(f"(cb{c} + lg{c} + xg{c}) / 3 AS p{c}" for c in range(3))
        + ", cb0 AS c0, cb1 AS c1, cb2 AS c2 FROM oof")
BASE = AM("p0", "p1", "p2")


# ---------------------------------------------------------------------------
# blends (D1, D2, J5)
# ---------------------------------------------------------------------------
@register("equal_blend", oracle(S.oof_cte(), body=f"""
SELECT id, y, {R('~p0, ~p1, ~p2')}, CAST({BASE} AS INTEGER) AS pred FROM ({S.eq_select()}) e"""))
def q_equal_blend(spark, d):
    b = de.equal_blend(fx.oof(spark, d))
    return me.rounded(b.withColumn("pred", argmax3("p0", "p1", "p2")))


@register("blend_scores", oracle(S.oof_cte(), body=f"""
SELECT id, y, {R('~p0, ~p1, ~p2')}, CAST({BASE} AS INTEGER) AS pred FROM ({S.blend_select(BLEND_WEIGHTS)}) e"""))
def q_blend_scores(spark, d):
    b = de.weighted_blend(fx.oof(spark, d), BLEND_WEIGHTS)
    return me.rounded(b.withColumn("pred", argmax3("p0", "p1", "p2")))


# ---------------------------------------------------------------------------
# guardrails
# ---------------------------------------------------------------------------
@register("medium_baseline", oracle(S.oof_cte(), ROWS, (
    "m", S.metrics(S.counts(S.with_pred("SELECT * FROM rows")))), body=f"""
SELECT {R('~f1_1 AS med_f1_base, ~rec1 AS med_rec_base, ~prec1 AS med_pre_base, q2 AS phc_base')},
       CAST(FLOOR(q2 * {dbl(1.25)}) AS BIGINT) AS phc_ceiling, ROUND(wf1, 6) AS wf1_base FROM m"""))
def q_medium_baseline(spark, d):
    return de.medium_baseline(rows(spark, d))


_LONG_BASE = ("lb", "SELECT l.*, e.base FROM long l JOIN (SELECT id, "
              + AM("(cb0 + lg0 + xg0) / 3", "(cb1 + lg1 + xg1) / 3", "(cb2 + lg2 + xg2) / 3")
              + " AS base FROM oof) e ON l.id = e.id")


@register("guardrails", oracle(S.oof_cte(), ("long", " UNION ALL ".join(
    [S.long_select(), S.eq_select(), S.blend_select(BLEND_WEIGHTS)])), _LONG_BASE, body=f"""
SELECT model, {R(S.REPORT)}, verdict, reasons
FROM ({S.guarded(S.counts(S.with_pred('SELECT * FROM lb'), ['model'], base='base'))}) g"""))
def q_guardrails(spark, d):
    oof = fx.oof(spark, d)
    eq = [(F.col(f"cb{c}") + F.col(f"lg{c}") + F.col(f"xg{c}")) / 3 for c in range(3)]
    wide = oof.withColumn("base", argmax3(*eq))
    long_df = me.with_pred(me.scores_long(wide, source_columns(), keep=("id", "y", "base")))
    return de.guardrails_by_source(long_df)


# ---------------------------------------------------------------------------
# alpha sweep (D5), selections (T4, T5), application
# ---------------------------------------------------------------------------
_ALPHAS = ("alphas", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {dbl(a)})" for i, a in enumerate(ALPHAS)) + ") AS a(alpha_idx, alpha)")
_ALPHA_EX = ("ax", f"SELECT a.alpha_idx, a.alpha, r.y, {AM('p0', 'p1', 'a.alpha * p2')} AS pred, "
                   f"{BASE} AS base FROM rows r CROSS JOIN alphas a")
_ALPHA_SW = ("sw", f"""SELECT alpha_idx, alpha, wf1, rec2 AS hrec, prec2 AS hpre, f1_1 AS med_f1,
  rec1 AS med_rec, q2 AS phc, ABS(q2 - b_q2) AS phc_dist,
  CAST(CASE WHEN wf1 >= b_wf1 - {dbl(ALPHA_WF1_DELTA)} AND rec2 >= {dbl(ALPHA_ACCEPT_HREC)}
       AND verdict = 'PASS' THEN 1 ELSE 0 END AS INTEGER) AS accept, verdict, reasons
  FROM ({S.guarded(S.counts('SELECT * FROM ax', ['alpha_idx', 'alpha'], base='base'))}) g""")
ALPHA_CTES = (S.oof_cte(), ROWS, _ALPHAS, _ALPHA_EX, _ALPHA_SW)


def alpha_sweep(spark, d):
    return de.alpha_sweep(rows(spark, d))


@register("alpha_sweep", oracle(*ALPHA_CTES, body=f"""
SELECT alpha_idx, alpha, {R('~wf1, ~hrec, ~hpre, ~med_f1, ~med_rec')}, phc, phc_dist, accept, verdict, reasons
FROM sw"""))
def q_alpha_sweep(spark, d):
    return me.rounded(alpha_sweep(spark, d))


def _alpha_select_sql(order: str) -> str:
    return f"""
SELECT (SELECT COUNT(*) FROM sw WHERE accept = 1) AS passing_count, b.alpha AS best_alpha,
       ROUND(b.wf1, 6) AS best_wf1, ROUND(b.hrec, 6) AS best_hrec, b.phc AS best_phc
FROM (SELECT 1 AS one) d LEFT JOIN (SELECT * FROM sw WHERE accept = 1 ORDER BY {order} LIMIT 1) b ON TRUE"""


@register("alpha_select", oracle(*ALPHA_CTES, body=_alpha_select_sql("hrec DESC, phc_dist, alpha_idx")))
def q_alpha_select(spark, d):
    return me.rounded(de.alpha_select(alpha_sweep(spark, d)))


@register("alpha_select_first", oracle(*ALPHA_CTES, body=_alpha_select_sql("alpha_idx")))
def q_alpha_select_first(spark, d):
    return me.rounded(de.alpha_select(alpha_sweep(spark, d), first_passing=True))


def chosen_alpha(spark, d) -> float:
    """The decision is a driver branch: one scalar from the bounded sweep."""
    row = de.alpha_select(alpha_sweep(spark, d)).first()
    return row["best_alpha"] if row and row["best_alpha"] is not None else 1.0


@register("alpha_apply", oracle(*ALPHA_CTES, (
    "sel", f"SELECT COALESCE((SELECT alpha FROM sw WHERE accept = 1 ORDER BY hrec DESC, phc_dist, alpha_idx "
           f"LIMIT 1), {dbl(1.0)}) AS a"), (
    "adj", "SELECT id, a, p0 / (p0 + p1 + a * p2) AS q0, p1 / (p0 + p1 + a * p2) AS q1, "
           "a * p2 / (p0 + p1 + a * p2) AS q2 FROM rows CROSS JOIN sel"), body=f"""
SELECT id, ROUND(q0, 6) AS p0, ROUND(q1, 6) AS p1, ROUND(q2, 6) AS p2,
       CAST({AM('q0', 'q1', 'q2')} AS INTEGER) AS pred, a AS alpha FROM adj"""))
def q_alpha_apply(spark, d):
    out = de.apply_alpha(rows(spark, d), chosen_alpha(spark, d))
    return out.select("id", "p0", "p1", "p2", F.col("pred").cast("int"), "alpha")


# ---------------------------------------------------------------------------
# gate sweeps (D6, D7, A10), selection (T6), application
# ---------------------------------------------------------------------------
_GRID = ("grid", "SELECT CAST(a.range AS INTEGER) AS i, CAST(b.range AS INTEGER) AS j, "
                 "CAST(20 + 5 * a.range AS DOUBLE) / 100 AS t_cb, CAST(20 + 5 * b.range AS DOUBLE) / 100 AS t_blend "
                 "FROM range(0, 11) a CROSS JOIN range(0, 11) b")
_GATE_EX = ("gx", f"""SELECT g.i, g.j, g.t_cb, g.t_blend, r.y, {BASE} AS base,
  (c2 > g.t_cb AND p2 > g.t_blend) AS gate,
  CASE WHEN c2 > g.t_cb AND p2 > g.t_blend THEN {AM('p0', 'p1', f'GREATEST(p2, {dbl(GATE_HIGH_FLOOR)})')}
       ELSE {BASE} END AS pred
  FROM rows r CROSS JOIN grid g""")
_GATE_STATS = ["CAST(SUM(CASE WHEN gate AND y = 2 AND base <> 2 THEN 1 ELSE 0 END) AS BIGINT) AS gate_missed",
               "CAST(SUM(CASE WHEN y = 2 AND base <> 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_missed",
               "CAST(SUM(CASE WHEN gate AND y <> 2 THEN 1 ELSE 0 END) AS BIGINT) AS gate_nonhigh",
               "CAST(SUM(CASE WHEN y <> 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_nonhigh"]
_RATES = (f"CASE WHEN n_missed > 0 THEN CAST(gate_missed AS DOUBLE) / n_missed ELSE {dbl(0.0)} END AS tpr, "
          f"CASE WHEN n_nonhigh > 0 THEN CAST(gate_nonhigh AS DOUBLE) / n_nonhigh ELSE {dbl(1.0)} END AS fpr")
_ACCEPT = (f"CAST(CASE WHEN fpr < {dbl(GATE_FPR_MAX)} AND tpr >= {dbl(GATE_TPR_MIN)} AND verdict = 'PASS' "
           f"THEN 1 ELSE 0 END AS INTEGER) AS accept")
_GATE_SW = ("gs", f"""SELECT *, {_ACCEPT} FROM (SELECT i, j, t_cb, t_blend, wf1, rec2 AS hrec, prec2 AS hpre,
  f1_1 AS med_f1, rec1 AS med_rec, q2 AS phc, {_RATES}, verdict, reasons
  FROM ({S.guarded(S.counts('SELECT * FROM gx', ['i', 'j', 't_cb', 't_blend'], base='base', extra=_GATE_STATS))}) g) x""")
GATE_CTES = (S.oof_cte(), ROWS, _GRID, _GATE_EX, _GATE_SW)


def gate_sweep(spark, d):
    return de.gate_sweep(rows(spark, d))


@register("gate_sweep", oracle(*GATE_CTES, body=f"""
SELECT i, j, t_cb, t_blend, {R('~wf1, ~hrec, ~hpre, ~med_f1, ~med_rec')}, phc, {R('~tpr, ~fpr')},
       accept, verdict, reasons FROM gs"""))
def q_gate_sweep(spark, d):
    return me.rounded(gate_sweep(spark, d))


@register("gate_rates", oracle(*GATE_CTES, body=f"SELECT i, j, t_cb, t_blend, {R('~tpr, ~fpr')} FROM gs"))
def q_gate_rates(spark, d):
    return me.rounded(de.gate_rates(gate_sweep(spark, d)))


_GATE_BEST = "SELECT * FROM gs WHERE accept = 1 ORDER BY wf1 DESC, i, j LIMIT 1"


@register("gate_select", oracle(*GATE_CTES, body=f"""
SELECT (SELECT COUNT(*) FROM gs) AS tried_count, (SELECT COUNT(*) FROM gs WHERE accept = 1) AS passing_count,
       b.t_cb AS best_t_cb, b.t_blend AS best_t_blend, ROUND(b.wf1, 6) AS best_wf1, ROUND(b.tpr, 6) AS best_tpr
FROM (SELECT 1 AS one) d LEFT JOIN ({_GATE_BEST}) b ON TRUE"""))
def q_gate_select(spark, d):
    return me.rounded(de.gate_select(gate_sweep(spark, d)))


def chosen_gate(spark, d):
    row = de.gate_select(gate_sweep(spark, d)).first()
    return (row["best_t_cb"], row["best_t_blend"]) if row else (None, None)


@register("gate_apply", oracle(*GATE_CTES, ("best", _GATE_BEST), (
    "adj", f"""SELECT id, gated, p0 / (p0 + p1 + g2) AS q0, p1 / (p0 + p1 + g2) AS q1, g2 / (p0 + p1 + g2) AS q2
      FROM (SELECT id, p0, p1,
              CASE WHEN b.t_cb IS NOT NULL AND c2 > b.t_cb AND p2 > b.t_blend
                   THEN GREATEST(p2, {dbl(GATE_HIGH_FLOOR)}) ELSE p2 END AS g2,
              CAST(CASE WHEN b.t_cb IS NOT NULL AND c2 > b.t_cb AND p2 > b.t_blend THEN 1 ELSE 0 END AS INTEGER) AS gated
            FROM rows LEFT JOIN best b ON TRUE) z"""), body=f"""
SELECT id, ROUND(q0, 6) AS p0, ROUND(q1, 6) AS p1, ROUND(q2, 6) AS p2, gated,
       CAST({AM('q0', 'q1', 'q2')} AS INTEGER) AS pred FROM adj"""))
def q_gate_apply(spark, d):
    t_cb, t_blend = chosen_gate(spark, d)
    out = de.apply_gate(rows(spark, d), t_cb, t_blend)
    return out.select("id", "p0", "p1", "p2", "gated", F.col("pred").cast("int"))


_AGRID = ("agrid", "SELECT CAST(range AS INTEGER) AS j, CAST(25 + 5 * range AS DOUBLE) / 100 AS threshold "
                   "FROM range(0, 6)")
_AGATE_EX = ("agx", f"""SELECT g.j, g.threshold, r.y, {BASE} AS base,
  ({AM('c0', 'c1', 'c2')} = 2 AND p2 > g.threshold) AS gate,
  CASE WHEN {AM('c0', 'c1', 'c2')} = 2 AND p2 > g.threshold
       THEN {AM('p0', 'p1', f'GREATEST(p2, {dbl(GATE_HIGH_FLOOR)})')} ELSE {BASE} END AS pred
  FROM rows r CROSS JOIN agrid g""")
_AGATE_SW = ("ags", f"""SELECT *, {_ACCEPT} FROM (SELECT j, threshold, wf1, rec2 AS hrec, prec2 AS hpre,
  f1_1 AS med_f1, rec1 AS med_rec, q2 AS phc, {_RATES}, verdict, reasons
  FROM ({S.guarded(S.counts('SELECT * FROM agx', ['j', 'threshold'], base='base', extra=_GATE_STATS))}) g) x""")


@register("gate_sweep_argmax", oracle(S.oof_cte(), ROWS, _AGRID, _AGATE_EX, _AGATE_SW, body=f"""
SELECT j, threshold, {R('~wf1, ~hrec, ~hpre, ~med_f1, ~med_rec')}, phc, {R('~tpr, ~fpr')}, accept,
       CAST(CASE WHEN j = (SELECT MIN(j) FROM ags WHERE accept = 1) THEN 1 ELSE 0 END AS INTEGER) AS is_selected,
       verdict, reasons FROM ags"""))
def q_gate_sweep_argmax(spark, d):
    return me.rounded(de.gate_sweep_argmax(rows(spark, d)))


# ---------------------------------------------------------------------------
# recoverable High (A11), decision
# ---------------------------------------------------------------------------
_REC = ("rec", f"""SELECT n_missed, recoverable,
  ROUND(CAST(recoverable AS DOUBLE) / GREATEST(n_missed, 1), 6) AS recoverable_rate,
  CASE WHEN recoverable >= {RECOVERABLE_GATE_MIN} THEN 'GATED_RESCUE_ONCE'
       WHEN recoverable >= {RECOVERABLE_ALPHA_MIN} THEN 'ALPHA_SWEEP_ONCE' ELSE 'BLEND_ONLY' END AS route
  FROM (SELECT CAST(SUM(CASE WHEN y = 2 AND {BASE} <> 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_missed,
               CAST(SUM(CASE WHEN y = 2 AND {BASE} <> 2 AND {AM('c0', 'c1', 'c2')} = 2 THEN 1 ELSE 0 END) AS BIGINT)
                 AS recoverable FROM rows) c""")


@register("recoverable_high", oracle(S.oof_cte(), ROWS, _REC, body="SELECT * FROM rec"))
def q_recoverable_high(spark, d):
    return de.recoverable_high(rows(spark, d))


@register("decision_summary", oracle(*GATE_CTES, _ALPHAS, _ALPHA_EX, _ALPHA_SW, _REC, body=f"""
SELECT route, n_missed, recoverable,
  (SELECT COUNT(*) FROM sw WHERE accept = 1) AS alpha_passing,
  (SELECT alpha FROM sw WHERE accept = 1 ORDER BY hrec DESC, phc_dist, alpha_idx LIMIT 1) AS best_alpha,
  CASE WHEN recoverable >= {RECOVERABLE_ALPHA_MIN} THEN (SELECT COUNT(*) FROM gs WHERE accept = 1) END AS gate_passing,
  CASE WHEN recoverable >= {RECOVERABLE_ALPHA_MIN} THEN (SELECT t_cb FROM ({_GATE_BEST}) b) END AS gate_t_cb,
  CASE WHEN recoverable >= {RECOVERABLE_ALPHA_MIN} THEN (SELECT t_blend FROM ({_GATE_BEST}) b) END AS gate_t_blend,
  CASE WHEN (SELECT COUNT(*) FROM sw WHERE accept = 1) > 0 THEN 'alpha'
       WHEN recoverable >= {RECOVERABLE_ALPHA_MIN} AND (SELECT COUNT(*) FROM gs WHERE accept = 1) > 0 THEN 'gate'
       ELSE 'blend' END AS decision
FROM rec"""))
def q_decision_summary(spark, d):
    return de.decide_once(rows(spark, d))["summary"]


# ---------------------------------------------------------------------------
# weight search (D3), selections (T2, T3, T7), trial windows
# ---------------------------------------------------------------------------
_CANDS = ("cands", f"""SELECT CAST(ROW_NUMBER() OVER (ORDER BY a, b) - 1 AS INTEGER) AS cand_id,
    CAST(a AS DOUBLE) / 20 AS w0, CAST(b AS DOUBLE) / 20 AS w1, CAST(20 - a - b AS DOUBLE) / 20 AS w2
  FROM (SELECT x.range AS a, z.range AS b FROM range(0, 21) x CROSS JOIN range(0, 21) z) g WHERE a + b <= 20
  UNION ALL SELECT -1, CAST(1 AS DOUBLE) / 3, CAST(1 AS DOUBLE) / 3, CAST(1 AS DOUBLE) / 3""")
_SEARCH_EX = ("sx", "SELECT cand_id, w0, w1, w2, y, " + AM(
    *[f"w0 * cb{c} + w1 * lg{c} + w2 * xg{c}" for c in range(3)]) + " AS pred FROM oof CROSS JOIN cands")
_ENT = " + ".join(f"{w} * LN({w} + {dbl(ENTROPY_EPS)})" for w in ("w0", "w1", "w2"))
_SEARCH = ("srch", f"""SELECT cand_id, w0 AS w_cb, w1 AS w_lg, w2 AS w_xg, wf1, rec2 AS hrec, f1_2 AS hf1,
  q2 AS phc, f1_1 AS med_f1, ROUND(-({_ENT}), 9) AS entropy
  FROM ({S.metrics(S.counts('SELECT * FROM sx', ['cand_id', 'w0', 'w1', 'w2']))}) m""")
SEARCH_CTES = (S.oof_cte(), _CANDS, _SEARCH_EX, _SEARCH)


def search(spark, d):
    return se.blend_search(fx.oof(spark, d))


@register("blend_search", oracle(*SEARCH_CTES, body=f"""
SELECT cand_id, {R('~w_cb, ~w_lg, ~w_xg, ~wf1, ~hrec, ~hf1')}, phc, {R('~med_f1, ~entropy')}
FROM srch WHERE cand_id >= 0"""))
def q_blend_search(spark, d):
    return me.rounded(search(spark, d).filter(F.col("cand_id") >= 0))


@register("select_blend", oracle(*SEARCH_CTES, (
    "band", f"SELECT * FROM srch WHERE cand_id >= 0 AND wf1 >= "
            f"(SELECT MAX(wf1) FROM srch WHERE cand_id >= 0) - {dbl(WF1_BAND)}"), body=f"""
SELECT cand_id, {R('~w_cb, ~w_lg, ~w_xg, ~wf1, ~hrec')}, phc, (SELECT COUNT(*) FROM band) AS band_n,
  CASE WHEN w_cb >= GREATEST(w_lg, w_xg) THEN 'cb' WHEN w_lg >= w_xg THEN 'lg' ELSE 'xg' END AS dominant_model,
  CASE WHEN GREATEST(w_cb, w_lg, w_xg) > {dbl(0.70)} THEN 'near single model' ELSE 'balanced' END AS dominant_note
FROM band ORDER BY hrec DESC, ABS(phc - (SELECT phc FROM srch WHERE cand_id = -1)), entropy DESC, cand_id LIMIT 1"""))
def q_select_blend(spark, d):
    return me.rounded(se.select_blend(search(spark, d)))


_TRIALS = ("tr", f"""SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY md5(CONCAT(CAST(cand_id AS VARCHAR), '-{SEED}')),
  cand_id) - 1 AS INTEGER) AS trial_no FROM srch WHERE cand_id >= 0""")
TRIAL_CTES = (*SEARCH_CTES, _TRIALS)


def trials(spark, d):
    return se.trials(search(spark, d))


@register("select_best_in_band", oracle(*TRIAL_CTES, (
    "ab", "SELECT * FROM tr ORDER BY wf1 DESC, trial_no LIMIT 1"), (
    "bb", f"SELECT * FROM tr WHERE wf1 >= (SELECT MAX(wf1) FROM tr) - {dbl(WF1_BAND)} "
          f"ORDER BY hrec DESC, trial_no LIMIT 1"), body=f"""
SELECT ab.cand_id AS abs_best_id, ROUND(ab.wf1, 6) AS abs_best_wf1, ROUND(ab.hrec, 6) AS abs_best_hrec,
       bb.cand_id AS band_best_id, ROUND(bb.wf1, 6) AS band_best_wf1, ROUND(bb.hrec, 6) AS band_best_hrec,
       (SELECT COUNT(*) FROM tr WHERE wf1 >= (SELECT MAX(wf1) FROM tr) - {dbl(WF1_BAND)}) AS band_n
FROM ab CROSS JOIN bb"""))
def q_select_best_in_band(spark, d):
    return me.rounded(se.select_best_in_band(trials(spark, d)))


@register("search_progress", oracle(*TRIAL_CTES, body="""
SELECT n, ROUND(best_wf1, 6) AS best_wf1, ROUND(best_hrec, 6) AS best_hrec FROM (
  SELECT CAST(t.trial_no + 1 AS INTEGER) AS n,
    MAX(wf1) OVER (ORDER BY trial_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_wf1,
    (SELECT hrec FROM tr t2 WHERE t2.trial_no <= t.trial_no ORDER BY wf1 DESC, trial_no LIMIT 1) AS best_hrec
  FROM tr t) x WHERE n % 10 = 0 OR n = 1"""))
def q_search_progress(spark, d):
    return me.rounded(se.search_progress(trials(spark, d)))


_P = EARLY_STOP_PATIENCE


@register("search_early_stop", oracle(*TRIAL_CTES, (
    "w", f"""SELECT trial_no, wf1,
      MAX(wf1) OVER (ORDER BY trial_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best,
      MAX(wf1) OVER (ORDER BY trial_no ROWS BETWEEN {_P - 1} PRECEDING AND CURRENT ROW) AS rmax,
      MAX(hrec) OVER (ORDER BY trial_no ROWS BETWEEN {_P - 1} PRECEDING AND CURRENT ROW) AS hmax,
      MIN(hrec) OVER (ORDER BY trial_no ROWS BETWEEN {_P - 1} PRECEDING AND CURRENT ROW) AS hmin FROM tr"""), (
    "st", f"""SELECT trial_no, wf1, (trial_no + 1 >= {_P} AND rmax < best - {dbl(WF1_BAND)}
      AND hmax - hmin < {dbl(HREC_FLAT_RANGE)}) AS stop FROM w"""), (
    "lim", "SELECT MIN(trial_no) AS stop_trial FROM st WHERE stop"), body="""
SELECT (SELECT stop_trial FROM lim) AS stop_trial,
  (SELECT COUNT(*) FROM st WHERE (SELECT stop_trial FROM lim) IS NULL OR trial_no <= (SELECT stop_trial FROM lim)) AS trials_run,
  ROUND((SELECT MAX(wf1) FROM st WHERE (SELECT stop_trial FROM lim) IS NULL OR trial_no <= (SELECT stop_trial FROM lim)), 6)
    AS best_wf1_kept"""))
def q_search_early_stop(spark, d):
    return me.rounded(se.search_early_stop(trials(spark, d)))


# ---------------------------------------------------------------------------
# calibration
# ---------------------------------------------------------------------------
_NB = ("nb", "SELECT CAST(LEAST(10, GREATEST(3, CAST(SUM(CASE WHEN y = 2 THEN 1 ELSE 0 END) AS BIGINT) // 30)) "
             "AS INTEGER) AS nb, COUNT(*) AS n_total FROM rows")
_CAL = ("cal", """SELECT nb, n_total, bin, COUNT(*) AS n, AVG(c2) AS mean_pred,
    CAST(SUM(CASE WHEN y = 2 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS frac_pos,
    ROW_NUMBER() OVER (ORDER BY bin) - 1 AS pos_k
  FROM (SELECT r.*, nb.nb, nb.n_total,
          LEAST(GREATEST(CAST(CEIL(c2 * nb.nb) AS INTEGER) - 1, 0), nb.nb - 1) AS bin
        FROM rows r CROSS JOIN nb) b GROUP BY nb, n_total, bin""")
_HIST = ("hist", """SELECT LEAST(CAST(FLOOR(c2 * nb.nb) AS INTEGER), nb.nb - 1) AS hbin, COUNT(*) AS hist_n
  FROM rows r CROSS JOIN nb GROUP BY 1""")
_SUMMARY = ("summ", f"""SELECT n_bins, ece, ece_legacy, bias_raw, bias,
    CASE WHEN bias = 'inflated' THEN ROUND(LEAST({dbl(0.50)}, {dbl(0.35)} + bias_raw), 2)
         WHEN bias = 'deflated' THEN ROUND(GREATEST({dbl(0.20)}, {dbl(0.35)} + bias_raw), 2)
         ELSE {dbl(0.35)} END AS threshold_suggestion
  FROM (SELECT *, CASE WHEN bias_raw > {dbl(0.02)} THEN 'inflated' WHEN bias_raw < {dbl(-0.02)} THEN 'deflated'
                       ELSE 'calibrated' END AS bias
        FROM (SELECT MIN(nb) AS n_bins,
                SUM(ABS(frac_pos - mean_pred) * n / n_total) AS ece,
                SUM(ABS(frac_pos - mean_pred) * COALESCE(hist_n, 0) / n_total) AS ece_legacy,
                AVG(mean_pred - frac_pos) AS bias_raw
              FROM cal LEFT JOIN hist ON cal.pos_k = hist.hbin) a) b""")
CAL_CTES = (S.oof_cte(), ROWS, _NB, _CAL, _HIST, _SUMMARY)


@register("calibration_bins", oracle(*CAL_CTES, body="""
SELECT nb AS n_bins, bin, n, ROUND(mean_pred, 6) AS mean_pred, ROUND(frac_pos, 6) AS frac_pos FROM cal"""))
def q_calibration_bins(spark, d):
    return me.rounded(ca.calibration_bins(rows(spark, d)))


@register("calibration_summary", oracle(*CAL_CTES, body=f"""
SELECT n_bins, {R('~ece, ~ece_legacy, ~bias_raw')}, bias, threshold_suggestion FROM summ"""))
def q_calibration_summary(spark, d):
    return me.rounded(ca.calibration_summary(rows(spark, d)))


@register("calibrated_thresholds", oracle(*CAL_CTES, (
    "lims", f"""SELECT bias = 'calibrated' AS cal,
      CASE WHEN bias = 'deflated' THEN GREATEST({dbl(0.15)}, threshold_suggestion - {dbl(0.10)})
           ELSE threshold_suggestion END AS lo,
      CASE WHEN bias = 'deflated' THEN threshold_suggestion + {dbl(0.20)}
           ELSE threshold_suggestion + {dbl(0.30)} END AS hi FROM summ"""), (
    "idx", f"""SELECT cal, lo, CAST(unnest(range(0, CASE WHEN cal THEN 6
                 ELSE CAST(CEIL((hi - lo) / {dbl(0.05)}) AS INTEGER) END)) AS INTEGER) AS i FROM lims"""), body=f"""
SELECT i, CASE WHEN cal THEN CAST(25 + 5 * i AS DOUBLE) / 100 ELSE ROUND(lo + i * {dbl(0.05)}, 2) END AS threshold
FROM idx"""))
def q_calibrated_thresholds(spark, d):
    return ca.calibrated_thresholds(ca.calibration_summary(rows(spark, d)))
