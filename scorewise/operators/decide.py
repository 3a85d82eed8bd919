"""Decision operators over a class-score table.

Input rows carry the true class ``y``, the blend's class scores ``p0..p2`` and
the first model's High score ``c2`` (and its argmax for the older gate).

Sweeps never multiply the rows by the candidates:

* alpha sweep - per row only ``(y, argmax(p0,p1), base pred, #alphas for which
  alpha*p2 beats max(p0,p1))`` matters.  Multiplication is monotone, so the
  winning alphas are a suffix of the sorted list.  Rows collapse to at most
  3*2*3*(K+1) buckets, which are then expanded by the K alphas.
* all decisions together - ``decision_cells`` counts the rows once by every key
  the recoverable, alpha and gate steps need; each step then reads those cells
  (a table bounded by the grids) instead of the rows.
* gate sweep - per row only ``(y, base pred, rescued pred, #t_cb passed,
  #t_blend passed)`` matters; gate(i, j) = i < n1 and j < n2.  At most
  3*3*3*12*12 buckets, expanded by the 121 grid points.

Every candidate's group sees every row, so the baseline counts are computed in
the same aggregation (no join with a baseline table).  Guardrails compare each
candidate with that baseline.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewise.config import (ALPHA_ACCEPT_HREC, ALPHA_WF1_DELTA, ALPHAS, ARGMAX_GATE_SIZE,
                              ARGMAX_GATE_START_CENTS, GATE_FPR_MAX, GATE_GRID_SIZE,
                              GATE_GRID_START_CENTS, GATE_GRID_STEP_CENTS, GATE_HIGH_FLOOR,
                              GATE_TPR_MIN, RECOVERABLE_ALPHA_MIN, RECOVERABLE_GATE_MIN,
                              Guardrails)
from scorewise.functions.columns import argmax2, argmax3, count_true, dlit, ratio
from scorewise.operators.metrics import count_aggs, metric_exprs, rounded, with_metrics
from scorewise.session import cut_lineage

P = ("p0", "p1", "p2")


def grid(start_cents: int, size: int, step_cents: int = GATE_GRID_STEP_CENTS) -> list[float]:
    """Thresholds (start + step*i)/100 as the nearest doubles (0.3, not 0.30000000000000004)."""
    return [(start_cents + step_cents * i) / 100 for i in range(size)]


GATE_GRID = grid(GATE_GRID_START_CENTS, GATE_GRID_SIZE)
ARGMAX_GATE_GRID = grid(ARGMAX_GATE_START_CENTS, ARGMAX_GATE_SIZE)


# ---------------------------------------------------------------------------
# blends (D1, D2)
# ---------------------------------------------------------------------------
def equal_blend(df: DataFrame, models=("cb", "lg", "xg"), keep=("id", "y")) -> DataFrame:
    return df.select(*keep, *[(reduce(add, [F.col(f"{m}{c}") for m in models]) / len(models))
                              .alias(f"p{c}") for c in range(3)])


def normalise_weights(raw, eps: float = 0.0) -> tuple:
    """Final blends divide by the sum; the search divides by sum + 1e-12."""
    s = sum(raw) + eps
    return tuple(w / s for w in raw)


def weighted_blend(df: DataFrame, weights, models=("cb", "lg", "xg"), keep=("id", "y")) -> DataFrame:
    w = [F.lit(float(x)) for x in weights]
    return df.select(*keep, *[reduce(add, [w[i] * F.col(f"{m}{c}") for i, m in enumerate(models)])
                              .alias(f"p{c}") for c in range(3)])


def decision_input(oof: DataFrame, first: str = "cb", weights=None) -> DataFrame:
    """Rows for the decisions: y, blend p0..p2 (equal, or ``weights`` for
    cb, lg, xg), first model's scores c0..c2."""
    if weights is None:
        blend = [(F.col(f"cb{c}") + F.col(f"lg{c}") + F.col(f"xg{c}")) / 3 for c in range(3)]
    else:
        w = [F.lit(float(x)) for x in weights]
        blend = [w[0] * F.col(f"cb{c}") + w[1] * F.col(f"lg{c}") + w[2] * F.col(f"xg{c}") for c in range(3)]
    return oof.select("id", "y", *[b.alias(f"p{c}") for c, b in enumerate(blend)],
                      *[F.col(f"{first}{c}").alias(f"c{c}") for c in range(3)])


# ---------------------------------------------------------------------------
# guardrails
# ---------------------------------------------------------------------------
def baseline_aggs(y="y", base="base", weight=None) -> list:
    return count_aggs(y, base, weight, prefix="b_", with_n=False)


def add_guardrails(m: DataFrame, g: Guardrails = Guardrails()) -> DataFrame:
    """``m`` holds candidate metrics and ``b_`` baseline metrics."""
    ceiling = F.floor(F.col("b_q2") * F.lit(float(g.pred_high_mult_max))).cast("bigint")
    f1_drop = F.col("f1_1") < F.col("b_f1_1") - dlit(g.medium_f1_drop_max)
    rec_drop = F.col("rec1") < F.col("b_rec1") - dlit(g.medium_rec_drop_max)
    over = F.col("q2") > ceiling
    return m.withColumns({
        "phc_ceiling": ceiling,
        "verdict": F.when(f1_drop | rec_drop | over, F.lit("FAIL")).otherwise(F.lit("PASS")),
        "reasons": F.concat_ws("; ", F.when(f1_drop, F.lit("medium_f1_drop")),
                               F.when(rec_drop, F.lit("medium_recall_drop")),
                               F.when(over, F.lit("pred_high_ceiling"))),
    })


def candidate_metrics(expanded: DataFrame, keys, pred="pred", base="base", weight="n",
                      extra_aggs=()) -> DataFrame:
    counts = expanded.groupBy(*keys).agg(*count_aggs("y", pred, weight),
                                         *baseline_aggs("y", base, weight), *extra_aggs)
    return add_guardrails(counts.withColumns({**metric_exprs(), **metric_exprs("b_")}))


def _report(m: DataFrame, keys, extra=()) -> DataFrame:
    return m.select(*keys, "wf1", F.col("rec2").alias("hrec"), F.col("prec2").alias("hpre"),
                    F.col("f1_1").alias("med_f1"), F.col("rec1").alias("med_rec"),
                    F.col("q2").alias("phc"), *extra, "verdict", "reasons")


def medium_baseline(rows: DataFrame, g: Guardrails = Guardrails()) -> DataFrame:
    m = with_metrics(rows.withColumn("pred", argmax3(*P)).agg(*count_aggs()))
    return rounded(m.select(
        F.col("f1_1").alias("med_f1_base"), F.col("rec1").alias("med_rec_base"),
        F.col("prec1").alias("med_pre_base"), F.col("q2").alias("phc_base"),
        F.floor(F.col("q2") * F.lit(float(g.pred_high_mult_max))).cast("bigint").alias("phc_ceiling"),
        F.col("wf1").alias("wf1_base")))


def guardrails_by_source(long_with_base: DataFrame, g: Guardrails = Guardrails()) -> DataFrame:
    """Each source's predictions checked against the baseline predictions."""
    m = candidate_metrics(long_with_base, ["model"], weight=None)
    return rounded(_report(m, ["model"]))


# ---------------------------------------------------------------------------
# alpha sweep (D5) and its selections (T4, T5), application
# ---------------------------------------------------------------------------
ALPHA_KEYS = ("y", "pred01", "base", "n_win")
GATE_KEYS = ("y", "base", "resc", "n1", "n2")


def _alpha_wins(alphas) -> Column:
    top01 = F.greatest(F.col("p0"), F.col("p1"))
    return reduce(add, [F.when(F.lit(float(a)) * F.col("p2") > top01, 1).otherwise(0) for a in alphas])


def _count_by(rows: DataFrame, keys) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _fold_cells(cells: DataFrame, keys) -> DataFrame:
    return cells.groupBy(*keys).agg(F.sum("n").alias("n"))


def alpha_buckets(rows: DataFrame, alphas=ALPHAS) -> DataFrame:
    return _count_by(rows.select("y", argmax2("p0", "p1").alias("pred01"), argmax3(*P).alias("base"),
                                 _alpha_wins(alphas).alias("n_win")), ALPHA_KEYS)


def decision_cells(rows: DataFrame, alphas=ALPHAS, t_cb=None, t_blend=None,
                   floor: float = GATE_HIGH_FLOOR) -> DataFrame:
    """Row counts by every key the recoverable, alpha and gate steps need: one
    scan, at most classes x grid steps rows whatever the input size."""
    t_cb, t_blend = t_cb or GATE_GRID, t_blend or GATE_GRID
    keyed = rows.select("y", argmax2("p0", "p1").alias("pred01"), argmax3(*P).alias("base"),
                        _alpha_wins(alphas).alias("n_win"), rescued_pred(floor).alias("resc"),
                        _n_passed(F.col("c2"), t_cb).alias("n1"), _n_passed(F.col("p2"), t_blend).alias("n2"),
                        (argmax3("c0", "c1", "c2") == 2).alias("first_high"))
    return _count_by(keyed, keyed.columns)


def alpha_sweep(rows: DataFrame, alphas=ALPHAS, g: Guardrails = Guardrails(),
                wf1_delta: float = ALPHA_WF1_DELTA, hrec_min: float = ALPHA_ACCEPT_HREC,
                cells: DataFrame | None = None) -> DataFrame:
    """``cells`` (from ``decision_cells`` with the same grid) replaces the scan of ``rows``."""
    k = len(alphas)
    exp = ((alpha_buckets(rows, alphas) if cells is None else _fold_cells(cells, ALPHA_KEYS))
           .withColumn("alpha_idx", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
           .withColumn("pred", F.when(F.col("alpha_idx") >= k - F.col("n_win"), F.lit(2))
                       .otherwise(F.col("pred01"))))
    m = candidate_metrics(exp, ["alpha_idx"])
    accept = ((F.col("wf1") >= F.col("b_wf1") - dlit(wf1_delta))
              & (F.col("rec2") >= dlit(hrec_min)) & (F.col("verdict") == "PASS"))
    alpha_col = F.element_at(F.array(*[F.lit(float(a)) for a in alphas]), F.col("alpha_idx") + 1)
    out = m.withColumns({"alpha": alpha_col, "accept": accept.cast("int"),
                         "phc_dist": F.abs(F.col("q2") - F.col("b_q2"))})
    return _report(out, ["alpha_idx", "alpha"], extra=["phc_dist", "accept"])


def alpha_select(sweep: DataFrame, first_passing: bool = False) -> DataFrame:
    """Best passing alpha: highest High recall, then closest predicted-High count,
    then list order (``first_passing`` = the older first-passing rule).
    ``sweep`` must hold raw (unrounded) metrics: they are ordering keys."""
    ok = F.col("accept") == 1
    key = (F.when(ok, F.col("alpha_idx")) if first_passing else
           F.when(ok, F.struct((-F.col("hrec")).alias("a"), F.col("phc_dist").alias("b"),
                               F.col("alpha_idx").alias("c"))))
    best = F.min_by(F.struct("alpha", "wf1", "hrec", "phc"), key)
    return sweep.agg(count_true(ok).alias("passing_count"), best.alias("b")).select(
        "passing_count", F.col("b.alpha").alias("best_alpha"), F.col("b.wf1").alias("best_wf1"),
        F.col("b.hrec").alias("best_hrec"), F.col("b.phc").alias("best_phc"))


def apply_alpha(rows: DataFrame, alpha: float, keep=("id",)) -> DataFrame:
    a = F.lit(float(alpha))
    s = F.col("p0") + F.col("p1") + a * F.col("p2")
    adj = rows.select(*keep, (F.col("p0") / s).alias("p0"), (F.col("p1") / s).alias("p1"),
                      (a * F.col("p2") / s).alias("p2"))
    return rounded(adj.withColumn("pred", argmax3(*P)).withColumn("alpha", a))


# ---------------------------------------------------------------------------
# gate sweeps (D6, D7, A10), selection (T6), application
# ---------------------------------------------------------------------------
def _n_passed(c: Column, thresholds) -> Column:
    return reduce(add, [F.when(c > F.lit(float(t)), 1).otherwise(0) for t in thresholds])


def rescued_pred(floor: float = GATE_HIGH_FLOOR) -> Column:
    return argmax3("p0", "p1", F.greatest(F.col("p2"), dlit(floor)))


def _gate_aggs(gate: Column) -> list:
    missed = (F.col("y") == 2) & (F.col("base") != 2)
    nonhigh = F.col("y") != 2
    w = F.col("n")
    return [count_true(gate & missed, w).alias("gate_missed"), count_true(missed, w).alias("n_missed"),
            count_true(gate & nonhigh, w).alias("gate_nonhigh"), count_true(nonhigh, w).alias("n_nonhigh")]


def _rates(m: DataFrame) -> DataFrame:
    return m.withColumns({
        "tpr": F.when(F.col("n_missed") > 0, F.col("gate_missed") / F.col("n_missed")).otherwise(dlit(0.0)),
        "fpr": F.when(F.col("n_nonhigh") > 0, F.col("gate_nonhigh") / F.col("n_nonhigh")).otherwise(dlit(1.0)),
    })


def gate_sweep(rows: DataFrame, t_cb=GATE_GRID, t_blend=GATE_GRID, g: Guardrails = Guardrails(),
               fpr_max: float = GATE_FPR_MAX, tpr_min: float = GATE_TPR_MIN,
               floor: float = GATE_HIGH_FLOOR, cells: DataFrame | None = None) -> DataFrame:
    """Probability gate: c2 > t_cb and p2 > t_blend -> P(High) lifted to ``floor``.
    ``cells`` (from ``decision_cells`` with the same grids) replaces the scan of ``rows``."""
    n_i, n_j = len(t_cb), len(t_blend)
    if cells is None:
        buckets = _count_by(rows.select("y", argmax3(*P).alias("base"), rescued_pred(floor).alias("resc"),
                                        _n_passed(F.col("c2"), t_cb).alias("n1"),
                                        _n_passed(F.col("p2"), t_blend).alias("n2")), GATE_KEYS)
    else:
        buckets = _fold_cells(cells, GATE_KEYS)
    cand = F.explode(F.sequence(F.lit(0), F.lit(n_i * n_j - 1)))
    exp = (buckets.withColumn("g", cand)
           .withColumn("i", (F.col("g") / n_j).cast("int"))
           .withColumn("j", F.col("g") % n_j)
           .withColumn("gate", (F.col("i") < F.col("n1")) & (F.col("j") < F.col("n2")))
           .withColumn("pred", F.when(F.col("gate"), F.col("resc")).otherwise(F.col("base"))))
    m = _rates(candidate_metrics(exp, ["i", "j"], extra_aggs=_gate_aggs(F.col("gate"))))
    accept = (F.col("fpr") < dlit(fpr_max)) & (F.col("tpr") >= dlit(tpr_min)) & (F.col("verdict") == "PASS")
    m = m.withColumns({
        "t_cb": F.element_at(F.array(*[F.lit(float(t)) for t in t_cb]), F.col("i") + 1),
        "t_blend": F.element_at(F.array(*[F.lit(float(t)) for t in t_blend]), F.col("j") + 1),
        "accept": accept.cast("int")})
    return _report(m, ["i", "j", "t_cb", "t_blend"], extra=["tpr", "fpr", "accept"])


def gate_rates(sweep: DataFrame) -> DataFrame:
    return sweep.select("i", "j", "t_cb", "t_blend", "tpr", "fpr")


def gate_select(sweep: DataFrame) -> DataFrame:
    """Passing gate with strictly highest WF1; the first in grid order wins ties."""
    ok = F.col("accept") == 1
    key = F.when(ok, F.struct((-F.col("wf1")).alias("a"), F.col("i").alias("b"), F.col("j").alias("c")))
    best = F.min_by(F.struct("t_cb", "t_blend", "wf1", "tpr"), key)
    return sweep.agg(F.count(F.lit(1)).alias("tried_count"), count_true(ok).alias("passing_count"),
                     best.alias("b")).select(
        "tried_count", "passing_count", F.col("b.t_cb").alias("best_t_cb"),
        F.col("b.t_blend").alias("best_t_blend"), F.col("b.wf1").alias("best_wf1"),
        F.col("b.tpr").alias("best_tpr"))


def gate_sweep_argmax(rows: DataFrame, thresholds=ARGMAX_GATE_GRID, g: Guardrails = Guardrails(),
                      fpr_max: float = GATE_FPR_MAX, tpr_min: float = GATE_TPR_MIN,
                      floor: float = GATE_HIGH_FLOOR) -> DataFrame:
    """Older gate: first model's argmax is High and p2 > t; first passing t selected."""
    k = len(thresholds)
    buckets = (rows.select("y", argmax3(*P).alias("base"), rescued_pred(floor).alias("resc"),
                           (argmax3("c0", "c1", "c2") == 2).alias("first_high"),
                           _n_passed(F.col("p2"), thresholds).alias("n2"))
               .groupBy("y", "base", "resc", "first_high", "n2").agg(F.count(F.lit(1)).alias("n")))
    exp = (buckets.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
           .withColumn("gate", F.col("first_high") & (F.col("j") < F.col("n2")))
           .withColumn("pred", F.when(F.col("gate"), F.col("resc")).otherwise(F.col("base"))))
    m = _rates(candidate_metrics(exp, ["j"], extra_aggs=_gate_aggs(F.col("gate"))))
    accept = (F.col("fpr") < dlit(fpr_max)) & (F.col("tpr") >= dlit(tpr_min)) & (F.col("verdict") == "PASS")
    m = m.withColumns({
        "threshold": F.element_at(F.array(*[F.lit(float(t)) for t in thresholds]), F.col("j") + 1),
        "accept": accept.cast("int")})
    first = F.min(F.when(F.col("accept") == 1, F.col("j"))).over(Window.partitionBy())  # k rows
    m = m.withColumn("is_selected", F.coalesce(F.col("j") == first, F.lit(False)).cast("int"))
    return _report(m, ["j", "threshold"], extra=["tpr", "fpr", "accept", "is_selected"])


def apply_gate(rows: DataFrame, t_cb: float | None, t_blend: float | None,
               floor: float = GATE_HIGH_FLOOR, keep=("id",)) -> DataFrame:
    if t_cb is None or t_blend is None:
        gate = F.lit(False)
    else:
        gate = (F.col("c2") > F.lit(float(t_cb))) & (F.col("p2") > F.lit(float(t_blend)))
    p2 = F.when(gate, F.greatest(F.col("p2"), dlit(floor))).otherwise(F.col("p2"))
    s = F.col("p0") + F.col("p1") + p2
    adj = rows.select(*keep, (F.col("p0") / s).alias("p0"), (F.col("p1") / s).alias("p1"),
                      (p2 / s).alias("p2"), gate.cast("int").alias("gated"))
    return rounded(adj.withColumn("pred", argmax3(*P)))


# ---------------------------------------------------------------------------
# recoverable High (A11) and the final decision
# ---------------------------------------------------------------------------
def recoverable_high(rows: DataFrame, gate_min: int = RECOVERABLE_GATE_MIN,
                     alpha_min: int = RECOVERABLE_ALPHA_MIN, cells: DataFrame | None = None) -> DataFrame:
    if cells is None:
        src, base, first, w = rows, argmax3(*P), argmax3("c0", "c1", "c2") == 2, F.lit(1)
    else:
        src, base, first, w = cells, F.col("base"), F.col("first_high"), F.col("n")
    missed = (F.col("y") == 2) & (base != 2)
    m = src.agg(count_true(missed, w).alias("n_missed"), count_true(missed & first, w).alias("recoverable"))
    route = (F.when(F.col("recoverable") >= gate_min, F.lit("GATED_RESCUE_ONCE"))
             .when(F.col("recoverable") >= alpha_min, F.lit("ALPHA_SWEEP_ONCE"))
             .otherwise(F.lit("BLEND_ONLY")))
    return rounded(m.withColumns({
        "recoverable_rate": F.col("recoverable") / F.greatest(F.col("n_missed"), F.lit(1)),
        "route": route}))


def decision_summary(rec: DataFrame, alpha_sel: DataFrame, gate_sel: DataFrame,
                     gate_min_recoverable: int = RECOVERABLE_ALPHA_MIN) -> DataFrame:
    """One row: route, best alpha, gate (only if enough recoverable), decision.

    The three one-row inputs are stacked and folded with ``max`` (each column
    is non-null in exactly one input), so no join is needed.
    """
    cols = {"n_missed": "bigint", "recoverable": "bigint", "route": "string",
            "alpha_passing": "bigint", "best_alpha": "double",
            "gate_passing": "bigint", "gate_t_cb": "double", "gate_t_blend": "double"}

    def widen(df: DataFrame, mapping: dict) -> DataFrame:
        return df.select(*[(F.col(mapping[c]) if c in mapping else F.lit(None)).cast(t).alias(c)
                           for c, t in cols.items()])

    stacked = (widen(rec, {"n_missed": "n_missed", "recoverable": "recoverable", "route": "route"})
               .unionByName(widen(alpha_sel, {"alpha_passing": "passing_count", "best_alpha": "best_alpha"}))
               .unionByName(widen(gate_sel, {"gate_passing": "passing_count", "gate_t_cb": "best_t_cb",
                                             "gate_t_blend": "best_t_blend"})))
    one = stacked.agg(*[F.max(c).alias(c) for c in cols])
    gate_on = F.col("recoverable") >= gate_min_recoverable
    return one.select(
        "route", "n_missed", "recoverable", "alpha_passing", "best_alpha",
        F.when(gate_on, F.col("gate_passing")).alias("gate_passing"),
        F.when(gate_on, F.col("gate_t_cb")).alias("gate_t_cb"),
        F.when(gate_on, F.col("gate_t_blend")).alias("gate_t_blend"),
        F.when(F.col("best_alpha").isNotNull(), F.lit("alpha"))
        .when(gate_on & F.col("gate_t_cb").isNotNull(), F.lit("gate"))
        .otherwise(F.lit("blend")).alias("decision"))


def decide_once(rows: DataFrame) -> dict:
    """Recoverable, alpha and gate steps and the summary from one scan of
    ``rows``: the cells are checkpointed and every step reads them."""
    cells = cut_lineage(decision_cells(rows))
    rec = recoverable_high(rows, cells=cells)
    alpha = alpha_sweep(rows, cells=cells)
    gate = gate_sweep(rows, cells=cells)
    alpha_sel, gate_sel = alpha_select(alpha), gate_select(gate)
    return {"recoverable": rec, "alpha_sweep": alpha, "gate_sweep": gate, "alpha": alpha_sel, "gate": gate_sel,
            "summary": decision_summary(rec, alpha_sel, gate_sel)}


def recommendation(summary: DataFrame, alpha_sel: DataFrame, gate_sel: DataFrame, stability: DataFrame) -> DataFrame:
    """One row: the decision, the figure it rests on (High recall for alpha,
    WF1 for the gate), the instability flag and a note that warns when the
    seeds disagree.  The four one-row inputs are stacked and folded."""
    def one(df, **cols):
        names = {"decision": "string", "alpha": "double", "t_cb": "double", "t_blend": "double",
                 "hrec": "double", "wf1": "double", "instability_flag": "int"}
        return df.select(*[(F.col(cols[c]) if c in cols else F.lit(None)).cast(t).alias(c) for c, t in names.items()])

    stacked = (one(summary, decision="decision", alpha="best_alpha", t_cb="gate_t_cb", t_blend="gate_t_blend")
               .unionByName(one(alpha_sel, hrec="best_hrec")).unionByName(one(gate_sel, wf1="best_wf1"))
               .unionByName(one(stability, instability_flag="instability_flag")))
    s = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    text = (F.when(F.col("decision") == "alpha", F.lit("submit the alpha sweep"))
            .when(F.col("decision") == "gate", F.lit("submit the gated rescue"))
            .otherwise(F.lit("submit the searched blend")))
    warn = F.when(F.col("instability_flag") == 1, F.lit("; seed instability: verify the results")).otherwise(F.lit(""))
    return s.select("decision", "alpha",
                    F.when(F.col("decision") == "gate", F.col("t_cb")).alias("t_cb"),
                    F.when(F.col("decision") == "gate", F.col("t_blend")).alias("t_blend"),
                    F.when(F.col("decision") == "alpha", F.col("hrec")).alias("hrec"),
                    F.when(F.col("decision") == "gate", F.col("wf1")).alias("wf1"),
                    "instability_flag", F.concat(text, warn).alias("note"))
