"""End-to-end run: read -> folds -> trials -> out-of-fold fit -> blend
search -> report -> decisions -> seed stability -> writes.

    python -m scorewise.plans.full_run --sf-dir /root/testdata/sf0.01 --out <shared folder>

The labelled table is the survey fixture of ``--sf-dir`` (or a CSV given by
``--train``); the unlabelled rows are a held-out share of it selected by an
md5 hash of the id (``--test-share``) unless ``--test`` names a CSV.  Every
step is a Spark job over whole tables; the driver holds only small tables
(parameters, centres, candidate metrics) and branches on scalars, as the
decision rules require.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewise.config import ALPHA_ACCEPT_HREC, ALPHA_WF1_DELTA, MODEL_NAMES, RECOVERABLE_ALPHA_MIN, SEED_STABILITY_SEEDS, RunConfig
from scorewise.operators import calibrate as ca
from scorewise.operators import clean as cl
from scorewise.operators import decide as de
from scorewise.operators import metrics as me
from scorewise.operators import fold_cache
from scorewise.operators import models as mo
from scorewise.operators import report as rp
from scorewise.operators import select as se
from scorewise.operators.folds import fold_hash
from scorewise.session import cut_lineage, local_session
from scorewise.sources import fixtures as fx
from scorewise.sources import io


def split_holdout(raw: DataFrame, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Deterministic train / held-out split by md5 of the id (whole table used)."""
    u = F.conv(F.substring(fold_hash("id", seed + 1), 1, 6), 16, 10).cast("long") / float(16 ** 6)
    tagged = raw.withColumn("_u", u)
    return (tagged.filter(F.col("_u") >= share).drop("_u"),
            tagged.filter(F.col("_u") < share).drop("_u"))


def run(spark: SparkSession, labelled: DataFrame, unlabelled: DataFrame | None, out: str,
        cfg: RunConfig = RunConfig(), lp: mo.LearnerParams = mo.LearnerParams(),
        n_trials: int | None = None, seeds=SEED_STABILITY_SEEDS, log=print, template: DataFrame | None = None,
        search_lp: mo.LearnerParams = mo.SEARCH_LEARNERS) -> dict:
    t0 = time.time()
    train, seen = cl.read_checked(labelled, cut_lineage)       # one pass reads, checks and writes
    log(f"classes and nulls: {seen}")
    test = (cut_lineage(cl.preprocess_raw(unlabelled.drop("target"), passthrough=("id",)))
            if unlabelled is not None else None)
    log(f"read {time.time() - t0:.1f}s")

    folds = io.get_or_create_folds(spark, train, f"{out}/folds", k=cfg.n_splits, seed=cfg.seed)
    clean_fold = cut_lineage(train.join(folds.select("id", "fold"), "id", "left"))
    cl.assert_no_null_categories(cl.fill_categories(clean_fold), label="train")

    # parameter trials of each learner on the stored fold tables, band selection
    # one fold cache for the search, the final fit and every seed of the stability check
    cache = fold_cache.build(clean_fold, test, cfg, dict.fromkeys((cfg.seed, *seeds)), cfg.n_splits)
    log(f"fold cache {time.time() - t0:.1f}s")
    trials = {}
    for model, n in (dict(cfg.trials) if n_trials is None else dict.fromkeys(MODEL_NAMES, n_trials)).items():
        if not n:
            continue
        t = cut_lineage(mo.hp_trials(cache, model, n, cfg.seed, base=search_lp, ledger=f"{out}/ledger"))
        best = cut_lineage(se.select_best_in_band(t.withColumn("cand_id", F.col("trial_no"))))
        lp = mo.with_trial(lp, model, mo.trial_params(n, cfg.seed, search_lp)[best.first()["band_best_id"]])
        trials[f"best_trial_{model}"] = best.join(F.broadcast(t), F.col("band_best_id") == F.col("trial_no")).select(
            *best.columns, "params")                       # one row
    log(f"trials {time.time() - t0:.1f}s")

    oof, test_scores, curves = mo.train_oof(clean_fold, test, cfg, lp, cache=cache, keep=f"{out}/models")
    oof = cut_lineage(oof)
    test_scores = cut_lineage(test_scores) if test_scores is not None else None
    log(f"final fit {time.time() - t0:.1f}s")

    # blend weight search and selection
    search = cut_lineage(se.blend_search(oof))
    blend = se.select_blend(search).first()
    weights = (blend["w_cb"], blend["w_lg"], blend["w_xg"])
    rows = cut_lineage(de.decision_input(oof, weights=weights))
    sources = {m: [F.col(f"{m}{c}") for c in range(3)] for m in MODEL_NAMES}
    sources["eq"] = [(F.col(f"cb{c}") + F.col(f"lg{c}") + F.col(f"xg{c}")) / 3 for c in range(3)]
    sources["blend"] = [weights[0] * F.col(f"cb{c}") + weights[1] * F.col(f"lg{c}")
                        + weights[2] * F.col(f"xg{c}") for c in range(3)]
    long_oof = me.scores_long(oof, sources, keep=("id", "y", "fold"))
    comparison = me.model_comparison(long_oof)

    # decisions
    steps = de.decide_once(rows)
    summary = steps["summary"].first()
    log(f"decisions {time.time() - t0:.1f}s: {summary.asDict()}")

    # seed stability: same folds, features and models refitted per seed, equal blend
    def fit_seed(s):                                  # independent fits: run side by side
        o, _, _ = mo.train_oof(clean_fold, None, cfg, lp, seed=s, cache=cache)
        return me.scores_long(o, {"eq": sources["eq"]}).withColumn("seed", F.lit(s))

    with ThreadPoolExecutor(max_workers=max(1, len(seeds))) as pool:
        per_seed = list(pool.map(fit_seed, seeds))
    seed_long = per_seed[0]
    for p in per_seed[1:]:
        seed_long = seed_long.unionByName(p)
    stability = rp.seed_stability(rp.seed_metrics(seed_long))
    log(f"seeds {time.time() - t0:.1f}s")

    # writes: predictions of the five sources, scores, evidence
    io.write_scores(long_oof, f"{out}/oof_scores")
    if test_scores is not None:
        long_test = me.scores_long(test_scores, sources, keep=("id",))
        io.write_predictions(rp.submission_labels(long_test), f"{out}/predictions", template, list(sources))
        io.write_scores(long_test, f"{out}/test_scores")
    evidence = rp.evidence_pack({
        "model_comparison": me.rounded(comparison),
        "blend": me.rounded(se.select_blend(search)),
        "medium_baseline": de.medium_baseline(rows),
        "calibration": me.rounded(ca.calibration_summary(rows)),
        "recoverable_high": steps["recoverable"],
        "alpha_sweep": me.rounded(steps["alpha_sweep"]),
        "alpha": me.rounded(steps["alpha"]),
        "gate": me.rounded(steps["gate"]),
        "decision": steps["summary"],
        "recommendation": me.rounded(de.recommendation(steps["summary"], steps["alpha"], steps["gate"], stability)),
        "setup": spark.createDataFrame([(ALPHA_ACCEPT_HREC, ALPHA_WF1_DELTA, "grid", f"{out}/folds")],
                                       "alpha_accept_hrec double, alpha_wf1_delta double, gate_search string, folds string"),
        **trials,
        "iterations": mo.iteration_alerts(mo.best_iterations(curves)),
        "seed_stability": me.rounded(stability),
        "classification_report": me.classification_report(long_oof.filter(F.col("model") == "blend")),
    })
    io.write_evidence(evidence, f"{out}/evidence")
    result = {"decision": summary["decision"], "weights": weights,
              "gate_evaluated": (summary["recoverable"] or 0) >= RECOVERABLE_ALPHA_MIN,
              "seconds": round(time.time() - t0, 1)}
    log(json.dumps(result))
    return result


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("--train")
    ap.add_argument("--test")
    ap.add_argument("--template", help="CSV whose ID column lists the ids to predict")
    ap.add_argument("--out", required=True)
    ap.add_argument("--test-share", type=float, default=0.2)
    ap.add_argument("--trials", type=int, help="trials per learner; default: RunConfig.trials")
    args = ap.parse_args()
    spark = local_session()
    cfg = RunConfig()
    if args.train:
        labelled = io.read_csv(spark, args.train).withColumnRenamed("ID", "id").withColumnRenamed("Target", "target")
        unlabelled = io.read_csv(spark, args.test).withColumnRenamed("ID", "id") if args.test else None
    else:
        labelled, unlabelled = split_holdout(fx.survey(spark, args.sf_dir), args.test_share, cfg.seed)
    template = io.read_template(spark, args.template) if args.template else None
    run(spark, labelled, unlabelled, args.out, cfg, n_trials=args.trials, template=template)


if __name__ == "__main__":
    main()
