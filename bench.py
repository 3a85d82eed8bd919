"""Bench: headline queries of every operator family at $BENCH_SF_DIR on
local[$BENCH_CPUS].  Each query runs once to warm up, then three timed runs
through the ``noop`` sink (the whole plan executes, nothing is collected);
the median is reported.  Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = [
    # metrics over the score table
    "oof_metrics", "classification_report", "fold_metrics", "model_comparison",
    # decisions: sweeps, search, selection, calibration
    "alpha_sweep", "gate_sweep", "decision_summary", "blend_search", "select_blend",
    "search_early_stop", "calibration_summary",
    # cleaning, features, folds, encodings
    "clean_survey", "derived_features", "fold_assignment", "fold_country_z",
    "oof_target_encoding", "standardize", "centroid_distance",
    # outputs
    "submission_from_template", "fold_averaged_scores", "seed_stability",
]
# learning: minutes of iterations, so one run each, kept out of the total above
LEARNING = ["kmeans_assign"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    from scorewise.plans.catalog import REGISTRY
    from scorewise.session import local_session
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="scorewise-bench")
    times = {}
    for name in HEADLINE:
        fn = REGISTRY[name][0]

        def once():
            t = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t

        once()
        times[name] = round(statistics.median(once() for _ in range(reps)), 3)
    learning = {}
    for name in LEARNING:
        t = time.perf_counter()
        REGISTRY[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        learning[name] = round(time.perf_counter() - t, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_median_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "learning": learning, "sf": sf, "cpus": cpus, "reps": reps}))


if __name__ == "__main__":
    main()
