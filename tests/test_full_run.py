"""The whole method end to end, with tiny learners."""

import json

from pyspark.sql import functions as F

from scorewise.config import RunConfig
from scorewise.operators import models as mo
from scorewise.plans import full_run as fr
from scorewise.sources import fixtures as fx

TINY = mo.LearnerParams(rf_trees=2, gbt_iters=2, gbt_depth=2, lr_iters=3)


def test_full_run_writes_everything_and_resumes(spark, sf, tmp_path):
    cfg = RunConfig(kmeans_starts=1, kmeans_max_iter=3, n_splits=2)
    labelled, unlabelled = fr.split_holdout(fx.survey(spark, sf), 0.2, 42)
    out, lines = str(tmp_path / "run"), []
    result = fr.run(spark, labelled, unlabelled, out, cfg, TINY, n_trials=1, seeds=(7,), log=lines.append, search_lp=TINY)
    assert abs(sum(result["weights"]) - 1.0) < 1e-9
    evidence = json.loads((spark.read.text(f"{out}/evidence").first())[0])
    assert {"model_comparison", "recommendation", "iterations", "best_trial_lg", "seed_stability"} <= set(evidence)
    written = spark.read.option("header", "true").csv(f"{out}/predictions")
    assert written.select("model").distinct().count() == 5 and written.filter("model = 'cb'").count() == unlabelled.count()
    scores = mo.score_new_rows(spark, f"{out}/models", fr.cl.preprocess_raw(unlabelled.drop("target"), passthrough=("id",)), 42)
    test = spark.read.parquet(f"{out}/test_scores").filter("model = 'cb'")
    joined = scores.join(test, "id").agg(F.count("*").alias("n"), F.max(F.abs(F.col("cb2") - F.col("p2"))).alias("far")).first()
    assert joined["n"] == unlabelled.count() and joined["far"] < 1e-9
