"""Invariants of the operators (no oracle needed)."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewise.config import ALPHAS, GATE_HIGH_FLOOR
from scorewise.operators.decide import GATE_GRID
from scorewise.operators import clean as cl
from scorewise.operators import decide as de
from scorewise.operators import encode as en
from scorewise.operators import features as fe
from scorewise.operators import folds as fo
from scorewise.operators import metrics as me
from scorewise.plans.q_features import clean_survey_y
from scorewise.plans.queries import oof_long5
from scorewise.sources import fixtures as fx


def test_cleaning_is_idempotent(spark, sf):
    once = cl.clean_frame(fx.survey(spark, sf).drop("target"), keep=(), passthrough=("id",))
    twice = cl.clean_frame(once, keep=(), passthrough=("id",))
    assert once.exceptAll(twice).count() == 0
    assert not cl.text_columns_left(once, keep=())


def test_cleaning_examples(spark):
    df = spark.createDataFrame([(1, " Yes "), (2, "have now "), (3, "Don't know"), (4, None), (5, "2.7"),
                                (6, "FALSE"), (7, "12d"), (8, "nan")], "id long, v string")
    got = dict(cl.clean_frame(df, passthrough=("id",)).select("id", "v").collect())
    assert got == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0, 5: 2.7, 6: 0.0, 7: 0.0, 8: 0.0}


def test_unknown_label_raises(spark):
    df = spark.createDataFrame([(1, "Low"), (2, "Huge")], "id long, target string")
    with pytest.raises(ValueError, match="Huge"):
        cl.assert_known_labels(df)


def test_null_category_assertion(spark, sf):
    with pytest.raises(ValueError):
        cl.assert_no_null_categories(fx.survey(spark, sf), label="raw")
    cl.assert_no_null_categories(cl.fill_categories(fx.survey(spark, sf)))


def test_align_columns(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "id long, b double, extra string")
    out = cl.align_columns(["id", "a", "b"], df)
    assert out.columns == ["id", "a", "b"] and out.first().asDict() == {"id": 1, "a": 0.0, "b": 2.0}


def test_folds_partition_and_balance(spark, sf):
    f = fo.assign_folds(clean_survey_y(spark, sf).select("id", "y"))
    assert f.count() == f.select("id").distinct().count()
    sizes = f.groupBy("y", "fold").count().groupBy("y").agg((F.max("count") - F.min("count")).alias("d"))
    assert all(r["d"] <= 1 for r in sizes.collect())
    assert fo.fold_overlap_check(f).filter("n_overlap > 0").count() == 0


def test_two_stage_fold_rank_equals_single_window(spark, sf):
    base = clean_survey_y(spark, sf).select("id", "y")
    a = fo.assign_folds(base, digits=1)
    b = fo.assign_folds(base, digits=3)
    w = Window.partitionBy("y").orderBy(fo.fold_hash("id", 42), "id")
    c = base.withColumn("fold", ((F.row_number().over(w) - 1) % 5).cast("int"))
    assert a.exceptAll(c).count() == 0 and b.exceptAll(c).count() == 0


def test_distributed_sort_positions_equal_single_window(spark, sf):
    """Ordinal positions from the range-partitioned sort equal a one-task
    row_number, on a high-cardinality text column spread over 8 partitions."""
    from scorewise.sources.tables import load
    vals = (load(spark, sf, "lineitem")
            .select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("v")).distinct())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = en.sorted_positions(vals, "v", "pos")
        want = vals.withColumn("pos", (F.row_number().over(Window.orderBy("v")) - 1).cast("int"))
        n = vals.count()
        assert n > 1000 and got.count() == n
        assert got.exceptAll(want.select("v", "pos")).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_encodings_are_shares(spark, sf):
    df = clean_survey_y(spark, sf).withColumn("key", F.coalesce("country", F.lit("_")))
    te = en.oof_target_encoding(df, "key")
    bad = te.filter((F.abs(F.col("te0") + F.col("te1") + F.col("te2") - 1) > 1e-9)
                    | (F.least("te0", "te1", "te2") <= 0) | (F.greatest("te0", "te1", "te2") >= 1))
    assert te.count() == df.count() and bad.count() == 0


def test_own_label_does_not_leak_into_own_encoding(spark, sf):
    """Flipping one row's label changes its own out-of-fold encoding only
    through the global shares (its own count is never used)."""
    df = clean_survey_y(spark, sf).withColumn("key", F.coalesce("country", F.lit("_"))).select("id", "y", "key")
    df = fo.assign_folds(df, k=3, seed=49, out="inner")          # folds held fixed
    target = df.orderBy("id").first()
    flipped = df.withColumn("y", F.when(F.col("id") == target["id"], (F.col("y") + 1) % 3).otherwise(F.col("y")))
    a = en.oof_target_encoding(df, "key", fold_col="inner").filter(F.col("id") == target["id"]).first()
    b = en.oof_target_encoding(flipped, "key", fold_col="inner").filter(F.col("id") == target["id"]).first()
    # only the global shares move, by 1/n at most, scaled by alpha/(n_other + alpha) < 1
    n = df.count()
    assert all(abs(a[f"te{c}"] - b[f"te{c}"]) <= 1.0 / n + 1e-12 for c in range(3))


def test_blend_sums_to_one(spark, sf):
    long = oof_long5(spark, sf)
    assert long.filter(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1) > 1e-9).count() == 0


def test_alpha_one_equals_baseline(spark, sf):
    rows = de.decision_input(fx.oof(spark, sf))
    sw = de.alpha_sweep(rows, alphas=(1.0,))
    base = de.medium_baseline(rows).first()
    r = sw.first()
    assert r["phc"] == base["phc_base"] and round(r["wf1"], 6) == base["wf1_base"]


def test_impossible_gate_equals_baseline(spark, sf):
    rows = de.decision_input(fx.oof(spark, sf))
    sw = de.gate_sweep(rows, t_cb=[1.5], t_blend=[1.5]).first()
    base = de.medium_baseline(rows).first()
    assert sw["phc"] == base["phc_base"] and sw["tpr"] == 0.0 and sw["fpr"] == 0.0


def test_bucketed_alpha_sweep_equals_row_expansion(spark, sf):
    rows = de.decision_input(fx.oof(spark, sf))
    fast = {r["alpha_idx"]: (r["wf1"], r["phc"]) for r in de.alpha_sweep(rows).collect()}
    for i, a in enumerate(ALPHAS):
        adj = rows.select("y", (F.lit(a) * F.col("p2")).alias("a2"), "p0", "p1")
        m = me.metric_bundle(adj.withColumn("pred", me.argmax3("p0", "p1", "a2"))).first()
        assert (m["wf1"], m["phc"]) == fast[i]


def test_bucketed_gate_sweep_equals_row_expansion(spark, sf):
    """Brute force on the rows, grid point by grid point, against the
    bucketed sweep (corners, middle and an asymmetric point)."""
    rows = de.decision_input(fx.oof(spark, sf))
    fast = {(r["i"], r["j"]): r for r in de.gate_sweep(rows).collect()}
    base = me.argmax3("p0", "p1", "p2")
    missed = (F.col("y") == 2) & (base != 2)
    nonhigh = F.col("y") != 2
    for i, j in [(0, 0), (0, 10), (10, 0), (5, 5), (3, 8), (10, 10)]:
        gate = (F.col("c2") > F.lit(GATE_GRID[i])) & (F.col("p2") > F.lit(GATE_GRID[j]))
        lifted = F.when(gate, F.greatest("p2", F.lit(GATE_HIGH_FLOOR))).otherwise(F.col("p2"))
        s = F.col("p0") + F.col("p1") + lifted
        pred = me.argmax3(F.col("p0") / s, F.col("p1") / s, lifted / s)
        m = me.metric_bundle(rows.withColumn("pred", pred)).first()
        r = rows.agg(F.sum((gate & missed).cast("long")).alias("gm"), F.sum(missed.cast("long")).alias("nm"),
                     F.sum((gate & nonhigh).cast("long")).alias("gn"), F.sum(nonhigh.cast("long")).alias("nn")).first()
        tpr = r["gm"] / r["nm"] if r["nm"] else 0.0
        fpr = r["gn"] / r["nn"] if r["nn"] else 1.0
        f = fast[(i, j)]
        assert f["phc"] == m["phc"], (i, j)
        assert abs(f["wf1"] - m["wf1"]) < 1e-12 and abs(f["tpr"] - tpr) < 1e-12 and abs(f["fpr"] - fpr) < 1e-12


def test_validation_labels_do_not_reach_fold_fits(spark, sf):
    """Changing every validation label of fold k changes none of the tables
    fitted for that fold (folds held fixed)."""
    df = fo.assign_folds(clean_survey_y(spark, sf).withColumn("key", F.coalesce("country", F.lit("_"))))
    k = 1
    flipped = df.withColumn("y", F.when(F.col("fold") == k, (F.col("y") + 1) % 3).otherwise(F.col("y")))

    def fits(d):
        train, _ = fo.split_fold(d, k)
        return [en.target_encode_lookup(train, d, "key", keep=("id",)),
                en.oof_target_encoding(train, "key"),
                fe.country_stats(train), en.balanced_weights(train), en.class_shares(train)]

    for a, b in zip(fits(df), fits(flipped)):
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_permuting_partitions_changes_nothing(spark, sf):
    long = oof_long5(spark, sf)
    a = me.oof_metrics(long)
    b = me.oof_metrics(long.repartition(7, "id").sortWithinPartitions(F.rand(3)))
    assert a.exceptAll(b).count() == 0
