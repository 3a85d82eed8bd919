"""The fold cache joins rows without the driver."""

import pytest
from pyspark.sql import functions as F

from scorewise.operators import fold_cache as fc
from scorewise.operators import folds as fo
from scorewise.operators.joins import row_join
from scorewise.session import cut_lineage


def test_features_of_a_fold_are_joined_in_buckets_without_a_broadcast(spark):
    base = spark.range(40).withColumn("y", (F.col("id") % 3).cast("int"))
    static = base.select("id", (F.col("id") % 2).cast("int").alias("role")).crossJoin(spark.range(2).select(F.col("id").cast("int").alias("k")))
    seeded = static.select("id", "k", F.lit(42).alias("seed"), (F.col("id") * 2).alias("c"))
    cache = fc.FoldCache(fc.bucketed(base, 3), fc.bucketed(static, 3, ("k",)), fc.bucketed(seeded, 3, ("seed", "k")), 3, None)
    rows = cache.features(1, 42)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Exchange" not in plan and plan.count("SortMergeJoin") == 2
    assert sorted((r["id"], r["c"]) for r in rows.collect()) == [(i, 2 * i) for i in range(40)]


def test_row_join_keeps_repeated_and_null_keys_as_a_plain_join_does(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "id long, x string")
    b = spark.createDataFrame([(1, 1.0), (1, 2.0), (None, 3.0), (3, 4.0)], "id long, v double")
    for how in ("inner", "left"):
        assert sorted(map(str, row_join(a, b, "id", how).collect())) == sorted(map(str, a.join(b, "id", how).collect()))


@pytest.mark.parametrize("digits", (1, 3, 4))
def test_folds_do_not_depend_on_the_buckets(spark, digits):
    df = cut_lineage(spark.range(300).select("id", (F.col("id") % 3).cast("int").alias("y"), (F.col("id") % 2).cast("int").alias("k")))
    got = {r["id"]: r["fold"] for r in fo.assign_folds(df, k=3, seed=5, digits=digits, by=("k",)).collect()}
    assert got == {r["id"]: r["fold"] for r in fo.assign_folds(df, k=3, seed=5, by=("k",)).collect()}
