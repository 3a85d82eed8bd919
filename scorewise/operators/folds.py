"""Frozen stratified k-fold numbering and fold-based splits.

Fold of a row = (rank of md5(id || '-' || seed) within its class) mod k.  md5
keeps the split identical in every engine and every run (no engine-specific
random generator), so it is "frozen" without a file.

Scale: a plain ``row_number().over(partitionBy(y))`` would put a whole class
(65 % of the rows for the majority class) on one task.  We rank in two stages:
rank inside (class, first ``digits`` hex digits of the hash) - 16**digits
independent buckets per class - then add the prefix sum of the bucket counts
of lower buckets.  The bucket-count table has at most classes x 16**digits rows
and is broadcast.  The result is identical to the single-window rank.  Rows with a NULL class are a class of their own: the join
is null-safe, so no row is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewise.config import N_SPLITS, SEED, RunConfig
from scorewise.operators.joins import bounded_broadcast


def fold_hash(id_col: str, seed: int):
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}")))


def assign_folds(df: DataFrame, k: int = N_SPLITS, seed: int = SEED, id_col: str = "id",
                 y_col: str = "y", digits: int | None = None, out: str = "fold", by=()) -> DataFrame:
    """``by``: columns whose values are split apart from each other (one split per outer fold, say)."""
    digits = digits or RunConfig().fold_bucket_digits - bool(by)       # splits apart share one broadcast table: 16 times fewer buckets in each
    keys = [*by, y_col, "_b"]
    hashed = (df.withColumn("_h", fold_hash(id_col, seed))
                .withColumn("_b", F.substring("_h", 1, digits)))
    local_w = Window.partitionBy(*keys).orderBy("_h", id_col)
    ranked = hashed.withColumn("_lr", F.row_number().over(local_w))
    # bucket sizes -> exclusive prefix sums per class (<= classes * 16**digits rows)
    sizes = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    cum_w = Window.partitionBy(*keys[:-1]).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    offsets = sizes.select(*keys, (F.sum("_n").over(cum_w) - F.col("_n")).alias("_off"))
    offsets = offsets.toDF(*[f"_o{i}" for i in range(len(keys))], "_off")
    meets = F.col("_b") == F.col(f"_o{len(keys) - 1}")
    for i, c in enumerate(keys[:-1]):
        meets = F.col(c).eqNullSafe(F.col(f"_o{i}")) & meets
    out_df = (ranked.join(bounded_broadcast(offsets), meets)
              .withColumn(out, ((F.col("_off") + F.col("_lr") - 1) % k).cast("int")))
    return out_df.select(*df.columns, out)


def split_fold(df_with_fold: DataFrame, k: int, fold_col: str = "fold"):
    """(train rows, validation rows) of outer fold k."""
    return (df_with_fold.filter(F.col(fold_col) != k),
            df_with_fold.filter(F.col(fold_col) == k))


def explode_folds(df_with_fold: DataFrame, n_splits: int = N_SPLITS,
                  fold_col: str = "fold") -> DataFrame:
    """One row per (outer fold k, row) with role 'train' / 'val'.

    The long form lets one aggregation fit a statistic for all k folds at
    once (group by k), instead of a driver loop of k jobs.
    """
    return (df_with_fold
            .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
            .withColumn("role", F.when(F.col(fold_col) == F.col("k"), F.lit("val"))
                        .otherwise(F.lit("train"))))


def fold_overlap_check(df_with_fold: DataFrame, n_splits: int = N_SPLITS,
                       id_col: str = "id", fold_col: str = "fold") -> DataFrame:
    """Per fold: train size, validation size, ids present in both (must be 0).

    An id can only be in both parts of a fold if it appears with two fold
    numbers, so one aggregation per id finds every overlap.
    """
    per_id = df_with_fold.groupBy(id_col).agg(F.collect_set(fold_col).alias("_folds"))
    overlap = (per_id.filter(F.size("_folds") > 1).withColumn("fold", F.explode("_folds"))
               .groupBy("fold").agg(F.count(F.lit(1)).cast("bigint").alias("n_overlap")))
    per_fold = df_with_fold.groupBy(F.col(fold_col).alias("fold")).agg(F.count(F.lit(1)).alias("n_val"))
    every = df_with_fold.sparkSession.range(n_splits).select(F.col("id").cast("int").alias("fold"))
    sizes = every.join(per_fold, "fold", "left").select("fold", F.coalesce("n_val", F.lit(0)).cast("bigint").alias("n_val"))
    total = F.sum("n_val").over(Window.partitionBy(F.lit(0)))              # n_splits rows
    return (sizes.withColumn("n_train", (total - F.col("n_val")).cast("bigint")).join(overlap, "fold", "left")
            .select("fold", "n_train", "n_val", F.coalesce("n_overlap", F.lit(0)).cast("bigint").alias("n_overlap")))
