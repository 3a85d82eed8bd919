"""Confusion-first classification metrics.

Every metric derives from at most nine counts per key (support, predicted and
true-positive count per class), so the rows are scanned once by one partial
aggregation whatever the number of metrics or candidates.  The count table is
tiny (keys x 10 columns) and never grows with the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewise.config import CLASS_LABELS, MODEL_NAMES, N_CLASSES
from scorewise.functions.columns import argmax3, count_true, dlit, r6, ratio  # noqa: F401 (argmax3 re-exported)

CLASSES = tuple(range(N_CLASSES))


# ---------------------------------------------------------------------------
# score tables
# ---------------------------------------------------------------------------
def scores_long(wide: DataFrame, sources: dict | None = None,
                keep: tuple = ("id", "y")) -> DataFrame:
    """Wide score table -> long ``(keep.., model, p0, p1, p2)`` in one pass.

    ``sources`` maps model name -> three class-score Columns; by default the
    three model column groups ``cb*``, ``lg*``, ``xg*``.  One ``inline`` over a
    literal array: no union, so the source is scanned once.
    """
    if sources is None:
        sources = {m: [F.col(f"{m}{c}") for c in CLASSES] for m in MODEL_NAMES}
    entries = [F.struct(F.lit(name).alias("model"),
                        *[p.cast("double").alias(f"p{c}") for c, p in enumerate(ps)])
               for name, ps in sources.items()]
    return wide.select(*keep, F.inline(F.array(*entries)))


def with_pred(df: DataFrame, p=("p0", "p1", "p2"), out: str = "pred") -> DataFrame:
    return df.withColumn(out, argmax3(*p))


# ---------------------------------------------------------------------------
# counts and metrics
# ---------------------------------------------------------------------------
def count_aggs(y: str = "y", pred: str = "pred", weight: str | None = None,
               prefix: str = "", with_n: bool = True) -> list:
    """Aggregate columns: n, support s_c, predicted q_c, true positives t_c."""
    w = F.col(weight) if weight else F.lit(1)
    yc, pc = F.col(y), F.col(pred)
    aggs = [F.sum(w).cast("bigint").alias(f"{prefix}n")] if with_n else []
    for c in CLASSES:
        aggs += [count_true(yc == c, w).alias(f"{prefix}s{c}"),
                 count_true(pc == c, w).alias(f"{prefix}q{c}"),
                 count_true((yc == c) & (pc == c), w).alias(f"{prefix}t{c}")]
    return aggs


def class_counts(df: DataFrame, keys=(), y: str = "y", pred: str = "pred",
                 weight: str | None = None) -> DataFrame:
    """Per key: n, support s_c, predicted q_c, true positives t_c."""
    return df.groupBy(*keys).agg(*count_aggs(y, pred, weight))


def metric_exprs(prefix: str = "", n_col: str = "n") -> dict:
    """Precision/recall/F1 per class, weighted and macro F1, accuracy as
    expressions over the count columns (one projection, one analysis)."""
    p = prefix
    out = {}
    for c in CLASSES:
        s, q, t = F.col(f"{p}s{c}"), F.col(f"{p}q{c}"), F.col(f"{p}t{c}")
        out[f"{p}prec{c}"] = ratio(t, q)
        out[f"{p}rec{c}"] = ratio(t, s)
        out[f"{p}f1_{c}"] = ratio(2 * t, s + q)
    f1 = [out[f"{p}f1_{c}"] for c in CLASSES]
    s = [F.col(f"{p}s{c}") for c in CLASSES]
    present = [F.when(F.col(f"{p}s{c}") + F.col(f"{p}q{c}") > 0, 1).otherwise(0) for c in CLASSES]
    n = F.col(n_col)
    out[f"{p}wf1"] = ratio(f1[0] * s[0] + f1[1] * s[1] + f1[2] * s[2], n)
    out[f"{p}macro_f1"] = ratio(f1[0] + f1[1] + f1[2], present[0] + present[1] + present[2])
    out[f"{p}accuracy"] = ratio(F.col(f"{p}t0") + F.col(f"{p}t1") + F.col(f"{p}t2"), n)
    return out


def with_metrics(counts: DataFrame, prefix: str = "", n_col: str = "n") -> DataFrame:
    """Add precision/recall/F1 per class, weighted and macro F1, accuracy."""
    return counts.withColumns(metric_exprs(prefix, n_col))


def metric_bundle(df: DataFrame, keys=(), y="y", pred="pred", weight=None) -> DataFrame:
    """WF1, High recall/precision/F1, predicted-High count, Medium F1/recall/precision."""
    e = metric_exprs()
    return class_counts(df, keys, y, pred, weight).select(
        *keys, e["wf1"].alias("wf1"), e["rec2"].alias("hrec"), e["prec2"].alias("hpre"),
        e["f1_2"].alias("hf1"), F.col("q2").alias("phc"), e["f1_1"].alias("med_f1"),
        e["rec1"].alias("med_rec"), e["prec1"].alias("med_pre"), e["macro_f1"].alias("macro_f1"), F.col("n"))


def rounded(df: DataFrame, exclude=()) -> DataFrame:
    """Round every double column to 6 digits (report form)."""
    return df.select(*[r6(f.name).alias(f.name) if f.dataType.typeName() == "double"
                       and f.name not in exclude else F.col(f.name)
                       for f in df.schema.fields])


# ---------------------------------------------------------------------------
# report queries
# ---------------------------------------------------------------------------
def oof_metrics(long_df: DataFrame, keys=("model",)) -> DataFrame:
    m = metric_bundle(with_pred(long_df), keys)
    return rounded(m.select(*keys, "wf1", "hrec", "hf1", "phc", "med_f1"))


def confusion_matrix(long_df: DataFrame, keys=("model",)) -> DataFrame:
    return (with_pred(long_df).groupBy(*keys, "y", "pred")
            .agg(F.count(F.lit(1)).alias("n")))


def weighted_f1(long_df: DataFrame, keys=("model",)) -> DataFrame:
    return rounded(metric_bundle(with_pred(long_df), keys).select(*keys, "wf1"))


def macro_f1(long_df: DataFrame, keys=("model",)) -> DataFrame:
    return rounded(metric_bundle(with_pred(long_df), keys).select(*keys, "macro_f1"))


def _per_class_rows(m: DataFrame, keys) -> DataFrame:
    entries = [F.struct(F.lit(c).alias("class"), F.col(f"prec{c}").alias("precision"),
                        F.col(f"rec{c}").alias("recall"), F.col(f"f1_{c}").alias("f1"),
                        F.col(f"s{c}").alias("support"))
               for c in CLASSES]
    return m.select(*keys, F.inline(F.array(*entries)))


def per_class_metrics(long_df: DataFrame, keys=("model",)) -> DataFrame:
    m = with_metrics(class_counts(with_pred(long_df), keys))
    return rounded(_per_class_rows(m, keys))


def classification_report(long_df: DataFrame, keys=("model",)) -> DataFrame:
    """Per class rows plus accuracy, macro avg and weighted avg rows."""
    m = with_metrics(class_counts(with_pred(long_df), keys))
    names = F.array(*[F.lit(n) for n in CLASS_LABELS])
    per_class = (_per_class_rows(m, keys)
                 .withColumn("row_label", F.element_at(names, F.col("class") + 1))
                 .drop("class"))
    s = [F.col(f"s{c}") for c in CLASSES]
    n = F.col("n")

    def avg3(prefix):
        return (F.col(f"{prefix}0") + F.col(f"{prefix}1") + F.col(f"{prefix}2")) / 3

    def wavg3(prefix):
        return ratio(F.col(f"{prefix}0") * s[0] + F.col(f"{prefix}1") * s[1]
                     + F.col(f"{prefix}2") * s[2], n)

    summary_entries = [
        F.struct(F.lit("accuracy").alias("row_label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.col("accuracy").alias("f1"),
                 n.alias("support")),
        F.struct(F.lit("macro avg").alias("row_label"), avg3("prec").alias("precision"),
                 avg3("rec").alias("recall"), avg3("f1_").alias("f1"), n.alias("support")),
        F.struct(F.lit("weighted avg").alias("row_label"), wavg3("prec").alias("precision"),
                 wavg3("rec").alias("recall"), F.col("wf1").alias("f1"), n.alias("support")),
    ]
    summary = m.select(*keys, F.inline(F.array(*summary_entries)))
    cols = [*keys, "row_label", "precision", "recall", "f1", "support"]
    return rounded(per_class.select(*cols).unionByName(summary.select(*cols)))


def fold_metrics(long_with_fold: DataFrame) -> DataFrame:
    m = metric_bundle(with_pred(long_with_fold), ("model", "fold"))
    return rounded(m.select("model", "fold", "wf1", "hrec", "n"))


def fold_metric_stats(long_with_fold: DataFrame) -> DataFrame:
    """Mean and population std of per-fold WF1 per model."""
    per_fold = metric_bundle(with_pred(long_with_fold), ("model", "fold"))
    return rounded(per_fold.groupBy("model").agg(
        F.avg("wf1").alias("fold_avg"), F.stddev_pop("wf1").alias("fold_std"),
        F.count(F.lit(1)).alias("n_folds")))


def fold_winner(long_with_fold: DataFrame) -> DataFrame:
    """Per fold: every source's WF1, best marked (ties: all marked)."""
    per_fold = metric_bundle(with_pred(long_with_fold), ("model", "fold"))
    w = Window.partitionBy("fold").orderBy(F.col("wf1").desc())
    return rounded(per_fold.select("fold", "model", "wf1",
                                   (F.rank().over(w) == 1).cast("int").alias("is_best")))


def fold_high_proba(long_with_fold: DataFrame) -> DataFrame:
    return rounded(long_with_fold.groupBy("model", "fold").agg(F.avg("p2").alias("mean_p2")))


def model_comparison(long_with_fold: DataFrame, fold_models=MODEL_NAMES) -> DataFrame:
    """WF1, High recall, macro F1 per source; fold mean/std for single models.

    The rows are counted once by (model, fold); a source's overall counts are
    the sums of its fold counts (at most sources x folds rows)."""
    per_fold = class_counts(with_pred(long_with_fold), ("model", "fold"))
    counts = [c for c in per_fold.columns if c not in ("model", "fold")]
    fold_wf1 = F.when(F.col("model").isin(*fold_models), metric_exprs()["wf1"])
    overall = per_fold.withColumn("_f", fold_wf1).groupBy("model").agg(
        *[F.sum(c).alias(c) for c in counts], F.avg("_f").alias("fold_avg"), F.stddev_pop("_f").alias("fold_std"))
    e = metric_exprs()
    joined = overall.select("model", e["wf1"].alias("wf1"), e["rec2"].alias("hrec"),
                            e["macro_f1"].alias("macro_f1"), "fold_avg", "fold_std")
    best = Window.orderBy(F.col("wf1").desc())   # five rows: one partition is fine
    return rounded(joined.withColumn("is_best", (F.rank().over(best) == 1).cast("int")))
