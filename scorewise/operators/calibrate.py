"""Calibration of one model's High score.

The bin count depends on the data (min(10, max(3, n_high // 30))).  Instead of
a first job to count High rows, every row is binned for every possible bin
count (3..10) in the same pass - a bounded expansion - and the partial
aggregation reduces that to at most 8 * 2 * 10 cells; the right bin count is
then chosen on the tiny table.  No driver round trip, one scan.

Bins are uniform on [0, 1].  Calibration bins put a value on an inner edge in
the lower bin (ceil(p*n) - 1); histogram bins (used by the original weights)
put it in the upper bin (floor(p*n)), the last bin closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewise.config import (CALIBRATION_BASE_THRESHOLD, CALIBRATION_BIAS_BAND,
                              CALIBRATION_HIGH_PER_BIN, CALIBRATION_MAX_BINS,
                              CALIBRATION_MAX_THRESHOLD, CALIBRATION_MIN_BINS,
                              CALIBRATION_MIN_THRESHOLD)
from scorewise.functions.columns import dlit


def _binned(rows: DataFrame, prob: str, y: str, positive: int, min_bins: int, max_bins: int) -> DataFrame:
    p = F.col("p")
    entries = []
    for nb in range(min_bins, max_bins + 1):
        cal = F.least(F.greatest(F.ceil(p * nb).cast("int") - 1, F.lit(0)), F.lit(nb - 1))
        hist = F.least(F.floor(p * nb).cast("int"), F.lit(nb - 1))
        entries += [F.struct(F.lit(nb).alias("nb"), F.lit("cal").alias("kind"), cal.alias("bin")),
                    F.struct(F.lit(nb).alias("nb"), F.lit("hist").alias("kind"), hist.alias("bin"))]
    base = rows.select(F.col(prob).cast("double").alias("p"),
                       (F.col(y) == positive).cast("int").alias("pos"))
    return (base.select("p", "pos", F.inline(F.array(*entries)))
            .groupBy("nb", "kind", "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("sum_p"),
                 F.sum("pos").cast("bigint").alias("n_pos")))


def _chosen(cells: DataFrame, min_bins: int, max_bins: int, per_bin: int) -> DataFrame:
    tot = Window.partitionBy("nb", "kind")           # <= 8 * 2 groups of <= 10 cells
    c = cells.withColumns({"n_high": F.sum("n_pos").over(tot), "n_total": F.sum("n").over(tot)})
    want = F.least(F.lit(max_bins), F.greatest(F.lit(min_bins), F.floor(F.col("n_high") / per_bin)))
    return c.filter(F.col("nb") == want)


def calibration_bins(rows: DataFrame, prob: str = "c2", y: str = "y", positive: int = 2,
                     min_bins: int = CALIBRATION_MIN_BINS, max_bins: int = CALIBRATION_MAX_BINS,
                     per_bin: int = CALIBRATION_HIGH_PER_BIN) -> DataFrame:
    cells = _chosen(_binned(rows, prob, y, positive, min_bins, max_bins), min_bins, max_bins, per_bin)
    return (cells.filter(F.col("kind") == "cal")
            .select(F.col("nb").alias("n_bins"), "bin", "n",
                    (F.col("sum_p") / F.col("n")).alias("mean_pred"),
                    (F.col("n_pos") / F.col("n")).alias("frac_pos")))


def calibration_summary(rows: DataFrame, prob: str = "c2", y: str = "y", positive: int = 2,
                        min_bins: int = CALIBRATION_MIN_BINS, max_bins: int = CALIBRATION_MAX_BINS,
                        per_bin: int = CALIBRATION_HIGH_PER_BIN,
                        band: float = CALIBRATION_BIAS_BAND) -> DataFrame:
    """ECE (bin-aligned weights, and the original position-paired weights),
    bias = mean over non-empty bins of (mean_pred - frac_pos), bias label and
    the suggested threshold."""
    cells = _chosen(_binned(rows, prob, y, positive, min_bins, max_bins), min_bins, max_bins, per_bin)
    cal = (cells.filter(F.col("kind") == "cal")
           .withColumns({"mean_pred": F.col("sum_p") / F.col("n"), "frac_pos": F.col("n_pos") / F.col("n")})
           .withColumn("pos_k", F.row_number().over(Window.partitionBy("nb").orderBy("bin")) - 1))
    hist = cells.filter(F.col("kind") == "hist").select(F.col("bin").alias("pos_k"), F.col("n").alias("hist_n"))
    paired = cal.join(hist, "pos_k", "left")        # <= 10 rows each side
    gap = F.abs(F.col("frac_pos") - F.col("mean_pred"))
    one = paired.agg(
        F.first("nb").alias("n_bins"),
        F.sum(gap * F.col("n") / F.col("n_total")).alias("ece"),
        F.sum(gap * F.coalesce(F.col("hist_n"), F.lit(0)) / F.col("n_total")).alias("ece_legacy"),
        F.avg(F.col("mean_pred") - F.col("frac_pos")).alias("bias_raw"))
    b = F.col("bias_raw")
    label = (F.when(b > dlit(band), F.lit("inflated")).when(b < dlit(-band), F.lit("deflated"))
             .otherwise(F.lit("calibrated")))
    base = dlit(CALIBRATION_BASE_THRESHOLD) + b
    suggestion = (F.when(label == "inflated", F.round(F.least(dlit(CALIBRATION_MAX_THRESHOLD), base), 2))
                  .when(label == "deflated", F.round(F.greatest(dlit(CALIBRATION_MIN_THRESHOLD), base), 2))
                  .otherwise(dlit(CALIBRATION_BASE_THRESHOLD)))
    return one.select("n_bins", "ece", "ece_legacy", "bias_raw", label.alias("bias"),
                      suggestion.alias("threshold_suggestion"))


def calibrated_thresholds(summary: DataFrame, step: float = 0.05, inflated_span: float = 0.30,
                          deflated_floor: float = 0.15, deflated_below: float = 0.10,
                          deflated_span: float = 0.20) -> DataFrame:
    """Older threshold list from the calibration: a float range from the
    suggestion (numpy ``arange`` length and values, rounded to 2 digits),
    or the fixed list 0.25 .. 0.50 when calibrated."""
    s = F.col("threshold_suggestion")
    lo = (F.when(F.col("bias") == "deflated", F.greatest(dlit(deflated_floor), s - dlit(deflated_below)))
          .otherwise(s))
    hi = F.when(F.col("bias") == "deflated", s + dlit(deflated_span)).otherwise(s + dlit(inflated_span))
    calibrated = F.col("bias") == "calibrated"
    n = F.when(calibrated, F.lit(6)).otherwise(F.ceil((hi - lo) / dlit(step)).cast("int"))
    t = summary.select(calibrated.alias("_cal"), lo.alias("_lo"),
                       F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    value = (F.when(F.col("_cal"), (F.lit(25) + 5 * F.col("i")).cast("double") / 100)
             .otherwise(F.round(F.col("_lo") + F.col("i") * dlit(step), 2)))
    return t.select("i", value.alias("threshold"))
