"""Encodings fitted on a training part: class shares and weights, smoothed
target encoding (full map and out-of-fold), ordinal codes, frozen category
codes, standard scaling and nearest-centre assignment.

Scale notes
* Counts are additive, so the out-of-fold encoding needs no loop over inner
  folds: count per (key, inner fold, class) once, take the key totals with a
  window over that small table, and subtract the row's own fold.
* Every fitted table is one row per key (or per key and fold); such tables are
  broadcast only after their size is checked.
* Global shares are three numbers: fitted parameters (one aggregate, three
  floats on the driver, inlined as literals), never a window over the whole
  key table and never a join with a one-row table.
* Ordinal codes number the distinct categories by a distributed sort
  (``sorted_positions``), not a single-partition window.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewise.config import (CLUSTER_TE_FOLDS, FIXED_CLASS_WEIGHTS, INNER_FOLD_SEED_OFFSET,
                              MISSING_TOKEN, N_CLASSES, SEED, TE_SMOOTH_ALPHA)
from scorewise.functions.columns import count_true, dlit
from scorewise.operators.folds import assign_folds
from scorewise.operators.joins import bounded_broadcast, checked_broadcast
from scorewise.session import cut_lineage

CLASSES = tuple(range(N_CLASSES))


# ---------------------------------------------------------------------------
# class shares and weights
# ---------------------------------------------------------------------------
def class_shares(df: DataFrame, y: str = "y") -> DataFrame:
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())           # one row per class
    return counts.withColumn("share", F.col("n") / total)


def balanced_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """n / (n_classes * n_c) per class (classes present in the data)."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    return counts.withColumn(
        "weight", F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n")))


def with_balanced_weight(df: DataFrame, y: str = "y", out: str = "weight") -> DataFrame:
    w = balanced_weights(df, y).select(y, F.col("weight").alias(out))
    return df.join(F.broadcast(w), y, "left")               # <= n_classes rows


def with_fixed_weight(df: DataFrame, y: str = "y", weights=FIXED_CLASS_WEIGHTS,
                      out: str = "weight") -> DataFrame:
    expr = F.element_at(F.array(*[dlit(w) for w in weights]), F.col(y) + 1)
    return df.withColumn(out, expr)


# ---------------------------------------------------------------------------
# target encoding
# ---------------------------------------------------------------------------
def _class_count_aggs(y: str):
    return [count_true(F.col(y) == c).alias(f"n{c}") for c in CLASSES]


def _smoothed(nc, n, share, alpha):
    return (nc + dlit(alpha) * share) / (n + dlit(alpha))


def target_encoding_map(df: DataFrame, key: str, y: str = "y",
                        alpha: float = TE_SMOOTH_ALPHA) -> DataFrame:
    """Per key: n and smoothed class shares (n_c + a*share_c) / (n + a)."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *_class_count_aggs(y))
    g = global_shares(df, y)
    return per_key.select(key, "n", *[_smoothed(F.col(f"n{c}"), F.col("n"), dlit(g[c]), alpha).alias(f"te{c}")
                                      for c in CLASSES], *[dlit(g[c]).alias(f"g{c}") for c in CLASSES])


def global_shares(train: DataFrame, y: str = "y") -> list[float]:
    """The training part's class shares: three fitted numbers (driver side)."""
    r = train.agg(F.count(F.lit(1)).alias("n"), *_class_count_aggs(y)).first()
    return [r[f"n{c}"] / r["n"] for c in CLASSES]


def target_encode_lookup(train: DataFrame, rows: DataFrame, key: str, y: str = "y",
                         alpha: float = TE_SMOOTH_ALPHA, keep=("id",), prefix: str = "te") -> DataFrame:
    """Encode ``rows`` with the map fitted on ``train``; keys unseen in
    training get the training part's global shares.  ``keep=None`` keeps
    every column of ``rows``."""
    te = target_encoding_map(train, key, y, alpha)
    g = global_shares(train, y)
    m = checked_broadcast(te.select(key, *[F.col(f"te{c}").alias(f"_m{c}") for c in CLASSES]))
    base = rows if keep is None else rows.select(*keep, key)
    out = base.join(m, key, "left")
    kept = [c for c in base.columns if keep is None or c in keep]
    return out.select(*kept, *[F.coalesce(F.col(f"_m{c}"), dlit(g[c])).alias(f"{prefix}{c}")
                               for c in CLASSES])


def oof_target_encoding(df: DataFrame, key: str, y: str = "y", id_col: str = "id",
                        n_folds: int = CLUSTER_TE_FOLDS, seed: int = SEED + INNER_FOLD_SEED_OFFSET,
                        alpha: float = TE_SMOOTH_ALPHA, keep_all: bool = False,
                        prefix: str = "te", fold_col: str | None = None) -> DataFrame:
    """Each row encoded from the other inner folds only (no leakage of its own
    label); keys absent from the other folds get the global shares.  Global
    shares come from the whole training part.  ``keep_all`` returns every
    input column plus the encodings (no join back by id needed)."""
    src = df if keep_all else df.select(id_col, y, key, *([fold_col] if fold_col else []))
    f = (src.withColumn("_if", F.col(fold_col)) if fold_col else
         assign_folds(src, k=n_folds, seed=seed, id_col=id_col, y_col=y, out="_if"))
    g = global_shares(src, y)
    cell = f.groupBy(key, "_if").agg(F.count(F.lit(1)).alias("_nf"), *_class_count_aggs(y))
    by_key = Window.partitionBy(key)                  # <= n_folds rows per key
    t = cell.withColumn("_no", F.sum("_nf").over(by_key) - F.col("_nf"))
    enc = {}
    for c in CLASSES:
        other_c = F.sum(f"n{c}").over(by_key) - F.col(f"n{c}")
        enc[f"{prefix}{c}"] = F.when(F.col("_no") > 0, _smoothed(other_c, F.col("_no"), dlit(g[c]), alpha)) \
            .otherwise(dlit(g[c]))
    small = checked_broadcast(t.select(key, "_if", *[v.alias(k) for k, v in enc.items()]))
    out = f.join(small, [key, "_if"], "left").drop("_if")
    out = out.withColumns({k: F.coalesce(k, dlit(g[c])) for c, k in enumerate(enc)})     # NULL keys
    if keep_all:
        return out
    return out.select(id_col, *[f"{prefix}{c}" for c in CLASSES])


# ---------------------------------------------------------------------------
# ordinal codes (M7) and frozen category codes (M8)
# ---------------------------------------------------------------------------
def _code_table(train: DataFrame, col: str, as_text_missing: bool) -> DataFrame:
    """Distinct categories of ``col`` with their 0-based position in text order."""
    v = F.coalesce(F.col(col), F.lit("nan")) if as_text_missing else F.col(col)
    cats = train.select(v.alias("_v")).filter(F.col("_v").isNotNull()).distinct()
    return sorted_positions(cats, "_v", f"{col}_code")


def sorted_positions(values: DataFrame, cols, out: str) -> DataFrame:
    """0-based position of each row of ``values`` in the order of ``cols``, without a
    single-task window: the global sort range-partitions the rows, and
    ``monotonically_increasing_id`` tags each with (partition, index inside
    it).  The tagged table is checkpointed (reliably) so the position and the
    partition sizes below read the same tags, even after an executor loss.
    Position = rows in lower partitions + index; the offset table has one row
    per sort partition (bounded by the shuffle partition count)."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    tagged = cut_lineage(values.orderBy(*cols).select(*cols, F.monotonically_increasing_id().alias("_t")))
    tagged = tagged.select(*cols, F.shiftright("_t", 33).alias("_p"),
                           F.col("_t").bitwiseAND(F.lit((1 << 33) - 1)).alias("_i"))
    sizes = tagged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    below = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)   # sort partitions
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_off"))
    return (tagged.join(bounded_broadcast(offsets), "_p")
            .select(*cols, (F.col("_off") + F.col("_i")).cast("int").alias(out)))


def category_codes(train: DataFrame, rows: DataFrame, cols, as_text_missing: bool,
                   keep=("id",)) -> DataFrame:
    """Codes from the training part's sorted categories.  ``as_text_missing``:
    NULL is the text 'nan', a category of its own, and unseen values are -1
    (ordinal encoder); otherwise missing and unseen values are NULL (frozen
    categorical)."""
    out = rows
    for c in cols:
        codes = checked_broadcast(_code_table(train, c, as_text_missing))
        v = F.coalesce(F.col(c), F.lit("nan")) if as_text_missing else F.col(c)
        out = out.withColumn("_v", v).join(codes, "_v", "left").drop("_v")
        if as_text_missing:
            out = out.withColumn(f"{c}_code", F.coalesce(F.col(f"{c}_code"), F.lit(-1)))
    if keep is None:
        return out
    return out.select(*keep, *[f"{c}_code" for c in cols])


def fold_codes_of(train: DataFrame, col: str, as_text_missing: bool) -> DataFrame:
    """``k, _v, <col>_code``: the sorted categories of every fold's train rows; one
    sort numbers those of all folds."""
    v = F.coalesce(F.col(col), F.lit("nan")) if as_text_missing else F.col(col)
    cats = train.select("k", v.alias("_v")).filter(F.col("_v").isNotNull()).distinct()
    at = sorted_positions(cats, ["k", "_v"], "_at")
    first = at.groupBy("k").agg(F.min("_at").alias("_first"))                       # a row per fold
    return at.join(bounded_broadcast(first), "k").select("k", "_v", (F.col("_at") - F.col("_first")).alias(f"{col}_code"))


def fold_category_codes(exploded: DataFrame, cols, as_text_missing: bool, keep) -> DataFrame:
    """``category_codes`` of every outer fold at once: ``exploded`` has a row per
    (fold ``k``, row) with its ``role``; the categories of a fold are those of its
    train rows."""
    out = exploded
    for c in cols:
        v = F.coalesce(F.col(c), F.lit("nan")) if as_text_missing else F.col(c)
        codes = checked_broadcast(fold_codes_of(exploded.filter(F.col("role") == "train"), c, as_text_missing))
        out = out.withColumn("_v", v).join(codes, ["k", "_v"], "left").drop("_v")
        if as_text_missing:
            out = out.withColumn(f"{c}_code", F.coalesce(F.col(f"{c}_code"), F.lit(-1)))
    return out.select(*keep, *[f"{c}_code" for c in cols])


# ---------------------------------------------------------------------------
# standard scaling (M3) and nearest centre (M5)
# ---------------------------------------------------------------------------
def fit_scaler(df: DataFrame, cols) -> DataFrame:
    """One row: mean and population std per column (zero std -> 1), NULL as 0."""
    aggs = []
    for c in cols:
        v = F.coalesce(F.col(c).cast("double"), dlit(0.0))
        aggs += [F.avg(v).alias(f"{c}__mean"), F.stddev_pop(v).alias(f"{c}__std")]
    return df.agg(*aggs)


def scaler_values(scaler_row) -> dict:
    """Driver copy of the (2 x columns) scaler parameters."""
    d = scaler_row.asDict()
    out = {}
    for k, v in d.items():
        c, part = k.rsplit("__", 1)
        out.setdefault(c, {})[part] = v
    for c, p in out.items():
        if p["std"] is None or p["std"] == 0.0:
            p["std"] = 1.0
    return out


def apply_scaler(df: DataFrame, params: dict, keep=("id",)) -> DataFrame:
    cols = [((F.coalesce(F.col(c).cast("double"), dlit(0.0)) - dlit(p["mean"])) / dlit(p["std"])).alias(c)
            for c, p in params.items()]
    return df.select(*keep, *cols)


def nearest_centre(df: DataFrame, vec_col: str, centres: list[list[float]], keep=("id",),
                   id_out: str = "cluster_id", dist_out: str = "dist") -> DataFrame:
    """Nearest centre (ties -> lowest index) and Euclidean distance to it.
    ``centres`` are model parameters (k x d, bounded), inlined as literals."""
    v = F.col(vec_col)
    dists = []
    for cvec in centres:                                  # unrolled: no interpreted lambda per row
        sq = reduce(add, [(v[i] - dlit(float(x))) * (v[i] - dlit(float(x))) for i, x in enumerate(cvec)])
        dists.append(F.sqrt(sq))
    arr = F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(dists)])
    best = F.array_min(arr)
    return df.select(*keep, best["i"].alias(id_out), best["d"].alias(dist_out))


def label_centres(df: DataFrame, vec_col: str, label: str) -> DataFrame:
    """``label, centre``: the mean vector per label, a table of any size."""
    cells = (df.select(label, F.posexplode(vec_col).alias("pos", "x"))
             .groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("m")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return cells.groupBy(label).agg(F.transform(ordered, lambda s: s["m"]).alias("centre"))
