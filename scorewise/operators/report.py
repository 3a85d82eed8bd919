"""Report operators: submission labels and counts, template join, seed
stability, evidence pack.  All outputs are small tables derived by Spark from
the score table; nothing row-level is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from scorewise.config import SEED_STABILITY_STD_WARN
from scorewise.functions.columns import argmax3, dlit
from scorewise.operators.clean import decode_label
from scorewise.operators.metrics import metric_bundle, with_pred


def submission_labels(long_df: DataFrame, id_col: str = "id") -> DataFrame:
    """Argmax class -> label text, one row per (id, score source)."""
    return long_df.select(id_col, "model", decode_label(argmax3("p0", "p1", "p2")).alias("Target"))


def submission_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("model", "Target").agg(F.count(F.lit(1)).alias("n"))


def submission_from_template(template: DataFrame, labels: DataFrame, id_col: str = "id") -> DataFrame:
    """Left join onto the template's ids: ids without a prediction keep a NULL
    label, predictions for ids outside the template are dropped."""
    return template.select(id_col).join(labels.select(id_col, "Target"), id_col, "left")


def align_scores(long_df: DataFrame, models, id_col: str = "id") -> DataFrame:
    """Separately scored models joined by id in one keyed aggregation: one row per
    id (NULL is an id like any other) with ``<model>0..2``, how often every model
    scored it (``n_<model>``), rows of models that are not named (``n_other``), and
    ``status``: ``ok``, ``missing`` (a model lacks the id) or ``repeated``.  Only
    ``ok`` rows carry scores."""
    named = {m: F.col("model").eqNullSafe(F.lit(m)) for m in models}
    wide = long_df.groupBy(id_col).agg(
        *[F.count_if(is_m).alias(f"n_{m}") for m, is_m in named.items()],
        F.count_if(~F.coalesce(F.col("model").isin(*models), F.lit(False))).alias("n_other"),
        *[F.max(F.when(is_m, F.col(f"p{c}"))).alias(f"{m}{c}") for m, is_m in named.items() for c in range(3)])
    counts = F.array(*[F.col(f"n_{m}") for m in models])
    status = (F.when(F.exists(counts, lambda n: n > 1), F.lit("repeated")).when(F.exists(counts, lambda n: n == 0), F.lit("missing"))
              .otherwise(F.lit("ok")))
    tagged = wide.withColumn("status", status)
    return tagged.select(id_col, *[f"n_{m}" for m in models], "n_other", "status",
                         *[F.when(F.col("status") == "ok", F.col(f"{m}{c}")).alias(f"{m}{c}") for m in models for c in range(3)])


def aligned_scores(long_df: DataFrame, models, write, id_col: str = "id") -> DataFrame:
    """The wide table of ``align_scores`` when every model scored every id once;
    fails, with the number of ids at fault, when one lacks an id, has it twice or
    is not named.  ``write`` stores a table and returns it: the counts are observed
    on that write."""
    seen = Observation()
    kinds = [F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "repeated").alias("repeated"),
             F.count_if(F.col("n_other") > 0).alias("of other models")]
    stored = write(align_scores(long_df, models, id_col).observe(seen, *kinds))
    if bad := {k: n for k, n in seen.get.items() if n}:
        raise ValueError(f"scores do not align by {id_col}: {bad}")
    return stored.drop("status", "n_other", *[f"n_{m}" for m in models])


def seed_metrics(long_with_seed: DataFrame) -> DataFrame:
    m = metric_bundle(with_pred(long_with_seed), ("seed",))
    return m.select("seed", "wf1", "hrec", "phc")


def seed_stability(per_seed: DataFrame, warn: float = SEED_STABILITY_STD_WARN) -> DataFrame:
    """Means and population stds across seeds; unstable if WF1 or High-recall
    std exceeds ``warn``."""
    s = per_seed.agg(F.avg("wf1").alias("wf1_mean"), F.stddev_pop("wf1").alias("wf1_std"),
                     F.avg("hrec").alias("hrec_mean"), F.stddev_pop("hrec").alias("hrec_std"),
                     F.avg(F.col("phc").cast("double")).alias("phc_mean"),
                     F.stddev_pop(F.col("phc").cast("double")).alias("phc_std"),
                     F.count(F.lit(1)).alias("n_seeds"))
    flag = (F.col("wf1_std") > dlit(warn)) | (F.col("hrec_std") > dlit(warn))
    return s.withColumn("instability_flag", flag.cast("int"))


def evidence_pack(sections: dict[str, DataFrame]) -> DataFrame:
    """One row, one JSON document: each section is a small table (one row ->
    object, several rows -> array of objects)."""
    parts = []
    for name, df in sections.items():
        rows = df.agg(F.collect_list(F.struct(*df.columns)).alias("r"))
        value = F.when(F.size("r") == 1, F.to_json(F.col("r")[0])).otherwise(F.to_json(F.col("r")))
        parts.append(rows.select(F.lit(name).alias("key"), value.alias("value")))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    entries = F.array_sort(F.collect_list(F.concat(F.lit('"'), F.col("key"), F.lit('":'), F.col("value"))))
    return stacked.agg(F.concat(F.lit("{"), F.concat_ws(",", entries), F.lit("}")).alias("evidence"))


#: The evidence document: section -> (columns that name a row, number columns, text columns).
EVIDENCE = {
    "model_comparison": (("model",), ("wf1", "hrec", "macro_f1", "fold_avg", "fold_std", "is_best"), ()),
    "blend": ((), ("w_cb", "w_lg", "w_xg", "wf1", "hrec", "phc", "band_n"), ("dominant_model", "dominant_note")),
    "medium_baseline": ((), ("med_f1_base", "med_rec_base", "med_pre_base", "phc_base", "phc_ceiling", "wf1_base"), ()),
    "calibration": ((), ("n_bins", "ece", "ece_legacy", "bias_raw", "threshold_suggestion"), ("bias",)),
    "recoverable_high": ((), ("n_missed", "recoverable", "recoverable_rate"), ("route",)),
    "alpha": ((), ("passing_count", "best_alpha", "best_wf1", "best_hrec", "best_phc"), ()),
    "gate": ((), ("tried_count", "passing_count", "best_t_cb", "best_t_blend", "best_wf1", "best_tpr"), ()),
    "decision": ((), ("alpha_passing", "best_alpha", "gate_passing", "gate_t_cb", "gate_t_blend"), ("route", "decision")),
    "recommendation": (("case",), ("alpha", "t_cb", "t_blend", "hrec", "wf1", "instability_flag"), ("decision", "note")),
    "seed_metrics": (("seed",), ("wf1", "hrec", "phc"), ()),
    "seed_stability": ((), ("wf1_mean", "wf1_std", "hrec_mean", "hrec_std", "phc_mean", "phc_std", "n_seeds", "instability_flag"), ()),
    "fold_winner": (("fold", "model"), ("wf1", "is_best"), ()),
    "classes": (("target",), ("n", "share"), ()),
    "class_weights": (("y",), ("weight",), ()),
}


def evidence_document(sections: dict[str, DataFrame], schema: dict = EVIDENCE) -> DataFrame:
    """One row: a column per section of the declared schema, each an array of
    structs in the order of its row names (sections are reports: their rows are
    models, folds, seeds and classes, bounded by parameters)."""
    names = [n for n in schema if n in sections]
    parts = []
    for name in names:
        by, numbers, texts = schema[name]
        have = set(sections[name].columns)
        cols = [c for c in (*by, *numbers, *texts) if c in have]
        rows = sections[name].select(*[F.col(c).cast("double") if c in numbers else F.col(c).cast("string") for c in cols])
        whole = rows.agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
        parts.append(whole.select(*[(F.col(n) if n == name else F.lit(None)).alias(n) for n in names]))
    kinds = {n: p.schema[n].dataType for n, p in zip(names, parts, strict=True)}
    stacked = None
    for p in parts:
        p = p.select(*[F.col(n).cast(kinds[n]).alias(n) for n in names])
        stacked = p if stacked is None else stacked.unionByName(p)
    return stacked.agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])


def evidence_rows(document: DataFrame, schema: dict = EVIDENCE) -> DataFrame:
    """The document as rows ``section, item, key, number, text``."""
    out = None
    for name in document.columns:
        by, numbers, texts = schema[name]
        have = document.schema[name].dataType.elementType.names
        rows = document.select(F.inline(name))
        item = F.concat_ws("/", *[F.col(c) for c in by]) if by else F.lit("")
        cells = [F.struct(F.lit(c).alias("key"), (F.col(c) if c in numbers else F.lit(None)).cast("double").alias("number"),
                          (F.col(c) if c in texts else F.lit(None)).cast("string").alias("text")) for c in (*numbers, *texts) if c in have]
        part = rows.select(F.lit(name).alias("section"), item.alias("item"), F.inline(F.array(*cells)))
        out = part if out is None else out.unionByName(part)
    return out
