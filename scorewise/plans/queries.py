"""Query registry: name -> (Spark plan builder, DuckDB oracle SQL or None).

Each Spark builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the whole input tables.  The oracle text runs on DuckDB over the same parquet
files (views named after the tables).  Every averaged or divided output column
is rounded to 6 digits in both, counts are BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewise.config import MODEL_NAMES, PUBLISHED_RAW_WEIGHTS
from scorewise.operators import folds as fo
from scorewise.operators import metrics as me
from scorewise.plans import sql as S
from scorewise.sources import fixtures as fx

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, oracle: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, oracle)
        return fn
    return deco


def normalised(raw) -> tuple:
    s = raw[0] + raw[1] + raw[2]
    return (raw[0] / s, raw[1] / s, raw[2] / s)


BLEND_WEIGHTS = normalised(PUBLISHED_RAW_WEIGHTS)


def R(cols: str) -> str:
    """Oracle select list helper: 'a, ~b, ~x AS y' -> 'a, ROUND(b, 6) AS b, ROUND(x, 6) AS y'."""
    out = []
    for c in (x.strip() for x in cols.split(",")):
        if not c.startswith("~"):
            out.append(c)
            continue
        expr, _, alias = c[1:].partition(" AS ")
        out.append(f"ROUND({expr}, 6) AS {alias or expr}")
    return ", ".join(out)


# ---------------------------------------------------------------------------
# shared Spark inputs
# ---------------------------------------------------------------------------
def source_columns(weights=BLEND_WEIGHTS) -> dict:
    cls = range(3)
    src = {m: [F.col(f"{m}{c}") for c in cls] for m in MODEL_NAMES}
    src["eq"] = [(F.col(f"cb{c}") + F.col(f"lg{c}") + F.col(f"xg{c}")) / 3 for c in cls]
    w = [F.lit(float(x)) for x in weights]
    src["blend"] = [w[0] * F.col(f"cb{c}") + w[1] * F.col(f"lg{c}") + w[2] * F.col(f"xg{c}")
                    for c in cls]
    return src


def oof_long5(spark, d) -> DataFrame:
    """Five score sources: cb, lg, xg, equal blend, published-weight blend."""
    return me.scores_long(fx.oof(spark, d), source_columns())


def oof_long3_folds(spark, d, blend: bool = False) -> DataFrame:
    """cb, lg, xg and equal blend (and the published-weight blend), with the
    frozen fold of each row."""
    src = source_columns()
    if not blend:
        src.pop("blend")
    wide = fo.assign_folds(fx.oof(spark, d).select("id", "y", *[f"{m}{c}" for m in MODEL_NAMES
                                                                  for c in range(3)]))
    return me.scores_long(wide, src, keep=("id", "y", "fold"))


# oracle CTEs
SOURCES5 = ("long", " UNION ALL ".join([S.long_select(), S.eq_select(), S.blend_select(BLEND_WEIGHTS)]))
FOLD_OOF = ("foof", fx.folds_sql("SELECT * FROM oof"))
SOURCES4_FOLD = ("flong", " UNION ALL ".join([S.long_select("foof", extra="fold"),
                                              S.eq_select("foof", extra="fold")]))


def oracle(*ctes, body):
    return S.with_ctes(*ctes, body=body)


# ---------------------------------------------------------------------------
# metrics (A4-A9, A15-A19, T1)
# ---------------------------------------------------------------------------
@register("oof_metrics", oracle(S.oof_cte(), SOURCES5, body=f"""
SELECT {R('model, ~wf1, ~hrec, ~hf1, phc, ~med_f1')}
FROM ({S.bundle(S.with_pred('SELECT * FROM long'), ['model'])}) b"""))
def q_oof_metrics(spark, d):
    return me.oof_metrics(oof_long5(spark, d))


@register("argmax_label", oracle(S.oof_cte(), SOURCES5, body=f"""
SELECT id, model, CAST({S.argmax()} AS INTEGER) AS pred FROM long"""))
def q_argmax_label(spark, d):
    return me.with_pred(oof_long5(spark, d)).select("id", "model", F.col("pred").cast("int"))


@register("confusion_matrix", oracle(S.oof_cte(), SOURCES5, body=f"""
SELECT model, y, CAST(pred AS INTEGER) AS pred, COUNT(*) AS n
FROM ({S.with_pred('SELECT * FROM long')}) p GROUP BY model, y, pred"""))
def q_confusion_matrix(spark, d):
    return me.confusion_matrix(oof_long5(spark, d)).select(
        "model", "y", F.col("pred").cast("int"), "n")


@register("weighted_f1", oracle(S.oof_cte(), SOURCES5, body=f"""
SELECT {R('model, ~wf1')} FROM ({S.bundle(S.with_pred('SELECT * FROM long'), ['model'])}) b"""))
def q_weighted_f1(spark, d):
    return me.weighted_f1(oof_long5(spark, d))


@register("macro_f1", oracle(S.oof_cte(), SOURCES5, body=f"""
SELECT {R('model, ~macro_f1')} FROM ({S.bundle(S.with_pred('SELECT * FROM long'), ['model'])}) b"""))
def q_macro_f1(spark, d):
    return me.macro_f1(oof_long5(spark, d))


_PER_CLASS_SQL = " UNION ALL ".join(
    f"SELECT model, {c} AS class, prec{c} AS precision, rec{c} AS recall, f1_{c} AS f1, s{c} AS support FROM m"
    for c in range(3))


@register("per_class_metrics", oracle(
    S.oof_cte(), SOURCES5,
    ("m", S.metrics(S.counts(S.with_pred("SELECT * FROM long"), ["model"]))),
    body=f"SELECT {R('model, class, ~precision, ~recall, ~f1, support')} FROM ({_PER_CLASS_SQL}) x"))
def q_per_class_metrics(spark, d):
    return me.per_class_metrics(oof_long5(spark, d))


_REPORT_SQL = " UNION ALL ".join(
    [f"SELECT model, '{lab}' AS row_label, prec{c} AS precision, rec{c} AS recall, f1_{c} AS f1, s{c} AS support FROM m"
     for c, lab in enumerate(("Low", "Medium", "High"))]
    + ["SELECT model, 'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), accuracy, n FROM m",
       "SELECT model, 'macro avg', (prec0 + prec1 + prec2) / 3, (rec0 + rec1 + rec2) / 3, "
       "(f1_0 + f1_1 + f1_2) / 3, n FROM m",
       "SELECT model, 'weighted avg', "
       "CASE WHEN n > 0 THEN CAST(prec0 * s0 + prec1 * s1 + prec2 * s2 AS DOUBLE) / n ELSE CAST(0 AS DOUBLE) END, "
       "CASE WHEN n > 0 THEN CAST(rec0 * s0 + rec1 * s1 + rec2 * s2 AS DOUBLE) / n ELSE CAST(0 AS DOUBLE) END, "
       "wf1, n FROM m"])


@register("classification_report", oracle(
    S.oof_cte(), SOURCES5,
    ("m", S.metrics(S.counts(S.with_pred("SELECT * FROM long"), ["model"]))),
    body=f"SELECT {R('model, row_label, ~precision, ~recall, ~f1, support')} FROM ({_REPORT_SQL}) x"))
def q_classification_report(spark, d):
    return me.classification_report(oof_long5(spark, d))


_FOLD_BUNDLE = S.bundle(S.with_pred("SELECT * FROM flong"), ["model", "fold"])


@register("fold_metrics", oracle(S.oof_cte(), FOLD_OOF, SOURCES4_FOLD, body=f"""
SELECT {R('model, fold, ~wf1, ~hrec, n')} FROM ({_FOLD_BUNDLE}) b"""))
def q_fold_metrics(spark, d):
    return me.fold_metrics(oof_long3_folds(spark, d))


@register("fold_metric_stats", oracle(S.oof_cte(), FOLD_OOF, SOURCES4_FOLD, body=f"""
SELECT model, ROUND(AVG(wf1), 6) AS fold_avg, ROUND(STDDEV_POP(wf1), 6) AS fold_std,
       COUNT(*) AS n_folds
FROM ({_FOLD_BUNDLE}) b GROUP BY model"""))
def q_fold_metric_stats(spark, d):
    return me.fold_metric_stats(oof_long3_folds(spark, d))


@register("fold_winner", oracle(S.oof_cte(), FOLD_OOF, SOURCES4_FOLD, body=f"""
SELECT fold, model, ROUND(wf1, 6) AS wf1,
       CAST(CASE WHEN RANK() OVER (PARTITION BY fold ORDER BY wf1 DESC) = 1 THEN 1 ELSE 0 END AS INTEGER) AS is_best
FROM ({_FOLD_BUNDLE}) b"""))
def q_fold_winner(spark, d):
    return me.fold_winner(oof_long3_folds(spark, d))


@register("fold_high_proba", oracle(S.oof_cte(), FOLD_OOF, SOURCES4_FOLD, body="""
SELECT model, fold, ROUND(AVG(p2), 6) AS mean_p2 FROM flong GROUP BY model, fold"""))
def q_fold_high_proba(spark, d):
    return me.fold_high_proba(oof_long3_folds(spark, d))


@register("model_comparison", oracle(
    S.oof_cte(), SOURCES5, FOLD_OOF, SOURCES4_FOLD,
    ("overall", S.bundle(S.with_pred("SELECT * FROM long"), ["model"])),
    ("fstat", f"SELECT model, AVG(wf1) AS fold_avg, STDDEV_POP(wf1) AS fold_std "
              f"FROM ({_FOLD_BUNDLE}) b WHERE model IN ('cb', 'lg', 'xg') GROUP BY model"),
    body="""
SELECT o.model, ROUND(wf1, 6) AS wf1, ROUND(hrec, 6) AS hrec, ROUND(macro_f1, 6) AS macro_f1,
       ROUND(fold_avg, 6) AS fold_avg, ROUND(fold_std, 6) AS fold_std,
       CAST(CASE WHEN RANK() OVER (ORDER BY wf1 DESC) = 1 THEN 1 ELSE 0 END AS INTEGER) AS is_best
FROM overall o LEFT JOIN fstat f ON o.model = f.model"""))
def q_model_comparison(spark, d):
    return me.model_comparison(oof_long3_folds(spark, d, blend=True))


# ---------------------------------------------------------------------------
# folds (W1/M1/S5, J7)
# ---------------------------------------------------------------------------
@register("fold_assignment", oracle(S.survey_cte(), body=f"""
SELECT id, y, fold FROM ({fx.folds_sql(
    "SELECT id, CASE target WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 END AS y FROM survey")}) f"""))
def q_fold_assignment(spark, d):
    from scorewise.operators import clean as cl
    return fo.assign_folds(cl.encode_target(fx.survey(spark, d)).select("id", "y"))
