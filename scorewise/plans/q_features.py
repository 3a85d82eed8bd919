"""Registered reading, cleaning and feature queries.

Rounding: pure arithmetic columns are bit-identical in both engines and are
left unrounded (some reach 1e14 after a 1e-9 floor, where a decimal rounding
would itself differ between engines); columns that involve a logarithm or an
aggregate are rounded to 6 digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewise.config import CAT_FEATURES, FLAG_TEXT_VALUES, MISSING_TOKEN, RATIO_FLOOR
from scorewise.functions.columns import NUMBER_PATTERN, lenient_number, r6
from scorewise.operators import clean as cl
from scorewise.operators import features as fe
from scorewise.operators import folds as fo
from scorewise.plans import sql as S
from scorewise.plans.queries import R, oracle, register
from scorewise.sources import fixtures as fx

dbl = S.dbl
RAW_COLUMNS = CAT_FEATURES + fe.NUMERIC_COLUMNS + fe.FLAG_COLUMNS
_FLAGS_ORDERED = tuple(dict.fromkeys(fe.FLAG_COLUMNS))     # unique, schema order below


def round_only(df: DataFrame, cols) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------------------
# oracle text of the cleaner
# ---------------------------------------------------------------------------
def sql_clean_text(c: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {dbl(v)}" for k, v in FLAG_TEXT_VALUES.items())
    return (f"CASE lower(trim({c})) {whens} ELSE COALESCE(CASE WHEN regexp_matches({c}, '{NUMBER_PATTERN}') "
            f"THEN TRY_CAST(trim({c}) AS DOUBLE) END, {dbl(0.0)}) END")


def sql_clean_num(c: str) -> str:
    return f"COALESCE(CAST({c} AS DOUBLE), {dbl(0.0)})"


def _ordered_raw() -> list[str]:
    """Raw survey columns in fixture order (country, owner_sex, numbers, flags)."""
    import re
    names = re.findall(r"END AS (\w+)|AS DOUBLE\) AS (\w+)", fx.SURVEY_SQL)
    out = [a or b for a, b in names]
    return [c for c in out if c not in ("id", "target", "turnover", "expenses")]


ORDER = _ordered_raw()
TEXT_COLS = [c for c in ORDER if c not in fe.NUMERIC_COLUMNS]


def sql_clean_select(keep=CAT_FEATURES) -> str:
    cols = []
    for c in ORDER:
        if c in keep:
            cols.append(c)
        elif c in fe.NUMERIC_COLUMNS:
            cols.append(f"{sql_clean_num(c)} AS {c}")
        else:
            cols.append(f"{sql_clean_text(c)} AS {c}")
    return ", ".join(cols)


Y_SQL = "CAST(CASE target WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 END AS INTEGER)"
CLEAN = ("clean", f"SELECT id, {Y_SQL} AS y, {sql_clean_select()} FROM survey")


def si(c: str) -> str:
    return f"CAST(TRUNC({c}) AS BIGINT)"


def _sum(cols) -> str:
    return "(" + " + ".join(si(c) for c in cols) + ")"


SQL_SCORES = {name: _sum(cols) for name, cols in fe.SCORE_GROUPS.items()}
SQL_SCORES["informal_dependency"] = f"({si('uses_friends_family_savings')} + {si('uses_informal_lender')})"
_FLOOR = dbl(RATIO_FLOOR)
_MONTHS = f"GREATEST(business_age_years * 12 + business_age_months, {dbl(1.0)})"
SQL_DERIVED = {
    "net_profit_margin": f"(business_turnover - business_expenses) / GREATEST(business_turnover, {_FLOOR})",
    "expense_coverage": f"personal_income / GREATEST(business_expenses, {_FLOOR})",
    "financial_access_score": SQL_SCORES["financial_access_score"],
    "insurance_score": SQL_SCORES["insurance_score"],
    "perception_action_gap": f"{si('perception_insurance_important')} - {si('has_insurance')}",
    "business_age_total_months": _MONTHS,
    "turnover_per_month": f"LN(1 + GREATEST(business_turnover, {dbl(0.0)}) / {_MONTHS})",
    "cashflow_risk_score": SQL_SCORES["cashflow_risk_score"],
    "growth_mindset_score": SQL_SCORES["growth_mindset_score"],
    "informal_dependency": SQL_SCORES["informal_dependency"],
    "turnover_z_country": f"(business_turnover - ct_mean) / GREATEST(COALESCE(ct_std, {dbl(1.0)}), {_FLOOR})",
    "insurance_barrier_score": SQL_SCORES["insurance_barrier_score"],
    "digital_maturity_score": SQL_SCORES["digital_maturity_score"],
    "age_stability_interact": f"owner_age * {si('attitude_stable_business_environment')}",
    "formality_score": f"{si('keeps_financial_records')} * {si('compliance_income_tax')}",
    "fully_informal": f"CAST({si('keeps_financial_records')} = 0 AND {si('compliance_income_tax')} = 0 AS INTEGER)",
    "vulnerability_index": (f"{SQL_SCORES['cashflow_risk_score']} + {SQL_SCORES['insurance_barrier_score']} + "
                            f"{SQL_SCORES['informal_dependency']} - {SQL_SCORES['financial_access_score']}"),
    "risk_coverage_mismatch": f"{si('future_risk_theft_stock')} * (1 - {si('has_insurance')})",
}
STATS = ("stats", f"""SELECT country, AVG(business_turnover) AS ct_mean,
  COALESCE(STDDEV_SAMP(business_turnover), {dbl(1.0)}) AS ct_std, COUNT(*) AS n
  FROM clean WHERE country IS NOT NULL GROUP BY country""")
CLEAN_CTES = (S.survey_cte(), CLEAN)


def clean_survey_y(spark, d) -> DataFrame:
    """Read step: id, y and the cleaned columns (categoricals kept)."""
    return cl.read_scored_table(fx.survey(spark, d))


ROUNDED_DERIVED = ("turnover_per_month", "turnover_z_country")


def _cols_sql(names, raw: bool = False) -> str:
    """Output form rounds the log / aggregate based columns; ``raw`` keeps them."""
    return ", ".join(f"ROUND({SQL_DERIVED[n]}, 6) AS {n}" if n in ROUNDED_DERIVED and not raw
                     else f"{SQL_DERIVED[n]} AS {n}" for n in names)


# ---------------------------------------------------------------------------
# reading and cleaning
# ---------------------------------------------------------------------------
@register("scan_survey", oracle(*CLEAN_CTES, body="SELECT * FROM clean"))
def q_scan_survey(spark, d):
    return clean_survey_y(spark, d)


@register("class_distribution", oracle(S.survey_cte(), body=f"""
SELECT target, {Y_SQL} AS y, COUNT(*) AS n, ROUND(CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (), 6) AS share
FROM survey GROUP BY target"""))
def q_class_distribution(spark, d):
    from pyspark.sql.window import Window
    counts = cl.encode_target(fx.survey(spark, d)).groupBy("target", "y").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())          # one row per class
    return counts.withColumn("share", r6(F.col("n") / total))


@register("clean_flags", oracle(S.survey_cte(), body=f"SELECT id, {sql_clean_select(keep=())} FROM survey"))
def q_clean_flags(spark, d):
    return cl.clean_frame(fx.survey(spark, d).drop("target"), keep=(), passthrough=("id",))


@register("clean_survey", oracle(S.survey_cte(), body=f"SELECT id, {sql_clean_select()} FROM survey"))
def q_clean_survey(spark, d):
    return cl.preprocess_raw(fx.survey(spark, d).drop("target"), passthrough=("id",))


def _lenient_sql(c):
    return f"CASE WHEN regexp_matches({c}, '{NUMBER_PATTERN}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


@register("parse_numeric_lenient", oracle(S.survey_cte(), body=f"""
SELECT id, has_insurance AS has_insurance_raw, {_lenient_sql('has_insurance')} AS has_insurance_num,
       perception_insurance_important AS pii_raw, {_lenient_sql('perception_insurance_important')} AS pii_num
FROM survey"""))
def q_parse_numeric_lenient(spark, d):
    s = fx.survey(spark, d)
    return s.select("id", F.col("has_insurance").alias("has_insurance_raw"),
                    lenient_number("has_insurance").alias("has_insurance_num"),
                    F.col("perception_insurance_important").alias("pii_raw"),
                    lenient_number("perception_insurance_important").alias("pii_num"))


@register("safe_int", oracle(*CLEAN_CTES, body=f"""
SELECT id, {si('perception_insurance_important')} AS perception_insurance_important_int,
       {si('has_insurance')} AS has_insurance_int FROM clean"""))
def q_safe_int(spark, d):
    return cl.safe_int_columns(clean_survey_y(spark, d), ["perception_insurance_important", "has_insurance"])


_SCORE_NAMES = list(fe.SCORE_GROUPS) + ["informal_dependency"]


@register("rowwise_scores", oracle(*CLEAN_CTES, body=f"SELECT id, {_cols_sql(_SCORE_NAMES)} FROM clean"))
def q_rowwise_scores(spark, d):
    return clean_survey_y(spark, d).select("id", *[v.alias(k) for k, v in fe.score_columns().items()])


@register("clip_lower", oracle(*CLEAN_CTES, body=f"""
SELECT id, GREATEST(business_turnover, {dbl(0.0)}) AS turnover_clip0,
       GREATEST(business_turnover, {_FLOOR}) AS turnover_floor,
       GREATEST(business_expenses, {_FLOOR}) AS expenses_floor, {_MONTHS} AS business_age_total_months
FROM clean"""))
def q_clip_lower(spark, d):
    return clean_survey_y(spark, d).select("id", *[v.alias(k) for k, v in fe.clip_columns().items()])


@register("safe_ratios", oracle(*CLEAN_CTES, body=f"""
SELECT id, {_cols_sql(['net_profit_margin', 'expense_coverage'])} FROM clean"""))
def q_safe_ratios(spark, d):
    return clean_survey_y(spark, d).select("id", *[v.alias(k) for k, v in fe.ratio_columns().items()])


@register("turnover_per_month", oracle(*CLEAN_CTES, body=f"""
SELECT id, {_cols_sql(['business_age_total_months', 'turnover_per_month'])} FROM clean"""))
def q_turnover_per_month(spark, d):
    out = clean_survey_y(spark, d).select("id", *[v.alias(k) for k, v in fe.turnover_per_month().items()])
    return round_only(out, ["turnover_per_month"])


_INTERACT = ["perception_action_gap", "age_stability_interact", "formality_score", "risk_coverage_mismatch"]


@register("interactions", oracle(*CLEAN_CTES, body=f"SELECT id, {_cols_sql(_INTERACT)} FROM clean"))
def q_interactions(spark, d):
    return clean_survey_y(spark, d).select("id", *[v.alias(k) for k, v in fe.interaction_columns().items()])


@register("fully_informal", oracle(*CLEAN_CTES, body=f"SELECT id, {_cols_sql(['fully_informal'])} FROM clean"))
def q_fully_informal(spark, d):
    return clean_survey_y(spark, d).select("id", *[v.alias(k) for k, v in fe.fully_informal().items()])


@register("vulnerability_index", oracle(*CLEAN_CTES, body=f"SELECT id, {_cols_sql(['vulnerability_index'])} FROM clean"))
def q_vulnerability_index(spark, d):
    return clean_survey_y(spark, d).select("id", *[v.alias(k) for k, v in fe.vulnerability_index().items()])


@register("derived_features", oracle(*CLEAN_CTES, STATS, body=f"""
SELECT id, {_cols_sql(fe.DERIVED_COLUMNS)} FROM clean LEFT JOIN stats USING (country)"""))
def q_derived_features(spark, d):
    out = fe.derived_features(clean_survey_y(spark, d)).select("id", *fe.DERIVED_COLUMNS)
    return round_only(out, ["turnover_per_month", "turnover_z_country"])


@register("fill_categories", oracle(S.survey_cte(), body=f"""
SELECT id, COALESCE(country, '{MISSING_TOKEN}') AS country, COALESCE(owner_sex, '{MISSING_TOKEN}') AS owner_sex
FROM survey"""))
def q_fill_categories(spark, d):
    return cl.fill_categories(fx.survey(spark, d).select("id", *CAT_FEATURES))


@register("null_report", oracle(S.survey_cte(), body=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null FROM survey"
    for c in ["id", "target"] + ORDER)))
def q_null_report(spark, d):
    return cl.null_counts(fx.survey(spark, d))


@register("encode_target", oracle(S.survey_cte(), body=f"SELECT id, target, {Y_SQL} AS y FROM survey"))
def q_encode_target(spark, d):
    return cl.encode_target(fx.survey(spark, d)).select("id", "target", "y")


_ALIGN_SRC = ["id", *fe.DERIVED_COLUMNS]


@register("align_columns", oracle(*CLEAN_CTES, body="SELECT " + ", ".join(
    ["id"] + [f"{SQL_SCORES[c]} AS {c}" if c in SQL_SCORES else f"{dbl(0.0)} AS {c}"
              for c in fe.DERIVED_COLUMNS]) + " FROM clean"))
def q_align_columns(spark, d):
    # target frame: the row-wise scores plus a stray column; aligned to the
    # derived-feature frame's columns (missing -> 0.0, extra dropped)
    target = clean_survey_y(spark, d).select(
        "id", "has_insurance", *[v.alias(k) for k, v in fe.score_columns().items()])
    return cl.align_columns(_ALIGN_SRC, target)


# ---------------------------------------------------------------------------
# grouped statistics (A1), z-score join (J1), per-fold statistics (M2)
# ---------------------------------------------------------------------------
@register("country_stats", oracle(*CLEAN_CTES, STATS, body="""
SELECT country, ROUND(ct_mean, 6) AS ct_mean, ROUND(ct_std, 6) AS ct_std, n FROM stats"""))
def q_country_stats(spark, d):
    return round_only(fe.country_stats(clean_survey_y(spark, d)), ["ct_mean", "ct_std"])


@register("zscore_by_country", oracle(*CLEAN_CTES, STATS, body=f"""
SELECT id, country, {_cols_sql(['turnover_z_country'])}
FROM clean LEFT JOIN stats USING (country)"""))
def q_zscore_by_country(spark, d):
    c = clean_survey_y(spark, d)
    out = fe.with_country_z(c.select("id", "country", "business_turnover"), fe.country_stats(c))
    return round_only(out.select("id", "country", "turnover_z_country"), ["turnover_z_country"])


@register("fold_country_z", oracle(*CLEAN_CTES, ("fc", fx.folds_sql("SELECT * FROM clean")), (
    "ex", "SELECT CAST(k.range AS INTEGER) AS k, fc.*, CASE WHEN fold = k.range THEN 'val' ELSE 'train' END AS role "
          "FROM fc CROSS JOIN range(0, 5) k"), (
    "kst", f"""SELECT k, country, AVG(business_turnover) AS ct_mean,
      COALESCE(STDDEV_SAMP(business_turnover), {dbl(1.0)}) AS ct_std
      FROM ex WHERE role = 'train' AND country IS NOT NULL GROUP BY k, country"""), body=f"""
SELECT ex.k, id, role, {_cols_sql(['turnover_z_country'])}
FROM ex LEFT JOIN kst ON ex.k = kst.k AND ex.country = kst.country"""))
def q_fold_country_z(spark, d):
    c = fo.assign_folds(clean_survey_y(spark, d))
    return round_only(fe.fold_country_z(c), ["turnover_z_country"])


DERIVED_RAW = ("derived", f"SELECT clean.*, {_cols_sql(fe.DERIVED_COLUMNS, raw=True)} "
                          f"FROM clean LEFT JOIN stats USING (country)")
