"""Derived features of the cleaned survey table (one projection + one join).

The only fitted part is the per-country turnover mean and sample std; it is a
grouped aggregate (partial aggregation absorbs a hot country) joined back to
the rows.  The statistics table has one row per distinct country, so its size
is checked before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewise.config import N_SPLITS, RATIO_FLOOR
from scorewise.functions.columns import dlit, safe_int, sum_cols
from scorewise.operators.folds import explode_folds
from scorewise.operators.joins import checked_broadcast
from scorewise.session import cut_lineage

# Fixed column groups of the survey schema.
NUMERIC_COLUMNS = ("business_turnover", "business_expenses", "personal_income",
                   "business_age_years", "business_age_months", "owner_age")
ACCESS_COLS = ("has_mobile_money", "has_credit_card", "has_debit_card",
               "has_loan_account", "has_internet_banking")
INSURANCE_COLS = ("motor_vehicle_insurance", "medical_insurance", "funeral_insurance", "has_insurance")
RISK_COLS = ("current_problem_cash_flow", "problem_sourcing_money", "uses_informal_lender")
GROWTH_COLS = ("attitude_more_successful_next_year", "motivation_make_more_money",
               "attitude_satisfied_with_achievement")
BARRIER_COLS = ("perception_cannot_afford_insurance", "perception_insurance_doesnt_cover_losses",
                "perception_insurance_companies_dont_insure_businesses_like_yours")
DIGITAL_COLS = ("has_cellphone", "has_mobile_money", "has_internet_banking", "offers_credit_to_customers")
FLAG_COLUMNS = (ACCESS_COLS + INSURANCE_COLS + RISK_COLS + GROWTH_COLS + BARRIER_COLS
                + ("has_cellphone", "offers_credit_to_customers", "perception_insurance_important",
                   "uses_friends_family_savings", "attitude_stable_business_environment",
                   "keeps_financial_records", "compliance_income_tax", "future_risk_theft_stock"))
SCORE_GROUPS = {"financial_access_score": ACCESS_COLS, "insurance_score": INSURANCE_COLS,
                "cashflow_risk_score": RISK_COLS, "growth_mindset_score": GROWTH_COLS,
                "insurance_barrier_score": BARRIER_COLS, "digital_maturity_score": DIGITAL_COLS}
DERIVED_COLUMNS = ("net_profit_margin", "expense_coverage", "financial_access_score", "insurance_score",
                   "perception_action_gap", "business_age_total_months", "turnover_per_month",
                   "cashflow_risk_score", "growth_mindset_score", "informal_dependency",
                   "turnover_z_country", "insurance_barrier_score", "digital_maturity_score",
                   "age_stability_interact", "formality_score", "fully_informal",
                   "vulnerability_index", "risk_coverage_mismatch")


def _si(c):
    return safe_int(c)


def score_columns() -> dict:
    out = {name: sum_cols([_si(c) for c in cols]) for name, cols in SCORE_GROUPS.items()}
    out["informal_dependency"] = _si("uses_friends_family_savings") + _si("uses_informal_lender")
    return out


def clip_columns() -> dict:
    t = F.col("business_turnover")
    return {"turnover_clip0": F.greatest(t, dlit(0.0)),
            "turnover_floor": F.greatest(t, dlit(RATIO_FLOOR)),
            "expenses_floor": F.greatest(F.col("business_expenses"), dlit(RATIO_FLOOR)),
            "business_age_total_months": F.greatest(F.col("business_age_years") * 12
                                                    + F.col("business_age_months"), dlit(1.0))}


def ratio_columns() -> dict:
    t, e = F.col("business_turnover"), F.col("business_expenses")
    return {"net_profit_margin": (t - e) / F.greatest(t, dlit(RATIO_FLOOR)),
            "expense_coverage": F.col("personal_income") / F.greatest(e, dlit(RATIO_FLOOR))}


def turnover_per_month() -> dict:
    months = clip_columns()["business_age_total_months"]
    return {"business_age_total_months": months,
            "turnover_per_month": F.log1p(F.greatest(F.col("business_turnover"), dlit(0.0)) / months)}


def interaction_columns() -> dict:
    ins = _si("has_insurance")
    return {"perception_action_gap": _si("perception_insurance_important") - ins,
            "age_stability_interact": F.col("owner_age") * _si("attitude_stable_business_environment"),
            "formality_score": _si("keeps_financial_records") * _si("compliance_income_tax"),
            "risk_coverage_mismatch": _si("future_risk_theft_stock") * (1 - ins)}


def fully_informal() -> dict:
    return {"fully_informal": ((_si("keeps_financial_records") == 0)
                               & (_si("compliance_income_tax") == 0)).cast("int")}


def vulnerability_index() -> dict:
    s = score_columns()
    return {"vulnerability_index": (s["cashflow_risk_score"] + s["insurance_barrier_score"]
                                    + s["informal_dependency"] - s["financial_access_score"])}


# ---------------------------------------------------------------------------
# grouped statistics (A1) and the z-score join
# ---------------------------------------------------------------------------
def country_stats(df: DataFrame, keys=("country",), value: str = "business_turnover") -> DataFrame:
    """Mean and sample std per group; single-row groups get std 1.0; NULL key dropped."""
    return (df.filter(F.col(keys[-1]).isNotNull()).groupBy(*keys)
            .agg(F.avg(value).alias("ct_mean"),
                 F.coalesce(F.stddev_samp(value), dlit(1.0)).alias("ct_std"),
                 F.count(F.lit(1)).alias("n")))


def zscore_column(value: str = "business_turnover"):
    return ((F.col(value) - F.col("ct_mean"))
            / F.greatest(F.coalesce(F.col("ct_std"), dlit(1.0)), dlit(RATIO_FLOOR)))


def with_country_z(df: DataFrame, stats: DataFrame, keys=("country",)) -> DataFrame:
    """Left join of the statistics; unseen or NULL groups give a NULL z-score."""
    small = checked_broadcast(stats.select(*keys, "ct_mean", "ct_std"))
    return (df.join(small, list(keys), "left")
            .withColumn("turnover_z_country", zscore_column())
            .drop("ct_mean", "ct_std"))


def row_features(clean: DataFrame) -> DataFrame:
    """The 17 derived columns that need only their own row."""
    cols = {}
    cols.update(ratio_columns())
    cols.update(score_columns())
    cols.update(turnover_per_month())
    cols.update(interaction_columns())
    cols.update(fully_informal())
    cols.update(vulnerability_index())
    return clean.withColumns(cols)


def derived_features(clean: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """All 18 derived columns; ``stats`` fitted on ``clean`` unless given (train part)."""
    stats = stats if stats is not None else country_stats(clean)
    return with_country_z(row_features(clean), stats)


def fold_country_z(clean_with_fold: DataFrame, n_splits: int = N_SPLITS) -> DataFrame:
    """Per outer fold k: statistics fitted on the train part only, applied to
    train and validation rows.  One grouped aggregate over the exploded
    (k, row) table fits all k folds at once."""
    # the fold column usually comes from a rank (a shuffle); read it once from a
    # narrow checkpoint so the statistics and the z-scores share it
    narrow = cut_lineage(clean_with_fold.select("id", "fold", "country", "business_turnover"))
    ex = explode_folds(narrow, n_splits)
    stats = country_stats(ex.filter(F.col("role") == "train"), keys=("k", "country"))
    small = checked_broadcast(stats.select("k", "country", "ct_mean", "ct_std"))
    return (ex.join(small, ["k", "country"], "left")
            .select("k", "id", "role", zscore_column().alias("turnover_z_country")))
