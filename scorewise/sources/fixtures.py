"""Input fixtures shared by the Spark queries and the DuckDB oracle.

The same SQL text builds each fixture in both engines, so input differences
cannot arise.  Spark receives the source tables as DataFrame arguments of
``spark.sql`` (placeholders ``{customer}``, ``{orders}``); the oracle text uses
the bare view names.  Generators differ by dialect only in name
(``explode``/``sequence`` in Spark, ``unnest``/``range`` in DuckDB).

* ``survey``  one row per customer, raw survey-style columns (dirty text,
  NULLs injected by modulus, one single-row country).
* ``oof``     one row per order: true class and three models' class scores.
* ``oof_seeds``   the ``oof`` scores re-drawn for each stability seed.
* ``fold_scores`` per-order test scores of each outer-fold model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorewise.config import SEED, SEED_STABILITY_SEEDS, N_SPLITS
from scorewise.sources.tables import load

SURVEY_SQL = """
SELECT c_custkey AS id,
  CASE WHEN c_acctbal < 6060 THEN 'Low' WHEN c_acctbal < 9485 THEN 'Medium' ELSE 'High' END AS target,
  CASE WHEN c_custkey % 53 = 0 THEN NULL WHEN c_custkey = 1 THEN 'SOLO' ELSE CONCAT('N', CAST(c_nationkey AS VARCHAR(10))) END AS country,
  CASE WHEN c_custkey % 61 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS owner_sex,
  CASE WHEN c_custkey % 41 = 0 THEN NULL WHEN c_custkey % 59 = 0 THEN CAST(0 AS DOUBLE) ELSE turnover END AS business_turnover,
  CASE WHEN c_custkey % 43 = 0 THEN NULL ELSE expenses END AS business_expenses,
  CASE WHEN c_custkey % 47 = 0 THEN NULL ELSE c_acctbal * 12 END AS personal_income,
  CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE CAST(c_custkey % 21 AS DOUBLE) END AS business_age_years,
  CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE CAST(c_custkey % 12 AS DOUBLE) END AS business_age_months,
  CAST(18 + (c_custkey * 7) % 60 AS DOUBLE) AS owner_age,
  CASE WHEN (c_custkey * 3) % 5 < 3 THEN 'Yes' ELSE 'No' END AS has_mobile_money,
  CASE WHEN (c_custkey * 5) % 7 < 2 THEN 'Have now' ELSE 'Do not have' END AS has_credit_card,
  CASE WHEN (c_custkey * 5) % 9 < 4 THEN 'have now ' ELSE 'Never had' END AS has_debit_card,
  CASE WHEN (c_custkey * 7) % 11 < 3 THEN 'true' ELSE 'FALSE' END AS has_loan_account,
  CASE WHEN (c_custkey * 7) % 13 < 5 THEN '1' ELSE '0' END AS has_internet_banking,
  CASE WHEN (c_custkey * 3) % 11 < 2 THEN 'Yes' ELSE 'no' END AS motor_vehicle_insurance,
  CASE WHEN (c_custkey * 3) % 13 < 4 THEN 'Have now' WHEN c_custkey % 5 = 0 THEN NULL ELSE 'Used to have' END AS medical_insurance,
  CASE WHEN (c_custkey * 3) % 17 < 3 THEN 'yes' ELSE 'None' END AS funeral_insurance,
  CASE c_custkey % 7 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'have now' WHEN 2 THEN 'no' WHEN 3 THEN '1' WHEN 4 THEN 'Don''t know' WHEN 5 THEN NULL ELSE '' END AS has_insurance,
  CASE WHEN (c_custkey * 5) % 11 < 5 THEN 'Yes' ELSE 'No' END AS current_problem_cash_flow,
  CASE WHEN (c_custkey * 5) % 13 < 6 THEN 'Yes' ELSE 'No' END AS problem_sourcing_money,
  CASE WHEN (c_custkey * 5) % 17 < 4 THEN 'Yes' ELSE 'No' END AS uses_informal_lender,
  CASE WHEN (c_custkey * 7) % 17 < 12 THEN 'Yes' ELSE 'No' END AS attitude_more_successful_next_year,
  CASE WHEN (c_custkey * 7) % 19 < 14 THEN 'Yes' ELSE 'No' END AS motivation_make_more_money,
  CASE WHEN (c_custkey * 7) % 23 < 9 THEN 'Yes' ELSE 'nan' END AS attitude_satisfied_with_achievement,
  CASE WHEN (c_custkey * 11) % 13 < 6 THEN 'Yes' ELSE 'No' END AS perception_cannot_afford_insurance,
  CASE WHEN (c_custkey * 11) % 17 < 6 THEN 'Yes' ELSE 'No' END AS perception_insurance_doesnt_cover_losses,
  CASE WHEN (c_custkey * 11) % 19 < 6 THEN 'Yes' ELSE 'No' END AS perception_insurance_companies_dont_insure_businesses_like_yours,
  CASE WHEN (c_custkey * 11) % 23 < 20 THEN 'Yes' ELSE 'No' END AS has_cellphone,
  CASE WHEN (c_custkey * 13) % 17 < 7 THEN 'Yes' ELSE 'No' END AS offers_credit_to_customers,
  CASE WHEN (c_custkey * 13) % 19 < 11 THEN 'Yes' ELSE '2.7' END AS perception_insurance_important,
  CASE WHEN (c_custkey * 13) % 23 < 8 THEN 'Yes' ELSE 'No' END AS uses_friends_family_savings,
  CASE WHEN (c_custkey * 13) % 29 < 15 THEN 'Yes' ELSE 'No' END AS attitude_stable_business_environment,
  CASE WHEN (c_custkey * 17) % 19 < 9 THEN 'Yes' ELSE 'No' END AS keeps_financial_records,
  CASE WHEN (c_custkey * 17) % 23 < 7 THEN 'Yes' ELSE 'No' END AS compliance_income_tax,
  CASE WHEN (c_custkey * 17) % 29 < 13 THEN 'Yes' ELSE 'No' END AS future_risk_theft_stock
FROM {customer} LEFT JOIN (
  SELECT o_custkey,
    CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS turnover,
    CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END) AS DOUBLE) AS expenses
  FROM {orders} GROUP BY o_custkey) o ON o_custkey = c_custkey
"""

_SCORE_COLUMNS = """
  a0/(a0+a1+a2) AS cb0, a1/(a0+a1+a2) AS cb1, a2/(a0+a1+a2) AS cb2,
  b0/(b0+b1+b2) AS lg0, b1/(b0+b1+b2) AS lg1, b2/(b0+b1+b2) AS lg2,
  d0/(d0+d1+d2) AS xg0, d1/(d0+d1+d2) AS xg1, d2/(d0+d1+d2) AS xg2"""

_LABEL = ("CASE WHEN (o_orderkey*7919) % 1000 < 653 THEN 0 "
          "WHEN (o_orderkey*7919) % 1000 < 951 THEN 1 ELSE 2 END")

OOF_SQL = f"""
SELECT id, y,{_SCORE_COLUMNS}
FROM (SELECT id, y,
    CAST(1 + (id*31) % 97 + CASE WHEN y = 0 THEN 40 ELSE 0 END AS DOUBLE) AS a0,
    CAST(1 + (id*37) % 89 + CASE WHEN y = 1 THEN 40 ELSE 0 END AS DOUBLE) AS a1,
    CAST(1 + (id*41) % 83 + CASE WHEN y = 2 THEN 42 ELSE 0 END AS DOUBLE) AS a2,
    CAST(1 + (id*43) % 97 + CASE WHEN y = 0 THEN 62 ELSE 0 END AS DOUBLE) AS b0,
    CAST(1 + (id*47) % 79 + CASE WHEN y = 1 THEN 46 ELSE 0 END AS DOUBLE) AS b1,
    CAST(1 + (id*53) % 61 + CASE WHEN y = 2 THEN 34 ELSE 0 END AS DOUBLE) AS b2,
    CAST(1 + (id*59) % 97 + CASE WHEN y = 0 THEN 55 ELSE 0 END AS DOUBLE) AS d0,
    CAST(1 + (id*61) % 79 + CASE WHEN y = 1 THEN 42 ELSE 0 END AS DOUBLE) AS d1,
    CAST(1 + (id*67) % 61 + CASE WHEN y = 2 THEN 32 ELSE 0 END AS DOUBLE) AS d2
  FROM (SELECT o_orderkey AS id,
      {_LABEL} AS y
    FROM {{orders}}) q) r
"""

# Same scores re-drawn per stability seed: the seed shifts every residue.
OOF_SEEDS_SQL = f"""
SELECT seed, id, y,{_SCORE_COLUMNS}
FROM (SELECT seed, id, y,
    CAST(1 + (id*31 + seed) % 97 + CASE WHEN y = 0 THEN 40 ELSE 0 END AS DOUBLE) AS a0,
    CAST(1 + (id*37 + seed) % 89 + CASE WHEN y = 1 THEN 40 ELSE 0 END AS DOUBLE) AS a1,
    CAST(1 + (id*41 + seed) % 83 + CASE WHEN y = 2 THEN 42 ELSE 0 END AS DOUBLE) AS a2,
    CAST(1 + (id*43 + seed) % 97 + CASE WHEN y = 0 THEN 62 ELSE 0 END AS DOUBLE) AS b0,
    CAST(1 + (id*47 + seed) % 79 + CASE WHEN y = 1 THEN 46 ELSE 0 END AS DOUBLE) AS b1,
    CAST(1 + (id*53 + seed) % 61 + CASE WHEN y = 2 THEN 34 ELSE 0 END AS DOUBLE) AS b2,
    CAST(1 + (id*59 + seed) % 97 + CASE WHEN y = 0 THEN 55 ELSE 0 END AS DOUBLE) AS d0,
    CAST(1 + (id*61 + seed) % 79 + CASE WHEN y = 1 THEN 42 ELSE 0 END AS DOUBLE) AS d1,
    CAST(1 + (id*67 + seed) % 61 + CASE WHEN y = 2 THEN 32 ELSE 0 END AS DOUBLE) AS d2
  FROM (SELECT o_orderkey AS id, {{seed_gen}} AS seed,
      {_LABEL} AS y
    FROM {{orders}}) q) r
"""

# Test-set scores of the k-th outer-fold model (one learner); the k shifts residues.
FOLD_SCORES_SQL = """
SELECT id, k, a0/(a0+a1+a2) AS p0, a1/(a0+a1+a2) AS p1, a2/(a0+a1+a2) AS p2
FROM (SELECT id, k,
    CAST(1 + (id*31 + 7*k) % 97 AS DOUBLE) AS a0,
    CAST(1 + (id*37 + 11*k) % 89 AS DOUBLE) AS a1,
    CAST(1 + (id*41 + 13*k) % 83 AS DOUBLE) AS a2
  FROM (SELECT o_orderkey AS id, {k_gen} AS k FROM {orders}) q) r
"""

_SEEDS_LIST = ", ".join(str(s) for s in SEED_STABILITY_SEEDS)
_SPARK_GEN = {"seed_gen": f"explode(array({_SEEDS_LIST}))",
              "k_gen": f"explode(sequence(0, {N_SPLITS - 1}))"}
_DUCK_GEN = {"seed_gen": f"unnest([{_SEEDS_LIST}])",
             "k_gen": f"unnest(range(0, {N_SPLITS}))"}


def folds_sql(base_sql: str, seed: int = SEED, k: int = N_SPLITS, id_col: str = "id",
              y_col: str = "y") -> str:
    """Oracle text of the frozen stratified fold numbering (md5 order)."""
    return (f"SELECT b.*, CAST((ROW_NUMBER() OVER (PARTITION BY {y_col} ORDER BY "
            f"md5(CONCAT(CAST({id_col} AS VARCHAR(20)), '-{seed}')), {id_col}) - 1) % {k} AS INTEGER) AS fold "
            f"FROM ({base_sql}) b")


def duck(text: str) -> str:
    """Fixture text for DuckDB (bare view names)."""
    return text.format(customer="customer", orders="orders", **_DUCK_GEN)


def _spark_fixture(spark: SparkSession, sf_dir: str, text: str, tables: tuple) -> DataFrame:
    kwargs = {t: load(spark, sf_dir, t) for t in tables}
    return spark.sql(text.replace("{seed_gen}", _SPARK_GEN["seed_gen"])
                         .replace("{k_gen}", _SPARK_GEN["k_gen"]), **kwargs)


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark_fixture(spark, sf_dir, SURVEY_SQL, ("customer", "orders"))


def oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark_fixture(spark, sf_dir, OOF_SQL, ("orders",))


def oof_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark_fixture(spark, sf_dir, OOF_SEEDS_SQL, ("orders",))


def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark_fixture(spark, sf_dir, FOLD_SCORES_SQL, ("orders",))


SURVEY_DUCK = duck(SURVEY_SQL)
OOF_DUCK = duck(OOF_SQL)
OOF_SEEDS_DUCK = duck(OOF_SEEDS_SQL)
FOLD_SCORES_DUCK = duck(FOLD_SCORES_SQL)
