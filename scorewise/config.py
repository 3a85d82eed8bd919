"""Run configuration.

Every number below is a fixed value of the scoring method (labels, guardrail
limits, sweep grids, seeds).  They are kept together here so that operators
take them as parameters and tests can override them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must equal the original method's constants for equal results)
# ---------------------------------------------------------------------------
SEED = 42
N_SPLITS = 5
CLASS_LABELS = ("Low", "Medium", "High")          # label text -> 0, 1, 2
N_CLASSES = 3
CAT_FEATURES = ("country", "owner_sex")
CLUSTER_K_VALUES = (8, 12)
# columns the clusters are built on
CLUSTER_FEATURES = ("net_profit_margin", "expense_coverage", "turnover_per_month", "turnover_z_country",
                    "business_turnover", "personal_income", "owner_age", "business_age_total_months",
                    "financial_access_score", "insurance_score", "cashflow_risk_score",
                    "growth_mindset_score", "vulnerability_index", "digital_maturity_score",
                    "age_stability_interact", "insurance_barrier_score")
CLUSTER_TE_FOLDS = 3
TE_SMOOTH_ALPHA = 10
INNER_FOLD_SEED_OFFSET = 7                         # inner folds use seed + 7
MEDIUM_F1_DROP_MAX = 0.015
MEDIUM_REC_DROP_MAX = 0.020
PRED_HIGH_MULT_MAX = 1.25
WF1_BAND = 0.001
ALPHA_WF1_DELTA = 0.001
ALPHA_ACCEPT_HREC = 0.68
GATE_FPR_MAX = 0.05
GATE_TPR_MIN = 0.30
GATE_HIGH_FLOOR = 0.5                              # gated rows get P(High) >= 0.5
EARLY_STOP_PATIENCE = 20
HREC_FLAT_RANGE = 0.005
SEED_STABILITY_SEEDS = (42, 123, 2025)
SEED_STABILITY_STD_WARN = 0.005
ALPHAS = (1.00, 1.03, 1.05, 1.08, 1.10, 1.12, 1.15)
# probability gate grid: t = (20 + 5*i) / 100 for i in 0..10 (0.20 .. 0.70)
GATE_GRID_START_CENTS = 20
GATE_GRID_STEP_CENTS = 5
GATE_GRID_SIZE = 11
# older argmax gate: t = (25 + 5*i) / 100 for i in 0..5 (0.25 .. 0.50)
ARGMAX_GATE_START_CENTS = 25
ARGMAX_GATE_SIZE = 6
FIXED_CLASS_WEIGHTS = (1.0, 2.0, 12.0)
RECOVERABLE_GATE_MIN = 80                          # route: gated rescue first
RECOVERABLE_ALPHA_MIN = 40                         # route: alpha sweep first
CALIBRATION_MAX_BINS = 10
CALIBRATION_MIN_BINS = 3
CALIBRATION_HIGH_PER_BIN = 30
CALIBRATION_BIAS_BAND = 0.02
CALIBRATION_BASE_THRESHOLD = 0.35
CALIBRATION_MAX_THRESHOLD = 0.50
CALIBRATION_MIN_THRESHOLD = 0.20
BEST_ITERATION_ALERT = 100
DOMINANT_WEIGHT_NOTE = 0.70
ENTROPY_EPS = 1e-12
RATIO_FLOOR = 1e-9
MISSING_TOKEN = "__MISSING__"
# Text values the cleaner maps to numbers (after trim + lower-case).
FLAG_TEXT_VALUES = {
    "yes": 1.0, "no": 0.0,
    "have now": 1.0, "do not have": 0.0,
    "true": 1.0, "false": 0.0,
    "male": 1.0, "female": 0.0,
    "1": 1.0, "0": 0.0,
    "nan": 0.0, "none": 0.0, "": 0.0,
}
# Weights published for the final blend (raw, before normalising); used as
# the default blend of the score table.
PUBLISHED_RAW_WEIGHTS = (0.6309220715923294, 0.8439801017111948, 0.11197611699814441)
MODEL_NAMES = ("cb", "lg", "xg")


@dataclass(frozen=True)
class Guardrails:
    medium_f1_drop_max: float = MEDIUM_F1_DROP_MAX
    medium_rec_drop_max: float = MEDIUM_REC_DROP_MAX
    pred_high_mult_max: float = PRED_HIGH_MULT_MAX


@dataclass(frozen=True)
class RunConfig:
    seed: int = SEED
    n_splits: int = N_SPLITS
    k_values: tuple = CLUSTER_K_VALUES
    te_folds: int = CLUSTER_TE_FOLDS
    te_alpha: float = TE_SMOOTH_ALPHA
    alphas: tuple = ALPHAS
    guardrails: Guardrails = field(default_factory=Guardrails)
    wf1_band: float = WF1_BAND
    kmeans_starts: int = 15
    kmeans_max_iter: int = 300
    trials: tuple = (("lg", 100), ("xg", 100), ("cb", 50))     # parameter trials per learner
    # fold numbering: number of md5 hex digits used to split a class into
    # independently ranked buckets (16**digits buckets per class)
    fold_bucket_digits: int = 4          # 65,536 rank buckets per class; offsets <= 196,608 rows
    # rows of one bucket of the fold cache
    rows_per_bucket: int = 500_000
    # largest row count of a table we broadcast after measuring it
    broadcast_max_rows: int = 1_000_000
    # and its largest size in bytes
    broadcast_max_bytes: int = 64 * 1024 * 1024
