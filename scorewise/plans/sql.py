"""Building blocks of the DuckDB oracle text.

The oracle is written independently of the Spark plans, as plain SQL over the
same fixture text; these helpers only keep the repeated pieces (argmax,
confusion counts, metric formulas) spelled identically across queries.
"""

from __future__ import annotations

from scorewise.config import MODEL_NAMES, N_CLASSES
from scorewise.sources.fixtures import OOF_DUCK, SURVEY_DUCK, folds_sql

CLASSES = tuple(range(N_CLASSES))


def dbl(x: float) -> str:
    """Exact double literal in both engines."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def argmax(p0="p0", p1="p1", p2="p2") -> str:
    return (f"(CASE WHEN {p0} >= {p1} AND {p0} >= {p2} THEN 0 "
            f"WHEN {p1} >= {p2} THEN 1 ELSE 2 END)")


def with_ctes(*ctes: tuple, body: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in ctes) + "\n" + body


def oof_cte():
    return ("oof", OOF_DUCK)


def survey_cte():
    return ("survey", SURVEY_DUCK)


def long_select(src="oof", models=MODEL_NAMES, extra="") -> str:
    extra = f", {extra}" if extra else ""
    return " UNION ALL ".join(
        f"SELECT id, y{extra}, '{m}' AS model, {m}0 AS p0, {m}1 AS p1, {m}2 AS p2 FROM {src}"
        for m in models)


def eq_select(src="oof", extra="", name="eq") -> str:
    extra = f", {extra}" if extra else ""
    return (f"SELECT id, y{extra}, '{name}' AS model, "
            + ", ".join(f"(cb{c} + lg{c} + xg{c}) / 3 AS p{c}" for c in CLASSES)
            + f" FROM {src}")


def blend_select(weights, src="oof", extra="", name="blend") -> str:
    extra = f", {extra}" if extra else ""
    w = [dbl(x) for x in weights]
    return (f"SELECT id, y{extra}, '{name}' AS model, "
            + ", ".join(f"{w[0]} * cb{c} + {w[1]} * lg{c} + {w[2]} * xg{c} AS p{c}" for c in CLASSES)
            + f" FROM {src}")


def count_cols(y="y", pred="pred", weight: str | None = None, prefix: str = "",
               with_n: bool = True) -> list:
    w = weight or "1"
    cols = [f"CAST(SUM({w}) AS BIGINT) AS {prefix}n"] if with_n else []
    for c in CLASSES:
        cols += [f"CAST(SUM(CASE WHEN {y} = {c} THEN {w} ELSE 0 END) AS BIGINT) AS {prefix}s{c}",
                 f"CAST(SUM(CASE WHEN {pred} = {c} THEN {w} ELSE 0 END) AS BIGINT) AS {prefix}q{c}",
                 f"CAST(SUM(CASE WHEN {y} = {c} AND {pred} = {c} THEN {w} ELSE 0 END) AS BIGINT) AS {prefix}t{c}"]
    return cols


def counts(src: str, keys=(), y="y", pred="pred", weight: str | None = None,
           base: str | None = None, extra=()) -> str:
    """Confusion counts per key; with ``base`` also the baseline's (b_ prefix)."""
    cols = count_cols(y, pred, weight)
    if base:
        cols += count_cols(y, base, weight, prefix="b_", with_n=False)
    cols += list(extra)
    k = ", ".join(keys)
    sel = (k + ", " if k else "") + ", ".join(cols)
    group = f" GROUP BY {k}" if k else ""
    return f"SELECT {sel} FROM ({src}) _src{group}"


def _ratio(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / ({den}) ELSE CAST(0 AS DOUBLE) END)"


def metrics(counts_sql: str, prefix: str = "") -> str:
    """Adds prec_c, rec_c, f1_c, wf1, macro_f1, accuracy (with ``prefix``)."""
    p = prefix
    per_class = []
    for c in CLASSES:
        per_class += [f"{_ratio(f'{p}t{c}', f'{p}q{c}')} AS {p}prec{c}",
                      f"{_ratio(f'{p}t{c}', f'{p}s{c}')} AS {p}rec{c}",
                      f"{_ratio(f'2 * {p}t{c}', f'{p}s{c} + {p}q{c}')} AS {p}f1_{c}"]
    inner = f"SELECT *, {', '.join(per_class)} FROM ({counts_sql}) _c"
    present = " + ".join(f"(CASE WHEN {p}s{c} + {p}q{c} > 0 THEN 1 ELSE 0 END)" for c in CLASSES)
    return (f"SELECT *, {_ratio(f'{p}f1_0 * {p}s0 + {p}f1_1 * {p}s1 + {p}f1_2 * {p}s2', 'n')} AS {p}wf1, "
            f"{_ratio(f'{p}f1_0 + {p}f1_1 + {p}f1_2', '(' + present + ')')} AS {p}macro_f1, "
            f"{_ratio(f'{p}t0 + {p}t1 + {p}t2', 'n')} AS {p}accuracy FROM ({inner}) _m")


def guarded(counts_sql: str, mult=1.25, f1_drop=0.015, rec_drop=0.020) -> str:
    """Candidate + baseline metrics and the guardrail verdict."""
    m = metrics(metrics(counts_sql), prefix="b_")
    ceil = f"CAST(FLOOR(b_q2 * {dbl(mult)}) AS BIGINT)"
    c1 = f"f1_1 < b_f1_1 - {dbl(f1_drop)}"
    c2 = f"rec1 < b_rec1 - {dbl(rec_drop)}"
    c3 = f"q2 > {ceil}"
    return (f"SELECT *, {ceil} AS phc_ceiling, "
            f"CASE WHEN {c1} OR {c2} OR {c3} THEN 'FAIL' ELSE 'PASS' END AS verdict, "
            f"concat_ws('; ', CASE WHEN {c1} THEN 'medium_f1_drop' END, "
            f"CASE WHEN {c2} THEN 'medium_recall_drop' END, "
            f"CASE WHEN {c3} THEN 'pred_high_ceiling' END) AS reasons FROM ({m}) _g")


REPORT = "~wf1, ~rec2 AS hrec, ~prec2 AS hpre, ~f1_1 AS med_f1, ~rec1 AS med_rec, q2 AS phc"


def bundle(src_with_pred: str, keys=(), weight: str | None = None) -> str:
    """Same columns as ``metrics.metric_bundle``."""
    k = ", ".join(keys)
    sel = (k + ", " if k else "")
    return (f"SELECT {sel}wf1, rec2 AS hrec, prec2 AS hpre, f1_2 AS hf1, q2 AS phc, "
            f"f1_1 AS med_f1, rec1 AS med_rec, prec1 AS med_pre, macro_f1, n "
            f"FROM ({metrics(counts(src_with_pred, keys, weight=weight))}) _b")


def with_pred(src: str, p=("p0", "p1", "p2")) -> str:
    return f"SELECT *, {argmax(*p)} AS pred FROM ({src}) _p"


def folds_cte(base="SELECT id, y FROM survey") -> tuple:
    return ("folds", folds_sql(base))
