"""Cleaning of survey-style tables (one ``select``, no UDF).

Numeric columns: NULL and NaN -> 0.0.  Text columns: strip white space of any
kind + lower-case, look the value
up in the fixed yes/no table, else parse it as a plain number, else 0.0.  NULL
text becomes 0.0 as well (the lookup treats the text ``nan``/``none`` as 0).
Categorical columns named in ``keep`` pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from scorewise.config import CAT_FEATURES, CLASS_LABELS, FLAG_TEXT_VALUES, MISSING_TOKEN
from scorewise.functions.columns import dlit, safe_int, strip_space, stripped_number


def text_key(c: str | Column) -> Column:
    """Stripped, lower-case text: what the lookup and the number parse both read."""
    return F.lower(strip_space(c))


def value_of_key(key: Column) -> Column:
    by_value: dict[float, list[str]] = {}
    for text, value in FLAG_TEXT_VALUES.items():
        by_value.setdefault(value, []).append(text)
    expr = None
    for value, texts in by_value.items():                 # disjoint text sets
        cond = key.isin(*texts)
        expr = F.when(cond, dlit(value)) if expr is None else expr.when(cond, dlit(value))
    return expr.otherwise(F.coalesce(stripped_number(key), dlit(0.0)))


def clean_frame(df: DataFrame, keep=(), passthrough=("id", "y")) -> DataFrame:
    """Every column not in ``keep``/``passthrough`` becomes a non-null double.  Text
    is stripped in a first projection, so once per value."""
    asis = {f.name for f in df.schema.fields if f.name in keep or f.name in passthrough}
    number = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)} - asis
    keyed = df.select(*[F.col(c) if c in asis | number else text_key(c).alias(c) for c in df.columns])
    return keyed.select(*[
        F.col(c) if c in asis else
        (F.nanvl(F.coalesce(F.col(c).cast("double"), dlit(0.0)), dlit(0.0)) if c in number else value_of_key(F.col(c))).alias(c)
        for c in df.columns])


def preprocess_raw(df: DataFrame, passthrough=("id", "y")) -> DataFrame:
    """Clean with the two base categoricals kept as text."""
    return clean_frame(df, keep=CAT_FEATURES, passthrough=passthrough)


def encode_target(df: DataFrame, target: str = "target", out: str = "y") -> DataFrame:
    """Label text -> 0/1/2; unknown labels give NULL (see ``unknown_labels``)."""
    expr = None
    for code, label in enumerate(CLASS_LABELS):
        cond = F.col(target) == F.lit(label)
        expr = F.when(cond, F.lit(code)) if expr is None else expr.when(cond, F.lit(code))
    return df.withColumn(out, expr.cast("int"))


def unknown_labels(df: DataFrame, target: str = "target") -> DataFrame:
    """Distinct label texts outside the label map (the set to report)."""
    return (df.select(target).distinct()
            .filter(~F.col(target).isin(*CLASS_LABELS) | F.col(target).isNull()))


def assert_known_labels(df: DataFrame, target: str = "target", shown: int = 20) -> None:
    """Fails on labels outside the label map; the message lists the first ``shown``."""
    _refuse_labels(df, None, target, shown)


def _refuse_labels(df: DataFrame, n: int | None, target: str, shown: int) -> None:
    if n == 0:
        return
    bad = [r[0] for r in unknown_labels(df, target).orderBy(target).limit(shown).collect()]
    if bad:
        rows = f" in {n} rows" if n else ""
        raise ValueError(f"unknown class labels{rows}: {bad}" + (" and maybe more" if len(bad) == shown else ""))


def read_checked(raw: DataFrame, write, id_col: str = "id", target: str = "target") -> tuple[DataFrame, dict]:
    """Read step with its checks inside the one pass that writes the cleaned table.

    ``write(df)`` stores a table and returns it (``session.cut_lineage``).  The
    rows, the size of every class, the rows with an unknown label and the NULLs of
    every kept category are observed on that write; nothing else scans the
    input.  Unknown labels, or text that cleaning left over, fail."""
    whole = encode_target(raw, target)
    clean = preprocess_raw(whole.drop(target), passthrough=(id_col, "y"))
    if left := text_columns_left(clean, passthrough=(id_col,)):
        raise ValueError(f"text columns left after cleaning: {left}")
    seen = Observation()
    cats = [c for c in CAT_FEATURES if c in clean.columns]
    count = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0).cast("long"))
    watched = clean.observe(seen, F.count(F.lit(1)).alias("rows"), count(F.col("y").isNull()).alias("unknown_labels"),
                            *[count(F.col("y").eqNullSafe(F.lit(i))).alias(f"class_{i}") for i in range(len(CLASS_LABELS))],
                            *[count(F.col(c).isNull()).alias(f"null_{c}") for c in cats])
    stored = write(watched)
    report = dict(seen.get)
    _refuse_labels(raw, report["unknown_labels"], target, 20)
    return stored, report


def decode_label(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.element_at(F.array(*[F.lit(x) for x in CLASS_LABELS]), c + 1)


def read_scored_table(raw: DataFrame, id_col: str = "id", target: str = "target") -> DataFrame:
    """Read step: encode the label, drop the label text, clean the rest."""
    df = encode_target(raw, target).drop(target)
    return preprocess_raw(df, passthrough=(id_col, "y"))


def fill_categories(df: DataFrame, cols=CAT_FEATURES, token: str = MISSING_TOKEN) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(token))
                           for c in cols if c in df.columns})


def null_counts(df: DataFrame, cols=None) -> DataFrame:
    """Long table (column_name, n_null) from one aggregation over all columns."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast("bigint").alias(c)
                    for c in cols])
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in cols]
    return wide.select(F.inline(F.array(*entries)))


def assert_no_null_categories(df: DataFrame, cols=CAT_FEATURES, label: str = "") -> None:
    bad = {r["column_name"]: r["n_null"]
           for r in null_counts(df, [c for c in cols if c in df.columns]).collect()
           if r["n_null"] > 0}
    if bad:
        tag = f" [{label}]" if label else ""
        raise ValueError(f"NULL remains in categorical columns{tag}: {bad}")


def text_columns_left(df: DataFrame, keep=CAT_FEATURES, passthrough=("id",)) -> list[str]:
    """Schema-only check: columns still text after cleaning (no scan)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and f.name not in keep and f.name not in passthrough]


def align_columns(source: DataFrame | list, target: DataFrame, fill=0.0) -> DataFrame:
    """Reorder ``target`` to ``source``'s columns, add missing as ``fill``, drop extras."""
    names = source.columns if isinstance(source, DataFrame) else list(source)
    have = set(target.columns)
    return target.select(*[F.col(c) if c in have else dlit(fill).alias(c) for c in names])


def safe_int_columns(df: DataFrame, cols) -> DataFrame:
    return df.select("id", *[safe_int(c).alias(f"{c}_int") for c in cols])
