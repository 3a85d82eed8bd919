"""Column-expression builders (all JVM-side, no Python UDFs)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strict number syntax accepted by the lenient parser.  The same pattern guards
# the cast in the oracle, because each engine's own cast accepts extras
# (Spark: '12d', DuckDB: '1_0').
NUMBER_PATTERN = r"^ *[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)? *$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c) -> Column:
    """Report rounding for averaged / divided outputs."""
    return F.round(col(c), 6)


def dlit(x: float) -> Column:
    return F.lit(float(x)).cast("double")


def argmax3(p0, p1, p2) -> Column:
    """Row argmax over three class scores; ties go to the lowest class."""
    p0, p1, p2 = col(p0), col(p1), col(p2)
    return (F.when((p0 >= p1) & (p0 >= p2), F.lit(0))
            .when(p1 >= p2, F.lit(1))
            .otherwise(F.lit(2)))


def argmax2(p0, p1) -> Column:
    return F.when(col(p0) >= col(p1), F.lit(0)).otherwise(F.lit(1))


def ratio(num, den) -> Column:
    """num / den, 0.0 when the denominator is 0 (undefined metric -> 0)."""
    num, den = col(num), col(den)
    return F.when(den > 0, num.cast("double") / den).otherwise(dlit(0.0))


def count_true(cond: Column, weight: Column | None = None) -> Column:
    w = weight if weight is not None else F.lit(1)
    return F.sum(F.when(cond, w).otherwise(F.lit(0))).cast("bigint")


#: White space as the method's text strip knows it: ASCII and Unicode spaces.
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip_space(c) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.btrim(col(c).cast("string"), F.lit(WHITE_SPACE))


def lenient_number(c) -> Column:
    """Text -> double when it is a plain number, else NULL (never raises)."""
    return stripped_number(strip_space(c))


def stripped_number(c: Column) -> Column:
    """``lenient_number`` of text that is stripped already."""
    return F.when(c.rlike(NUMBER_PATTERN), c.try_cast("double"))


def safe_int(c) -> Column:
    """Number (already cleaned to double), NULL -> 0, truncated toward zero."""
    return F.coalesce(col(c).cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def sum_cols(cols) -> Column:
    return reduce(add, [col(c) for c in cols])


def entropy3(w0, w1, w2, eps: float = 1e-12) -> Column:
    """-sum w ln(w + eps), rounded to 9 digits so both engines order alike."""
    terms = [col(w) * F.log(col(w) + dlit(eps)) for w in (w0, w1, w2)]
    return F.round(-(terms[0] + terms[1] + terms[2]), 9)
