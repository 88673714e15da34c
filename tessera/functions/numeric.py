"""Numeric scalar functions (C3-C6, C10, C11, C13, C17-C25, C27) as Columns.

Semantics follow the pandas rules they replace (see the survey's list of
pitfalls): NaN is normalised to NULL right after any cast, division by zero
gives NULL, rounding is half-even on the scaled double.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions._cols import as_col

# Plain decimal numbers only; everything else (1.5d, 1f, nan, inf, '') -> NULL.
NUMBER_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def nan_to_null(c) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def finite_or_null(c) -> Column:
    """NaN, +Inf, -Inf -> NULL."""
    c = as_col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def to_number(c) -> Column:
    """Coerce a string to double, anything not a plain number -> NULL."""
    s = as_col(c).cast("string")
    return F.when(s.rlike(NUMBER_RE), F.trim(s).try_cast("double"))


def clean_suppressed(c, marker: str = "s", decimal_sep: str = ",") -> Column:
    """C3+C4+C5: suppression marker -> NULL, decimal comma -> dot, coerce."""
    s = F.nullif(as_col(c).cast("string"), F.lit(marker))
    return to_number(F.replace(s, F.lit(decimal_sep), F.lit(".")))


def strict_number(c, decimal_sep: str = ",") -> Column:
    """Strict parse; a malformed value raises under ANSI mode."""
    return F.replace(as_col(c).cast("string"), F.lit(decimal_sep), F.lit(".")).cast("double")


def round_half_even(c, digits: int = 2) -> Column:
    """Pandas ``.round(d)`` = rint(x * 10^d) / 10^d on the double."""
    k = float(10 ** digits)
    return F.rint(as_col(c) * F.lit(k)) / F.lit(k)


def stable_round(c, digits: int = 6) -> Column:
    """Round a computed statistic reproducibly across engines and summation
    orders: first snap to ``digits + 4`` decimals (absorbs last-ulp noise),
    then round half-even to ``digits``; pure IEEE double arithmetic, so any
    engine doing the same operations gets the same bits."""
    fine = F.rint(as_col(c).cast("double") * F.lit(float(10 ** (digits + 4))))
    return F.rint(fine / F.lit(1e4)) / F.lit(float(10 ** digits))


def safe_ratio(num, den, scale: float = 100.0, digits: int | None = 2) -> Column:
    """C11/C17: round(num / (den or NULL) * scale, digits); zero or NULL den -> NULL."""
    v = F.try_divide(as_col(num).cast("double"), F.nullif(as_col(den).cast("double"), F.lit(0.0)))
    v = v * F.lit(float(scale))
    return round_half_even(v, digits) if digits is not None else v


def floor_at(c, lower: float = 0) -> Column:
    """clip(lower=...)."""
    return F.greatest(as_col(c), F.lit(lower))


def fill(c, value) -> Column:
    """fillna(value)."""
    return F.coalesce(as_col(c), F.lit(value))


def row_sum(cols) -> Column:
    """Row-wise sum with NULL as 0 (pandas ``sum(axis=1)``)."""
    return reduce(lambda a, b: a + b, [F.coalesce(as_col(c), F.lit(0.0)) for c in cols])


def row_mean(cols) -> Column:
    """Row-wise mean of non-null values (pandas ``mean(axis=1)``)."""
    cols = [as_col(c) for c in cols]
    s = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    n = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in cols])
    return F.try_divide(s, F.nullif(n, F.lit(0)).cast("double"))


def all_or_total(parts, total) -> Column:
    """Sum of the parts when all are present, otherwise the single total."""
    return F.coalesce(reduce(lambda a, b: a + b, [as_col(p) for p in parts]), as_col(total))


def min_max_scaled(c, lo: Column, hi: Column) -> Column:
    """C20: (x - min) / (max - min) with NULL -> 0 first and a constant column -> 0."""
    x = F.coalesce(as_col(c), F.lit(0.0))
    return F.coalesce(F.try_divide(x - lo, F.nullif(hi - lo, F.lit(0.0))), F.lit(0.0))


def canonical_int_string(c) -> Column:
    """``84.0`` -> ``'84'``; NULL kept."""
    return as_col(c).cast("double").cast("long").cast("string")


def to_long_truncating(c) -> Column:
    """C25 int part: finite doubles cast to long, others NULL."""
    return finite_or_null(c).cast("long")


def status_rule(null_pct, skew, max_null_pct: float = 50.0, skew_limit: float = 2.0) -> Column:
    """Unusable if too sparse, to_transform if strongly skewed, else ok."""
    return (F.when(as_col(null_pct) > max_null_pct, F.lit("inutilisable"))
            .when(F.abs(F.coalesce(as_col(skew), F.lit(0.0))) > skew_limit, F.lit("à_transformer"))
            .otherwise(F.lit("ok")))
