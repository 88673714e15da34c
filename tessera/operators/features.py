"""Ratio features (D10) from a declarative spec; target recomputation.

All features of a table are produced by a single ``withColumns`` (one
projection, inside whole-stage codegen).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import domain
from tessera.functions.numeric import all_or_total, safe_ratio


@dataclass
class Ratio:
    """name = round(num / den * scale, digits); den 0/NULL -> NULL (C11).

    ``fill_num`` treats a NULL numerator as 0 (C17)."""
    name: str
    num: str
    den: str
    scale: float = 100.0
    digits: int = 2
    fill_num: bool = False


@dataclass
class PartsOrTotal:
    """name = ratio(sum(parts) if all present else total, den)."""
    name: str
    parts: list
    total: str
    den: str
    scale: float = 100.0
    digits: int = 2


@dataclass
class ByPeriod:
    """name = round((a_p - b_p) / den * scale, digits) with (a_p, b_p) chosen
    by the row's period (C16); a period not listed -> NULL."""
    name: str
    period_col: str
    cols: dict = field(default_factory=dict)   # period -> (a, b)
    den: str = ""
    scale: float = 1000.0
    digits: int = 2


@dataclass
class Custom:
    """name = fn(df) -> Column (or None when its inputs are absent)."""
    name: str
    fn: object


def _expr(df: DataFrame, spec) -> Column | None:
    have = set(df.columns)
    if isinstance(spec, Custom):
        return spec.fn(df)
    if isinstance(spec, Ratio):
        if spec.num not in have or spec.den not in have:   # P5: optional inputs
            return None
        num = F.coalesce(F.col(spec.num), F.lit(0.0)) if spec.fill_num else F.col(spec.num)
        return safe_ratio(num, spec.den, spec.scale, spec.digits)
    if isinstance(spec, PartsOrTotal):
        if spec.den not in have:
            return None
        parts = [F.col(p) if p in have else F.lit(None).cast("double") for p in spec.parts]
        total = F.col(spec.total) if spec.total in have else F.lit(None).cast("double")
        return safe_ratio(all_or_total(parts, total), spec.den, spec.scale, spec.digits)
    if isinstance(spec, ByPeriod):
        if spec.den not in have:
            return None
        e = None
        for period, (a, b) in spec.cols.items():
            if a not in have or b not in have:
                continue
            v = safe_ratio(F.col(a) - F.col(b), spec.den, spec.scale, spec.digits)
            cond = F.col(spec.period_col) == F.lit(period)
            e = F.when(cond, v) if e is None else e.when(cond, v)
        return e if e is not None else F.lit(None).cast("double")
    raise TypeError(spec)


def ratio_features(df: DataFrame, specs) -> DataFrame:
    """Add every feature whose inputs exist, in one projection."""
    cols = {}
    for s in specs:
        e = _expr(df, s)
        if e is not None:
            cols[s.name] = e
    return df.withColumns(cols)


def recompute_targets(df: DataFrame, families=tuple(domain.FAMILIES), total: str = "exprimes",
                      strict: bool = True) -> DataFrame:
    """pct_<family> from counts when absent; raise (strict) if still missing."""
    add = {f"pct_{f}": safe_ratio(f, total, 100.0, 2) for f in families
           if f"pct_{f}" not in df.columns and f in df.columns and total in df.columns}
    out = df.withColumns(add) if add else df
    missing = [f"pct_{f}" for f in families if f"pct_{f}" not in out.columns]
    if missing and strict:
        raise ValueError(f"missing targets: {missing}")
    return out
