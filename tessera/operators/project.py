"""Trend projection and trend tables.

Projection: x_late + h * (x_late - x_early) / span for horizons h = 1..H.
Entities only in the late period are held constant (delta 0), entities only
in the early period are dropped, NULLs take the global median.  Both periods
come from one scan; the horizon table is a literal array exploded per row
(no cross join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import domain
from tessera.functions.numeric import round_half_even
from tessera.operators.codes import first_per_key
from tessera.operators.impute import global_medians
from tessera.operators.quantiles import exact_quantiles


def trend_projection(table: DataFrame, key: str, period_col: str, early: str, late: str, features,
                     years=tuple(domain.PROJECTION_YEARS), span: float = domain.TREND_SPAN_YEARS,
                     meta_cols=(), digits: int | None = 4, prefix: str = "") -> DataFrame:
    """(key, annee_projetee, projected features..., meta from the late period)."""
    features, meta_cols = list(features), list(meta_cols)
    med = global_medians(table, features)
    sel = table.select(key, period_col, *features, *meta_cols)
    filled = sel.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(med[f]).cast("double")) for f in features})
    early_rows = first_per_key(filled.where(F.col(period_col) == early), key, features).select(
        key, *[F.col(f).alias(f"_e_{f}") for f in features])
    late_rows = first_per_key(filled.where(F.col(period_col) == late), key, features + meta_cols)
    j = late_rows.join(early_rows, key, "left")
    hz = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.lit(y).alias("y")) for h, y in enumerate(years, 1)]))
    j = j.withColumn("_hz", hz)
    out = []
    for f in features:
        delta = F.coalesce((F.col(f) - F.col(f"_e_{f}")) / F.lit(float(span)), F.lit(0.0))
        v = F.col(f) + F.col("_hz.h") * delta
        out.append((round_half_even(v, digits) if digits is not None else v).alias(prefix + f))
    return j.select(key, F.col("_hz.y").alias("annee_projetee"), *out, *meta_cols)


def median_by_period_pivot(df: DataFrame, group_col: str, period_col: str, value_col: str, periods,
                           digits: int = 2, total_label: str | None = "ALL") -> DataFrame:
    """Exact median of ``value_col`` per group x period, periods pivoted
    to columns ``median_<period>``; optional extra row for all groups."""
    periods = list(periods)
    med = exact_quantiles(df.where(F.col(period_col).isin(periods)), [group_col, period_col], value_col, [0.5])
    piv = med.groupBy(group_col).agg(*[
        round_half_even(F.max(F.when(F.col(period_col) == p, F.col("value"))), digits).alias(f"median_{p}")
        for p in periods])
    if total_label is None:
        return piv
    tot = exact_quantiles(df.where(F.col(period_col).isin(periods)), [period_col], value_col, [0.5])
    tot_row = tot.groupBy(F.lit(total_label).alias(group_col)).agg(*[
        round_half_even(F.max(F.when(F.col(period_col) == p, F.col("value"))), digits).alias(f"median_{p}")
        for p in periods])
    return piv.unionByName(tot_row)
