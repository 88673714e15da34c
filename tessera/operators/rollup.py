"""Roll-ups, lookups with defaults, pivots and point-in-time counts
(A1-A5, J5, J6, J7, J12, R1, R2, D5-D8).

All aggregations are hash aggregations with map-side partial combine, so a
group holding a third of the rows is pre-reduced in every map task.  Pivot
values are always a fixed list (no extra distinct job, stable schema).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import domain
from tessera.functions.codes import year_prefix
from tessera.functions.numeric import floor_at, round_half_even, safe_ratio
from tessera.functions.text import normalize_name


def lookup_table(spark: SparkSession, mapping: dict, key_cols, value_col: str) -> DataFrame:
    """A literal lookup dict -> small DataFrame (fixed size, safe to broadcast)."""
    key_cols = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    rows = [(*(k if isinstance(k, tuple) else (k,)), v) for k, v in mapping.items()]
    return spark.createDataFrame(rows, [*key_cols, value_col])


def sum_measures(df: DataFrame, keys, measures, clip_at_zero=()) -> DataFrame:
    """A1 (+C10): group sums with all-NULL groups -> 0 (pandas), optional floor at 0."""
    aggs = []
    for m in measures:
        s = F.coalesce(F.sum(m), F.lit(0))
        aggs.append((floor_at(s, 0) if m in clip_at_zero else s).alias(m))
    return df.groupBy(*keys).agg(*aggs)


def lookup_with_default(df: DataFrame, lookup: DataFrame, on, value_col: str,
                        default=domain.UNKNOWN_FAMILY, broadcast: bool = True) -> DataFrame:
    """Left lookup on a (composite) key; unmatched -> ``default`` (None = J6).

    ``broadcast`` is for literal lookup tables whose size is fixed by
    construction; data-derived tables should pass False and let AQE decide
    from the measured size.
    """
    right = F.broadcast(lookup) if broadcast else lookup
    out = df.join(right, on=on, how="left")
    if default is not None:
        out = out.withColumn(value_col, F.coalesce(F.col(value_col), F.lit(default)))
    return out


def pivot_sum(df: DataFrame, keys, pivot_col: str, values, measure: str,
              zero_fill=None, agg: str = "sum") -> DataFrame:
    """Fixed-value pivot.

    ``zero_fill`` lists the pivot values whose missing cells become 0
    (R1 fills the known families, not the unknown bucket); R2 passes none.
    Expressed as one conditional aggregation per value, which is what
    Spark's pivot rewrites to, keeping it a single hash aggregation.
    """
    fn = {"sum": F.sum, "avg": F.avg, "mean": F.avg, "median": F.median, "max": F.max}[agg]
    zero_fill = set(values if zero_fill is None else zero_fill)
    cols = []
    for v in values:
        e = fn(F.when(F.col(pivot_col) == F.lit(v), F.col(measure)))
        if v in zero_fill:
            e = F.coalesce(e, F.lit(0))
        cols.append(e.alias(str(v)))
    return df.groupBy(*keys).agg(*cols)


def conditional_share(df: DataFrame, keys, measure: str, condition, scale: float = 100.0,
                      digits: int = 2, out_col: str = "pct") -> DataFrame:
    """A4: 100 * sum(measure where condition) / sum(measure), total > 0, rounded."""
    agg = df.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(condition, F.col(measure))), F.lit(0.0)).alias("_part"),
        F.coalesce(F.sum(measure), F.lit(0.0)).alias("_total"))
    return (agg.where(F.col("_total") > 0)
               .select(*keys, safe_ratio("_part", "_total", scale, digits).alias(out_col)))


def active_at_dates(df: DataFrame, key, start_col: str, end_col: str, dates: dict,
                    open_sentinel: str = domain.OPEN_SENTINEL, label_col: str = "annee",
                    out_col: str = "nb_active") -> DataFrame:
    """J12 + A5: count rows whose validity interval covers each snapshot date.

    Active at d  <=>  start <= d AND (end > d OR end = sentinel).  A NULL
    end is *not* active (only the sentinel means open).  The date list is a
    literal array exploded per row (a narrow, codegen'd step: one pass over
    the big side, no join).
    """
    key = [key] if isinstance(key, str) else list(key)
    snap = F.array(*[F.struct(F.lit(k).alias("lbl"), F.lit(v).alias("d")) for k, v in dates.items()])
    s = F.col(start_col)
    e = F.col(end_col)
    x = df.select(*key, s.alias("_s"), e.alias("_e"), F.explode(snap).alias("_snap"))
    d = F.col("_snap.d")
    active = (F.col("_s") <= d) & ((F.col("_e") > d) | (F.col("_e") == F.lit(open_sentinel)))
    return (x.where(active)
             .groupBy(*key, F.col("_snap.lbl").alias(label_col))
             .agg(F.count(F.lit(1)).alias(out_col)))


def fallback_overlay(base: DataFrame, key: str, parent_key: str, entity_values: DataFrame,
                     parent_values: DataFrame, columns, periods=None, period_col: str = "annee",
                     prefix: str = "") -> DataFrame:
    """Every base entity gets its parent-level value, overwritten per column
    by its own value where that is non-NULL; columns renamed with ``prefix`` (P3).

    ``entity_values`` is keyed by (key[, period]); ``parent_values`` by
    (parent_key[, period]).  ``periods`` is a fixed list: each base row is
    replicated once per period by exploding a literal array (narrow step).
    """
    per = [period_col] if periods else []
    b = base
    if periods:
        b = b.withColumn(period_col, F.explode(F.array(*[F.lit(p) for p in periods])))
    ev = entity_values.select(key, *per, *[F.col(c).alias(f"_e_{c}") for c in columns])
    pv = parent_values.select(F.col(parent_key).alias("_pk"), *per,
                              *[F.col(c).alias(f"_p_{c}") for c in columns])
    j = b.join(pv.withColumnRenamed("_pk", parent_key), [parent_key, *per], "left")
    j = j.join(ev, [key, *per], "left")
    return j.select(*b.columns, *[F.coalesce(F.col(f"_e_{c}"), F.col(f"_p_{c}")).alias(prefix + c)
                                  for c in columns])


def attach_period(df: DataFrame, year_col: str, periods: dict, period_col: str = "annee") -> DataFrame:
    """Period alignment (D8): each row is copied to every period whose year list
    contains its year.  The period table is a literal (fixed size)."""
    pairs = [(p, y) for p, ys in periods.items() for y in ys]
    arr = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(y).alias("y")) for p, y in pairs])
    return (df.withColumn("_pp", F.explode(arr))
              .where(F.col(year_col) == F.col("_pp.y"))
              .withColumn(period_col, F.col("_pp.p")).drop("_pp"))


def family_rollup(general: DataFrame, candidates: DataFrame, families: DataFrame, *,
                  place_col: str, election_col: str, count_cols, vote_col: str,
                  surname_col: str, firstname_col: str, family_values,
                  positive_col: str | None = None, clip_cols=(),
                  unknown=domain.UNKNOWN_FAMILY, year_col: str = "annee") -> DataFrame:
    """Polling-station results -> place x year with votes per family.

    general:    rows with (election id, place, count columns)
    candidates: rows with (election id, place, surname, first name, votes)
    families:   (nom_norm, prenom_norm, famille) lookup (literal, broadcast)
    Codes are expected already harmonised (D2).
    """
    g = general
    if positive_col:
        g = g.where(F.col(positive_col) > 0)
    g = g.withColumn(year_col, year_prefix(election_col))
    gen = sum_measures(g, [year_col, place_col], list(count_cols), clip_at_zero=clip_cols)

    # aggregate on the raw names first: normalisation (translate + regex) then
    # runs once per (year, place, raw name) instead of once per polling station
    c = (candidates.withColumn(year_col, year_prefix(election_col))
                   .groupBy(year_col, place_col, surname_col, firstname_col)
                   .agg(F.sum(vote_col).alias(vote_col))
                   .withColumn("nom_norm", normalize_name(surname_col))
                   .withColumn("prenom_norm", normalize_name(firstname_col)))
    c = lookup_with_default(c, families, ["nom_norm", "prenom_norm"], "famille", unknown)
    # the pivot zero-fills every cell, the unknown bucket included; after the
    # left join only the known families are zero-filled, so the unknown bucket
    # stays NULL for places without any candidate row
    values = list(family_values) + [unknown]
    piv = pivot_sum(c, [year_col, place_col], "famille", values, vote_col, zero_fill=values)
    out = gen.join(piv, [year_col, place_col], "left")
    return out.fillna(0, subset=list(family_values))


def unmapped_values(candidates: DataFrame, families: DataFrame, surname_col: str,
                    firstname_col: str, unknown=domain.UNKNOWN_FAMILY) -> DataFrame:
    """V3: distinct raw (surname, first name) whose normalised pair is unmapped."""
    c = (candidates.select(surname_col, firstname_col).distinct()
                   .withColumn("nom_norm", normalize_name(surname_col))
                   .withColumn("prenom_norm", normalize_name(firstname_col)))
    c = lookup_with_default(c, families, ["nom_norm", "prenom_norm"], "famille", unknown)
    return c.where(F.col("famille") == unknown).select(surname_col, firstname_col)


def family_shares(rollup: DataFrame, family_values, total_col: str, digits: int = 2) -> DataFrame:
    """C11 over D5: pct_<family> = round(votes / total * 100, 2)."""
    return rollup.withColumns({f"pct_{f}": safe_ratio(f, total_col, 100.0, digits)
                               for f in family_values})


def group_mean_round(df: DataFrame, keys, cols, digits: int = 4) -> DataFrame:
    """Group mean of metrics, rounded."""
    return df.groupBy(*keys).agg(*[round_half_even(F.avg(c), digits).alias(c) for c in cols])
