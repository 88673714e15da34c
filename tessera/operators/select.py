"""Feature selection operators.

Mutual information is re-aimed to a deterministic, SQL-checkable estimator:
both variables are binned by their quantile edges and the plug-in MI of the
contingency table is computed.  Edges are one small aggregate per column
(p rows to the driver); binning is a codegen'd expression; the contingency
counts are a hash aggregation whose map-side combine keeps the shuffle at
O(features x targets x bins^2) rows per task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import domain
from tessera.functions.numeric import min_max_scaled, row_mean, row_sum, safe_ratio, stable_round
from tessera.operators.quality import to_long
from tessera.operators.quantiles import exact_quantiles


def quantile_edges(df: DataFrame, cols, bins: int = 10) -> dict:
    """Interior quantile edges (exact, linear interpolation) of each column's
    non-NULL values: {col: [e1, ..., e_{bins-1}]}.  One aggregation, p rows."""
    probs = [i / bins for i in range(1, bins)]
    rows = exact_quantiles(to_long(df, cols), ["feature"], "value", probs).collect()
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["feature"], r["q"])):
        out.setdefault(r["feature"], []).append(r["value"])
    return out


def bin_expr(c: str, edges) -> Column:
    """Bin index = number of edges strictly below the value (NULL stays NULL)."""
    v = F.col(c).cast("double")
    if not edges:
        return F.when(v.isNotNull(), F.lit(0))
    return F.when(v.isNotNull(), reduce(lambda a, b: a + b,
                                        [F.when(v > F.lit(float(e)), 1).otherwise(0) for e in edges]))


def _contingency(binned: DataFrame, features: list, targets: list, bins: int) -> DataFrame:
    """(feature, target, bx, by, nxy) of rows where both bins are known (-1: NULL).  A task counts all pairs of
    columns over its rows as arrays and sends one row a filled cell; no row is copied for each pair."""
    def count(batches):
        total = np.zeros((len(features), len(targets), bins * bins), np.int64)
        for batch in batches:
            code = {c: batch.column(c).to_numpy().astype(np.int64) for c in batch.schema.names}
            for i, f in enumerate(features):
                for j, t in enumerate(targets):
                    both = (code[f] >= 0) & (code[t] >= 0)
                    total[i, j] += np.bincount(code[f][both] * bins + code[t][both], minlength=bins * bins)
        i, j, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()) for v in (i, j, cell // bins, cell % bins)] + [pa.array(total[i, j, cell])],
                                         names=["f", "t", "bx", "by", "n"])

    def named(names, at):
        return F.element_at(F.array(*[F.lit(n) for n in names]), F.col(at) + 1)

    cells = binned.mapInArrow(count, "f int, t int, bx int, by int, n long").groupBy("f", "t", "bx", "by").agg(F.sum("n").alias("nxy"))
    return cells.select(named(features, "f").alias("feature"), named(targets, "t").alias("target"), "bx", "by", "nxy")


def binned_mutual_info(df: DataFrame, features, targets, bins: int = 10, digits: int = 6,
                       edges: dict | None = None) -> DataFrame:
    """M9 re-aimed: (feature, target, mi, n) with plug-in MI (nats) of the
    quantile-binned pair over rows where both are non-NULL."""
    features, targets = list(features), list(targets)
    cols = list(dict.fromkeys(features + targets))
    edges = edges or quantile_edges(df, cols, bins)
    binned = df.select(*[F.coalesce(bin_expr(c, edges.get(c, [])), F.lit(-1)).cast("int").alias(c) for c in cols])
    cells = _contingency(binned, features, targets, bins)
    nx = cells.groupBy("feature", "target", "bx").agg(F.sum("nxy").alias("nx"))
    ny = cells.groupBy("feature", "target", "by").agg(F.sum("nxy").alias("ny"))
    n = cells.groupBy("feature", "target").agg(F.sum("nxy").alias("n"))
    j = cells.join(nx, ["feature", "target", "bx"]).join(ny, ["feature", "target", "by"]).join(n, ["feature", "target"])
    term = (F.col("nxy") / F.col("n")) * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return (j.groupBy("feature", "target").agg(F.sum(term).alias("mi"), F.first("n").alias("n"))
             .select("feature", "target", stable_round("mi", digits).alias("mi"), F.col("n").cast("long")))


def select_features(mi: DataFrame, forced=(), threshold: float = domain.MI_MIN, digits: int = 6) -> DataFrame:
    """Mean MI over targets; keep when >= threshold or forced."""
    forced = list(forced)
    agg = mi.groupBy("feature").agg(stable_round(F.avg("mi"), digits).alias("mi_mean"))
    keep = (F.col("mi_mean") >= threshold)
    if forced:
        keep = keep | F.col("feature").isin(forced)
    return agg.withColumn("selected", keep)


def composite_columns(df: DataFrame, specs) -> dict:
    """M7: composite expressions.  specs: list of (name, kind, components[, den]) with kind in
    'minmax_mean' (C20 + C19), 'product' (C21), 'shifted_ratio' a/(b+1) (C21),
    'density' sum(components)/den*1000 (C18 + C11)."""
    out = {}
    for spec in specs:
        name, kind, comps = spec[0], spec[1], list(spec[2])
        if kind == "minmax_mean":
            # the scaler is fitted on the columns with NULL -> 0, as the source does
            filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in comps}
            stats = df.agg(*[F.min(e).alias(f"lo_{c}") for c, e in filled.items()],
                           *[F.max(e).alias(f"hi_{c}") for c, e in filled.items()]).first()
            scaled = [min_max_scaled(filled[c], F.lit(stats[f"lo_{c}"]), F.lit(stats[f"hi_{c}"])) for c in comps]
            out[name] = row_mean(scaled)
        elif kind == "product":
            out[name] = F.col(comps[0]) * F.col(comps[1])
        elif kind == "shifted_ratio":
            out[name] = F.try_divide(F.col(comps[0]), F.col(comps[1]) + F.lit(1.0))
        elif kind == "density":
            out[name] = safe_ratio(row_sum(comps), spec[3], 1000.0, None)
        else:
            raise ValueError(kind)
    return out


def composite_gate(df: DataFrame, composites: dict, targets, bins: int = 10,
                   min_rows: int = domain.COMPOSITE_MIN_ROWS, min_gain: float = domain.COMPOSITE_MIN_GAIN,
                   components: dict | None = None, digits: int = 6) -> DataFrame:
    """M8: keep a composite when its mean relative MI gain over its best
    component exceeds ``min_gain`` (targets with < min_rows joint rows skipped).

    composites: {name: Column}; components: {name: [component columns]}.
    All composites and components are scored in ONE binned-MI pass (one
    edges aggregation, one contingency aggregation).  Returns (composite, gain, kept)."""
    targets = list(targets)
    spark = df.sparkSession
    wide = df.withColumns(composites)
    # a component is scored on the rows of its composite
    of = {(k, c): f"{k}|{c}" for k, cs in components.items() for c in cs}
    has = {k: F.col(k).isNotNull() & ~F.isnan(F.col(k).cast("double")) for k in components}
    wide = wide.withColumns({name: F.when(has[k], F.col(c)) for (k, c), name in of.items()})
    mi = binned_mutual_info(wide, [*components, *of.values()], targets, bins, digits=12)
    links = spark.createDataFrame([(k, name) for (k, _), name in of.items()], "composite string, feature string")
    base = (mi.join(F.broadcast(links), "feature").groupBy("composite", "target")
              .agg(F.max("mi").alias("mi_base")))
    own = (mi.where(F.col("n") >= min_rows)
             .select(F.col("feature").alias("composite"), "target", F.col("mi").alias("mi_c")))
    gains = (own.join(base, ["composite", "target"]).where(F.col("mi_base") > 0)
                .groupBy("composite").agg(F.avg((F.col("mi_c") - F.col("mi_base")) / F.col("mi_base")).alias("gain")))
    names = spark.createDataFrame([(k,) for k in components], "composite string")
    out = names.join(gains, "composite", "left").select(
        "composite", stable_round(F.coalesce("gain", F.lit(0.0)), digits).alias("gain"))
    return out.withColumn("kept", F.col("gain") > min_gain)


def log_gate(df: DataFrame, profile: DataFrame, features, skip_prefixes=("taux_", "pct_", "solde_"),
             factor: float = domain.LOG_GAIN_FACTOR, digits: int = 3) -> DataFrame:
    """A feature profiled as 'to transform' whose name is not a rate and
    whose minimum is >= 0 is replaced by log1p(x) when that cuts |skewness| by
    the factor.  Returns (feature, skew_before, skew_after, transformed)."""
    long = to_long(df, features).where(F.col("value").isNotNull() & ~F.isnan("value"))
    stats = long.groupBy("feature").agg(
        F.skewness("value").alias("sb"), F.skewness(F.log1p("value")).alias("sa"), F.min("value").alias("mn"))
    cand = (profile.select("feature", "statut")
                   .join(stats, "feature", "left")
                   .withColumn("candidate", (F.col("statut") == "à_transformer") & (F.col("mn") >= 0)
                               & ~reduce(lambda a, b: a | b, [F.col("feature").startswith(p) for p in skip_prefixes])))
    return cand.select(
        "feature",
        stable_round("sb", digits).alias("skew_before"),
        F.when(F.col("candidate"), stable_round("sa", digits)).alias("skew_after"),
        F.coalesce(F.col("candidate") & (F.abs("sa") < F.abs("sb") * factor), F.lit(False)).alias("transformed"))


def apply_log_gate(df: DataFrame, gate_rows) -> DataFrame:
    """Swap each transformed feature for ``log1p_<feature>`` (schema decision from p rows)."""
    out = df
    for r in gate_rows:
        if r["transformed"]:
            out = out.withColumn(f"log1p_{r['feature']}", F.log1p(r["feature"])).drop(r["feature"])
    return out
