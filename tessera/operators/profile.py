"""Column profiling, pairwise correlation, top-k and collinearity pruning.

* Profiles are computed in long form (unpivot -> groupBy(feature)): map
  tasks emit one partial row per feature, the plan does not grow with the
  column count.
* Pairwise-complete Pearson correlation uses a distributed Gram matrix:
  each partition computes ``V'V`` for ``V = [x, x^2, mask]`` (values
  centred by the global mean, NULL -> 0) with numpy and emits one row of
  moments per column pair; Spark sums the partials per pair.  One pass over
  the data for all pairs, O(p^2) rows per partition in the shuffle.
* Average-linkage clustering merges reciprocal nearest clusters in rounds
  over the small table of cluster pairs (p^2 rows at first), checkpointed
  per round; the merges are a result, cut at any height.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera import domain
from tessera.functions.codes import priority_from_prefix
from tessera.functions.numeric import nan_to_null, round_half_even, stable_round, status_rule
from tessera.operators.codes import close_edges
from tessera.operators.joins import top_n_per_group
from tessera.operators.quality import to_long
from tessera.session import cut_lineage


def column_profile(df: DataFrame, features, period_col: str | None = None, periods=(),
                   max_null_pct: float = domain.COMPLETENESS_MAX_NULL_PCT,
                   skew_limit: float = domain.SKEW_LIMIT, digits: int = 6) -> DataFrame:
    """One row per feature: mean, sample std, min, max, biased skewness
    (g1, 0.0 when fewer than 3 values), NULL %, NULL % per period, zero %, status."""
    ids = [period_col] if period_col else []
    long = to_long(df, features, ids)
    long = long.withColumn("value", nan_to_null("value"))
    v = F.col("value")
    isnull = F.when(v.isNull(), 1.0).otherwise(0.0)
    aggs = [
        stable_round(F.avg(v), digits).alias("mean"),
        stable_round(F.stddev_samp(v), digits).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        F.when(F.count(v) > 2, stable_round(F.skewness(v), 3)).otherwise(F.lit(0.0)).alias("skewness"),
        round_half_even(F.avg(isnull) * 100, 1).alias("nan_pct"),
    ]
    for p in periods:
        aggs.append(round_half_even(F.avg(F.when(F.col(period_col).cast("string") == str(p), isnull)) * 100, 1)
                    .alias(f"nan_pct_{p}"))
    aggs.append(round_half_even(F.avg(F.when(v == 0, 1.0).otherwise(0.0)) * 100, 1).alias("zero_pct"))
    # the status looks at the values as they are, not at the rounded ones
    aggs += [(F.avg(isnull) * 100).alias("_null_pct"), F.when(F.count(v) > 2, F.skewness(v)).otherwise(F.lit(0.0)).alias("_skewness")]
    prof = long.groupBy("feature").agg(*aggs)
    return prof.withColumn("statut", status_rule("_null_pct", "_skewness", max_null_pct, skew_limit)).drop("_null_pct", "_skewness")


# ----------------------------------------------------------------------------- correlation

_MOMENTS = T.StructType([T.StructField(n, t) for n, t in [
    ("i", T.IntegerType()), ("j", T.IntegerType()), ("n", T.DoubleType()), ("sx", T.DoubleType()),
    ("sy", T.DoubleType()), ("sxx", T.DoubleType()), ("syy", T.DoubleType()), ("sxy", T.DoubleType())]])


def _gram_partials(cols, means, pairs):
    ii = np.array([p[0] for p in pairs], dtype=np.int64)
    jj = np.array([p[1] for p in pairs], dtype=np.int64)
    mu = np.asarray(means, dtype=np.float64)
    k = len(cols)

    def run(batches):
        g = np.zeros((3 * k, 3 * k))
        seen = False
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=np.float64, na_value=np.nan)
            m = np.isfinite(x)
            xc = np.where(m, x - mu, 0.0)
            v = np.hstack([xc, xc * xc, m.astype(np.float64)])
            g += v.T @ v
            seen = True
        if not seen:
            return
        X, X2, M = 0, k, 2 * k
        yield pd.DataFrame({
            "i": ii.astype(np.int32), "j": jj.astype(np.int32),
            "n": g[M + ii, M + jj],
            "sx": g[X + ii, M + jj], "sy": g[X + jj, M + ii],
            "sxx": g[X2 + ii, M + jj], "syy": g[X2 + jj, M + ii],
            "sxy": g[X + ii, X + jj]})
    return run


def pair_moments(df: DataFrame, cols, pairs) -> DataFrame:
    """Sums over rows where both columns are non-NULL, for each (i, j) pair of
    column indexes: n, sum x, sum y, sum x^2, sum y^2, sum xy (values centred
    by the column's global mean)."""
    cols = list(cols)
    sel = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols])
    means_row = sel.agg(*[F.avg(c).alias(c) for c in cols]).first()
    means = [float(means_row[c]) if means_row[c] is not None else 0.0 for c in cols]
    part = sel.mapInPandas(_gram_partials(cols, means, pairs), _MOMENTS)
    return part.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ["n", "sx", "sy", "sxx", "syy", "sxy"]])


def _r_from_moments() -> F.Column:
    n = F.col("n")
    cov = F.col("sxy") / n - (F.col("sx") / n) * (F.col("sy") / n)
    vx = F.col("sxx") / n - (F.col("sx") / n) ** 2
    vy = F.col("syy") / n - (F.col("sy") / n) ** 2
    den = F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))
    return F.when(n >= 2, F.try_divide(cov, F.nullif(den, F.lit(0.0))))


def correlations(df: DataFrame, features, targets=None, digits: int = 6) -> DataFrame:
    """M2: pairwise-complete Pearson r.

    With ``targets``: (feature, target, r, n) for every feature x target.
    Without: (feature_a, feature_b, r, n) for every unordered feature pair
    (a < b in list order).  r is NULL for a constant column or < 2 pairs.
    """
    spark = df.sparkSession
    features = list(features)
    if targets:
        cols = features + [t for t in targets if t not in features]
        idx = {c: i for i, c in enumerate(cols)}
        pairs = [(idx[f], idx[t]) for f in features for t in targets]
        names = ("feature", "target")
    else:
        cols = features
        pairs = [(a, b) for a in range(len(cols)) for b in range(a + 1, len(cols))]
        names = ("feature_a", "feature_b")
    mom = pair_moments(df, cols, pairs)
    lut = spark.createDataFrame([(i, c) for i, c in enumerate(cols)], "k int, name string")
    out = (mom.join(F.broadcast(lut.withColumnRenamed("k", "i").withColumnRenamed("name", names[0])), "i")
              .join(F.broadcast(lut.withColumnRenamed("k", "j").withColumnRenamed("name", names[1])), "j"))
    return out.select(names[0], names[1], stable_round(_r_from_moments(), digits).alias("r"),
                      F.col("n").cast("long").alias("n"))


def top_k(corr: DataFrame, k: int = 5, group: str = "target", item: str = "feature") -> DataFrame:
    """K largest |r| per target (NULL r excluded; ties by item name)."""
    c = corr.where(F.col("r").isNotNull()).withColumn("_abs", F.abs("r"))
    top = top_n_per_group(c, group, [F.desc("_abs"), F.col(item)], k, rank_col="rank")
    return top.select(group, "rank", item, "r")


# ----------------------------------------------------------------------------- collinearity

_DIST_SCALE = 10 ** 12


def average_linkage_merges(pairs: DataFrame, features, cut: float | None = None) -> DataFrame:
    """M4: the dendrogram of average linkage on d = 1 - |r| (NULL r or no pair -> d = 1) as a merge table.

    pairs: (feature_a, feature_b, r) for unordered pairs.  One row per merge: (a, b, height, size)
    with a < b the smallest feature indices of the two clusters, the average distance between them
    and the number of features of the union, which goes on as ``a``.  Merges above ``cut`` are left
    out; without it there are p - 1 rows.

    Each round merges every reciprocal-nearest pair of clusters, which for average linkage (it is
    reducible) is what the chains of nearest neighbours end in; equal distances go to the smaller
    index.  The table of cluster pairs carries sums of distances in units of 1e-12, so that
    averages do not depend on the order of summation, and shrinks from round to round.
    """
    spark = pairs.sparkSession
    idx = spark.createDataFrame([(i, f) for i, f in enumerate(features)], "k int, feature string")
    second = F.broadcast(idx.select(F.col("k").alias("y"), F.col("feature").alias("feature_y")))
    given = pairs.select(F.least("feature_a", "feature_b").alias("fa"), F.greatest("feature_a", "feature_b").alias("fb"), "r")
    every = idx.select(F.col("k").alias("x"), F.col("feature").alias("feature_x"), F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))).alias("y")) \
        .where("x < y").join(second, "y")
    every = every.select("x", "y", F.least("feature_x", "feature_y").alias("fa"), F.greatest("feature_x", "feature_y").alias("fb"))
    near = F.least(F.greatest(1 - F.abs(F.coalesce("r", F.lit(0.0))), F.lit(0.0)), F.lit(1.0))
    apart = cut_lineage(every.join(given, ["fa", "fb"], "left").select(
        "x", "y", F.round(near * _DIST_SCALE).cast("long").alias("total"), F.lit(1).cast("long").alias("n")))
    size = cut_lineage(idx.select(F.col("k").alias("c"), F.lit(1).cast("long").alias("size")))
    merges = None
    while True:
        both = apart.unionByName(apart.select(F.col("y").alias("x"), F.col("x").alias("y"), "total", "n"))
        nearest = both.groupBy("x").agg(F.min(F.struct((F.col("total") / F.col("n") / _DIST_SCALE).alias("height"), "y")).alias("best")).select("x", "best.*")
        found = nearest.alias("l").join(nearest.alias("r"), (F.col("l.y") == F.col("r.x")) & (F.col("r.y") == F.col("l.x"))) \
            .where("l.x < l.y").select(F.col("l.x").alias("a"), F.col("l.y").alias("b"), F.col("l.height").alias("height"))
        if cut is not None:
            found = found.where(F.col("height") <= cut)
        found = found.join(size.select(F.col("c").alias("a"), F.col("size").alias("size_a")), "a").join(size.select(F.col("c").alias("b"), F.col("size").alias("size_b")), "b")
        found = cut_lineage(found.select("a", "b", "height", (F.col("size_a") + F.col("size_b")).alias("size")))
        merges = found if merges is None else merges.unionByName(found)
        if found.isEmpty():
            return merges
        joined = F.broadcast(found.select(F.col("b").alias("old"), F.col("a").alias("new")))  # at most half of the features
        moved = apart.join(joined, F.col("x") == F.col("old"), "left").withColumn("x", F.coalesce("new", "x")).drop("old", "new") \
            .join(joined, F.col("y") == F.col("old"), "left").withColumn("y", F.coalesce("new", "y")).where("x <> y")
        apart = cut_lineage(moved.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.sum("total").alias("total"), F.sum("n").alias("n")))
        size = cut_lineage(size.join(F.broadcast(found.select(F.col("b").alias("c"))), "c", "anti")
                           .join(F.broadcast(found.select(F.col("a").alias("c"), F.col("size").alias("_grown"))), "c", "left")
                           .select("c", F.coalesce("_grown", "size").alias("size")))


def cut_merges(merges: DataFrame, features, cut: float = domain.COLLINEARITY_CUT) -> DataFrame:
    """M4: flat clusters of a merge table at distance ``cut``: (feature, cluster), cluster = smallest
    feature index in it.  Heights never fall along a cluster's merges, so following the merges up
    to ``cut`` gives the clusters at any height."""
    spark = merges.sparkSession
    idx = spark.createDataFrame([(i, f) for i, f in enumerate(features)], "k int, feature string")
    up = close_edges(merges.where(F.col("height") <= cut), "b", "a").select(F.col("old_code").alias("k"), F.col("new_code").alias("top"))
    return idx.join(up, "k", "left").select("feature", F.coalesce("top", "k").alias("cluster"))


def average_linkage_clusters(pairs: DataFrame, features, cut: float = domain.COLLINEARITY_CUT) -> DataFrame:
    """M4: (feature, cluster): the merge table up to ``cut``, cut there."""
    return cut_merges(average_linkage_merges(pairs, features, cut), features, cut)


def prune_collinear(clusters: DataFrame, rules=domain.PRIORITY_PREFIXES,
                    default_priority: int = domain.DEFAULT_PRIORITY) -> DataFrame:
    """M4 + W5 + C28: keep, per cluster, the feature with the best (lowest)
    priority, then the first name.  Returns (feature, cluster, priority, kept)."""
    c = clusters.withColumn("priority", priority_from_prefix("feature", rules, default_priority))
    best = c.groupBy("cluster").agg(F.min(F.struct("priority", "feature")).alias("_b"))
    return (c.join(best, "cluster")
             .withColumn("kept", F.col("feature") == F.col("_b.feature")).drop("_b")
             .select("feature", "cluster", "priority", "kept"))
