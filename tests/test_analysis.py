"""Quantiles, surrogate ids, correlation, clustering, imputation and ridge: independent numpy checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.export import exact_pct, surrogate_ids
from tessera.operators.impute import bayesian_ridge_from_moments, chained_impute, group_median_impute
from tessera.operators.profile import average_linkage_clusters, average_linkage_merges, column_profile, correlations, cut_merges
from tessera.operators.quantiles import exact_quantiles


def test_exact_quantiles_sort_path_equals_percentile(spark):
    rng = np.random.default_rng(1)
    rows = [(["a", "b", None][i % 3], float(v)) for i, v in enumerate(rng.normal(size=500).round(3))]
    rows += [("a", float("nan")), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.1, 0.5, 0.9]
    mine = {(r["g"], r["q"]): r["value"] for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    ref = df.where(~F.isnan("v")).groupBy("g").agg(F.percentile("v", probs).alias("p")).collect()
    for r in ref:
        for i, p in enumerate(r["p"]):
            assert mine[(r["g"], i)] == pytest.approx(p, abs=1e-12)


def test_surrogate_ids_dense_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = sorted((r["k"], r["id"]) for r in surrogate_ids(df, ["k"], num_partitions=7).collect())
    assert [i for _, i in got] == list(range(1, 1001))


def test_exact_pct(spark):
    df = spark.createDataFrame([(1, 8), (5, 0), (None, 3), (1, 3)], "v long, e long")
    got = [r["p"] for r in df.select(exact_pct("v", "e").alias("p")).collect()]
    assert got == [12.5, None, 0.0, 33.33]


def test_pairwise_correlation_matches_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 4))
    x[:, 1] += 0.8 * x[:, 0]
    x[rng.random((300, 4)) < 0.2] = np.nan
    x[:, 3] = 1.0
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x],
                               ", ".join(f"{c} double" for c in cols))
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in correlations(df, cols).collect()}
    for i in range(4):
        for j in range(i + 1, 4):
            m = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[m, i], x[m, j]
            if a.std() == 0 or b.std() == 0:
                assert got[(cols[i], cols[j])] is None
            else:
                assert got[(cols[i], cols[j])] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=2e-6)


def _upgma_flat(d, cut):
    """Plain sequential average linkage (reference algorithm) -> flat clusters at ``cut``."""
    clusters = {i: [i] for i in range(len(d))}
    while len(clusters) > 1:
        best = None
        keys = sorted(clusters)
        for ai, a in enumerate(keys):
            for b in keys[ai + 1:]:
                dd = np.mean([d[p][q] for p in clusters[a] for q in clusters[b]])
                if best is None or dd < best[0]:
                    best = (dd, a, b)
        if best[0] > cut:
            break
        _, a, b = best
        clusters[min(a, b)] = clusters.pop(a) + clusters.pop(b) if a != min(a, b) else clusters[a] + clusters.pop(b)
    return sorted(sorted(v) for v in clusters.values())


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_average_linkage_matches_sequential(spark, seed):
    rng = np.random.default_rng(seed)
    p = 7
    base = rng.normal(size=(200, 3))
    x = np.column_stack([base[:, i % 3] + rng.normal(scale=s, size=200) for i, s in
                         zip(range(p), rng.uniform(0.05, 0.9, p))])
    r = np.corrcoef(x.T)
    names = [f"f{i}" for i in range(p)]
    pairs = spark.createDataFrame([(names[i], names[j], float(r[i, j])) for i in range(p) for j in range(i + 1, p)],
                                  "feature_a string, feature_b string, r double")
    got = {}
    for row in average_linkage_clusters(pairs, names, cut=0.15).collect():
        got.setdefault(row["cluster"], []).append(int(row["feature"][1:]))
    mine = sorted(sorted(v) for v in got.values())
    assert mine == _upgma_flat(1 - np.abs(r), 0.15)


def _sequential_merges(d):
    """(a, b, height, size): the closest pair of clusters, the smallest indices among equals, until one is left."""
    clusters, out = {i: [i] for i in range(len(d))}, []
    while len(clusters) > 1:
        h, a, b = min((round(sum(round(d[p][q] * 1e12) for p in clusters[a] for q in clusters[b]) / len(clusters[a]) / len(clusters[b]) / 1e12, 12), a, b)
                      for a in clusters for b in clusters if a < b)
        clusters[a] += clusters.pop(b)
        out.append((a, b, h, len(clusters[a])))
    return out


@pytest.mark.parametrize("seed,levels", [(0, 1000), (1, 4), (2, 2)])
def test_merge_table_with_ties(spark, seed, levels):
    """The dendrogram equals sequential merging, ties and missing pairs included, and its cuts equal flat clustering."""
    rng = np.random.default_rng(seed)
    p = 12
    r = np.round(rng.uniform(0, 1, (p, p)) * levels) / levels
    r = np.triu(r, 1) + np.triu(r, 1).T
    r[0, 5] = r[5, 0] = 0.0
    names = [f"f{i}" for i in range(p)]
    rows = [(names[j], names[i], None if (i, j) == (0, 5) and seed else float(r[i, j])) for i in range(p) for j in range(i + 1, p) if (i, j) != (0, 5) or seed]
    merges = average_linkage_merges(spark.createDataFrame(rows, "feature_a string, feature_b string, r double"), names)
    got = sorted((m["height"], m["a"], m["b"], m["size"]) for m in merges.collect())
    want = sorted((h, a, b, n) for a, b, h, n in _sequential_merges(1 - r))
    assert len(got) == p - 1
    np.testing.assert_allclose([m[0] for m in got], [m[0] for m in want], atol=1e-11)
    for cut in (0.2, 0.55):
        flat = {}
        for row in cut_merges(merges, names, cut).collect():
            flat.setdefault(row["cluster"], []).append(int(row["feature"][1:]))
        assert all(c == min(members) for c, members in flat.items())
        if levels > 10:  # without ties the clusters are unique
            assert sorted(map(sorted, flat.values())) == _upgma_flat(1 - r, cut)


def test_column_profile_skew_and_status(spark):
    df = spark.createDataFrame([(1.0, "2017"), (2.0, "2017"), (10.0, "2022"), (None, "2022")], "x double, annee string")
    r = column_profile(df, ["x"], "annee", ["2017", "2022"]).first()
    assert r["skewness"] == pytest.approx(0.675, abs=1e-3)
    assert (r["nan_pct"], r["nan_pct_2017"], r["nan_pct_2022"]) == (25.0, 0.0, 50.0)
    assert r["statut"] == "ok"


def test_group_median_impute(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", None), (None, None), ("c", 10.0)],
                               "g string, v double")
    got = [r["v"] for r in group_median_impute(df, ["v"], ["g"]).orderBy(F.col("g").asc_nulls_first(), "v").collect()]
    # global median of {1, 3, 10} = 3 for the NULL key and for group b (all NULL)
    assert sorted(got) == sorted([3.0, 1.0, 2.0, 3.0, 3.0, 10.0])


def _bayes_ridge_direct(x, y, iters=300):
    xm, ym = x.mean(0), y.mean()
    xc, yc = x - xm, y - ym
    u, s, vt = np.linalg.svd(xc, full_matrices=False)
    ev = s ** 2
    alpha, lam = 1.0 / (np.var(yc) + np.finfo(float).eps), 1.0
    xty = xc.T @ yc
    old = None
    for _ in range(iters):
        coef = vt.T @ ((vt @ xty) / (ev + lam / alpha))
        rss = np.sum((yc - xc @ coef) ** 2)
        gamma = np.sum(alpha * ev / (lam + alpha * ev))
        lam = (gamma + 2e-6) / (np.sum(coef ** 2) + 2e-6)
        alpha = (len(y) - gamma + 2e-6) / (rss + 2e-6)
        if old is not None and np.sum(np.abs(old - coef)) < 1e-3:
            break
        old = coef
    coef = vt.T @ ((vt @ xty) / (ev + lam / alpha))
    return coef, ym - xm @ coef


def test_bayesian_ridge_from_moments_matches_data_form():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    y = x @ np.array([1.0, -2.0, 0.5, 0.0]) + rng.normal(scale=0.3, size=400) + 4
    coef, icpt = bayesian_ridge_from_moments(400.0, x.sum(0), y.sum(), x.T @ x, x.T @ y, y @ y)
    c2, i2 = _bayes_ridge_direct(x, y)
    assert np.allclose(coef, c2, atol=1e-8) and icpt == pytest.approx(i2, abs=1e-8)


@pytest.mark.parametrize("rounding", [0.0, 2e-16, 6e-16])
def test_bayesian_ridge_of_equal_columns_shares_the_weight(rounding):
    """Many rows, two equal columns of large values: what rounding leaves of their difference has no say."""
    rng = np.random.default_rng(3)
    a, b = rng.uniform(1e3, 1e5, 2000), rng.normal(0, 0.02, 2000)
    y = 0.05 + 2 * b + rng.normal(0, 0.01, 2000)
    x = np.column_stack((a, b, a, np.full(2000, 0.1)))
    xtx, xty = 20_000 * (x.T @ x), 20_000 * (x.T @ y)
    xtx[0, 2] = xtx[2, 0] = xtx[0, 0] * (1 + rounding)
    xty[2] *= 1 + rounding
    coef, icpt = bayesian_ridge_from_moments(4e7, 20_000 * x.sum(0), 20_000 * y.sum(), xtx, xty, 20_000 * (y @ y))
    assert coef[1] == pytest.approx(2, abs=0.05) and icpt == pytest.approx(0.05, abs=0.005)
    assert abs(coef[0]) < 1e-7 and abs(coef[2]) < 1e-7 and coef[3] == 0


def test_chained_impute_fills_everything(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=200)
    b = 2 * a + rng.normal(scale=0.1, size=200)
    rows = [(float(x), None if i % 5 == 0 else float(y)) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double")
    out = chained_impute(df, ["a", "b"]).collect()
    assert all(r["b"] is not None for r in out)
    err = [abs(r["b"] - 2 * r["a"]) for i, r in enumerate(out)]
    assert np.median(err) < 0.3


def test_spark_ridge_equals_closed_form(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    rng = np.random.default_rng(11)
    n = 200
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.2]
    y = x @ [0.5, -0.1, 3.0] + rng.normal(size=n)
    df = spark.createDataFrame([tuple(map(float, list(r) + [t])) for r, t in zip(x, y)], "a double, b double, c double, y double")
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    sy = y.std()
    m = LinearRegression(labelCol="y", elasticNetParam=0.0, regParam=1.0 * sy / n, standardization=True,
                         solver="normal").fit(df)
    xs = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(xs.T @ xs + 1.0 * np.eye(3), xs.T @ (y - y.mean()))
    assert np.allclose(np.array(m.coefficients) * x.std(0), w, atol=1e-6)


def test_top_n_per_group_skewed(spark):
    from pyspark.sql.window import Window
    from tessera.operators.joins import top_n_per_group
    df = spark.range(0, 5000).select((F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise(
        (F.col("id") % 10).cast("string"))).alias("g"), ((F.col("id") * 7919) % 5003).alias("v"))
    got = sorted((r["g"], r["rank"], r["v"]) for r in top_n_per_group(df, "g", ["v"], 3, rank_col="rank").collect())
    w = Window.partitionBy("g").orderBy("v")
    ref = sorted((r["g"], r["rank"], r["v"]) for r in
                 df.withColumn("rank", F.row_number().over(w)).where("rank <= 3").collect())
    assert got == ref
