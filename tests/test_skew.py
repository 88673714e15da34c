"""Skewed inputs (one key holds a third of the rows): results must equal a
pandas brute force, including the sort-based quantile path."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators.codes import first_per_key, harmonize
from tessera.operators.joins import top_n_per_group
from tessera.operators.quantiles import exact_quantiles
from tessera.operators.rollup import conditional_share, sum_measures


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(9)
    n = 30000
    keys = np.where(rng.random(n) < 1 / 3, "HOT", np.char.add("k", rng.integers(0, 500, n).astype(str)))
    pdf = pd.DataFrame({"k": keys, "v": rng.normal(100, 30, n).round(4), "f": rng.integers(0, 2, n),
                        "id": np.arange(n)})
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_quantiles_sort_path_hot_group(skewed):
    pdf, df = skewed
    got = {(r["k"], r["q"]): r["value"] for r in
           exact_quantiles(df, ["k"], "v", [0.1, 0.5, 0.9]).collect()}
    ref = pdf.groupby("k")["v"].quantile([0.1, 0.5, 0.9])
    for (k, p), val in ref.items():
        assert got[(k, [0.1, 0.5, 0.9].index(p))] == pytest.approx(val, abs=1e-9)


def test_quantiles_hot_value(spark):
    """One value in 90 % of the rows is one counted row, whatever the partition."""
    df = spark.range(20000).selectExpr("cast(null as string) as k", "if(id % 10 > 0, 5.0, id / 7.0) as v")
    got = [r["value"] for r in exact_quantiles(df, ["k"], "v", [0.0, 0.05, 0.5, 1.0]).orderBy("q").collect()]
    assert got == pytest.approx(df.agg(F.percentile("v", [0.0, 0.05, 0.5, 1.0])).first()[0])


def test_sums_and_share_hot_key(skewed):
    pdf, df = skewed
    s = {r["k"]: r["v"] for r in sum_measures(df, ["k"], ["v"]).collect()}
    assert s["HOT"] == pytest.approx(pdf[pdf.k == "HOT"].v.sum())
    sh = {r["k"]: r["pct"] for r in conditional_share(df, ["k"], "v", F.col("f") == 1).collect()}
    hot = pdf[pdf.k == "HOT"]
    assert sh["HOT"] == pytest.approx(round(hot[hot.f == 1].v.sum() / hot.v.sum() * 100, 2), abs=0.011)


def test_first_and_top_n_hot_key(skewed):
    pdf, df = skewed
    first = {r["k"]: r["id"] for r in first_per_key(df, "k", ["v", "id"]).collect()}
    ref = pdf.sort_values(["v", "id"]).groupby("k").head(1).set_index("k")["id"].to_dict()
    assert first == ref
    top = sorted(r["id"] for r in top_n_per_group(df.where("k = 'HOT'"), "k", ["v", "id"], 5).collect())
    assert top == sorted(pdf[pdf.k == "HOT"].sort_values(["v", "id"]).head(5).id.tolist())


def test_harmonize_hot_code(spark, skewed):
    _, df = skewed
    cmap = spark.createDataFrame([("HOT", "MERGED")], "old_code string, new_code string")
    out = harmonize(df, "k", cmap).groupBy("k").count()
    got = {r["k"]: r["count"] for r in out.collect()}
    assert "HOT" not in got and got["MERGED"] > 9000
