"""Smaller library functions: join duplicate policies, size-checked broadcast,
schema helpers, target recomputation, log swap, summaries."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.features import recompute_targets
from tessera.operators.joins import duplicate_keys, enrich
from tessera.operators.model import top_importances
from tessera.operators.quality import complete_enough, distinct_sorted, residual_string_columns
from tessera.operators.reshape import optional_col, ordered_unique, select_existing
from tessera.operators.select import apply_log_gate
from tessera.sources.manifest import stage_summary


def test_enrich_duplicate_policies(spark):
    base = spark.createDataFrame([("a",), ("b",)], "k string")
    right = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "k string, v int")
    assert enrich(base, [(right, ["k"])]).count() == 3                       # keep: fans out
    first = {r["k"]: r["v"] for r in enrich(base, [(right, ["k"], ["v"])], on_duplicate="first").collect()}
    assert first == {"a": 1, "b": 5}
    with pytest.raises(ValueError):
        enrich(base, [(right, ["k"])], on_duplicate="error")
    assert [r["k"] for r in duplicate_keys(right, "k").collect()] == ["a"]


def test_schema_helpers(spark):
    df = spark.createDataFrame([("01001", 1.0, "x", 2.0)], "CODGEO string, P_POP double, lib string, BPE_A double")
    sel, missing = select_existing(df, ["CODGEO", "P_POP", "P_MEN"], prefixes=["BPE_"])
    assert sel.columns == ["CODGEO", "P_POP", "BPE_A"] and missing == ["P_MEN"]
    assert df.select(optional_col(df, "absent").alias("z")).first()["z"] is None
    assert residual_string_columns(df, allowed=["CODGEO"]) == ["lib"]
    assert ordered_unique(["a", "b", "a", "c", "b"]) == ["a", "b", "c"]
    assert complete_enough(spark.createDataFrame([(1.0, None), (2.0, None), (None, 3.0)], "a double, b double"),
                           ["a", "b"]) == ["a"]


def test_recompute_targets(spark):
    df = spark.createDataFrame([(30, 70, 100)], "ecologisme long, souverainisme long, exprimes long")
    out = recompute_targets(df, families=("ecologisme", "souverainisme"))
    r = out.first()
    assert (r["pct_ecologisme"], r["pct_souverainisme"]) == (30.0, 70.0)
    with pytest.raises(ValueError):
        recompute_targets(df, families=("ecologisme", "droite_nationale"))


def test_apply_log_gate_and_summaries(spark):
    df = spark.createDataFrame([(1.0, 9.0), (3.0, 99.0)], "a double, b double")
    out = apply_log_gate(df, [{"feature": "b", "transformed": True}, {"feature": "a", "transformed": False}])
    assert out.columns == ["a", "log1p_b"]
    assert out.first()["log1p_b"] == pytest.approx(2.302585, abs=1e-6)
    assert [r["a"] for r in distinct_sorted(spark.createDataFrame([(3,), (1,), (3,), (None,)], "a int"), "a").collect()] == [1, 3]
    imp = spark.createDataFrame([("x", 0.1), ("y", 0.5), ("z", 0.3)], "feature string, importance double")
    assert [r["feature"] for r in top_importances(imp, 2).collect()] == ["y", "z"]
    summ = stage_summary(spark, "/root/testdata/sf0.001").first()
    assert summ["n_files"] == 14 and summ["total_mb"] > 0
