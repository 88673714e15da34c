"""Every bound query against its DuckDB oracle on the smallest driver tables,
plus the entry-point contract.  Queries without an oracle must run and be
non-empty where the data allows."""

import pytest

from tests.conftest import SF_SMALL
from tests.oracle_check import compare, duck

import __spark_entry__ as entry_mod
from tessera.plans import REGISTRY

SLOW = {"model_compare", "permutation_importance"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.oracle])
def test_oracle(spark, con, name):
    q = REGISTRY[name]
    r = compare(spark, con, name, q.build, q.oracle, SF_SMALL)
    assert r["cols_match"], r
    assert r["rows_match"], r


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if not q.oracle and n not in SLOW])
def test_rows_only(spark, name):
    df = REGISTRY[name].build(spark, SF_SMALL)
    assert df.count() >= 0
    assert len(df.columns) > 0


def test_entry_contract(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    qs, ors = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(ors) <= set(qs)
    assert len(qs) >= 40


def test_model_compare_shape(spark):
    """3 families x 3 targets, finite scores, exactly one best family."""
    rows = REGISTRY["model_compare"].build(spark, SF_SMALL).collect()
    assert len(rows) == 9
    assert {r["modele"] for r in rows} == {"Ridge", "Random Forest", "Gradient Boosting"}
    assert all(r["r2"] is not None and r["r2"] <= 1 and r["mae"] >= 0 for r in rows)
    assert len({r["modele"] for r in rows if r["best"]}) == 1
