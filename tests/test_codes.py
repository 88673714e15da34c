"""Merge history and harmonisation: the reference's unit cases plus cycles and duplicates."""

import pytest

from tessera.operators.codes import close_edges, first_per_key, harmonize, merge_history_map

MVT = "MOD int, DATE_EFF string, TYPECOM_AV string, TYPECOM_AP string, COM_AV string, COM_AP string"


def as_map(df):
    return {r["old_code"]: r["new_code"] for r in df.collect()}


def test_chain_is_closed(spark):
    mvt = spark.createDataFrame([(32, "2019-01-01", "COM", "COM", "11001", "11002"),
                                 (32, "2020-01-01", "COM", "COM", "11002", "11003")], MVT)
    m = as_map(merge_history_map(mvt))
    assert m["11001"] == "11003" and m["11002"] == "11003"


def test_pre_2016_and_other_kinds_excluded(spark):
    mvt = spark.createDataFrame([(32, "2015-06-01", "COM", "COM", "22001", "22002"),
                                 (10, "2019-01-01", "COM", "COM", "33001", "33002"),
                                 (31, "2019-01-01", "COMD", "COM", "44001", "44002"),
                                 (31, "2019-01-01", "COM", "COM", "01001", "01002")], MVT)
    assert as_map(merge_history_map(mvt)) == {"01001": "01002"}


def test_duplicate_old_code_latest_wins(spark):
    mvt = spark.createDataFrame([(31, "2017-01-01", "COM", "COM", "50001", "50002"),
                                 (31, "2019-01-01", "COM", "COM", "50001", "50009")], MVT)
    assert as_map(merge_history_map(mvt)) == {"50001": "50009"}


def test_cycle_maps_to_minimum(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("D", "A")], "old_code string, new_code string")
    m = as_map(close_edges(e))
    assert m == {"A": "A", "B": "A", "C": "A", "D": "A"}


@pytest.mark.parametrize("size", [2, 4, 6, 7])
def test_cycles_and_tails(spark, size):
    cycle = [(f"c{i}", f"c{(i + 1) % size}") for i in range(size)]
    tails = [("a0", "a1"), ("a1", f"c{size - 1}"), ("b0", "c1"), ("x", "y"), ("y", "z")]
    e = spark.createDataFrame(cycle + tails, "old_code string, new_code string")
    m = as_map(close_edges(e))
    assert m == {f"c{i}": "c0" for i in range(size)} | {"a0": "c0", "a1": "c0", "b0": "c0", "x": "z", "y": "z"}


def test_long_chain_pointer_doubling(spark):
    e = spark.createDataFrame([(str(i), str(i + 1)) for i in range(150)], "old_code string, new_code string")
    m = as_map(close_edges(e))
    assert set(m.values()) == {"150"} and len(m) == 150


def test_harmonize(spark):
    codes = spark.createDataFrame([("01001",), ("ZZ999",), ("97100",), (" 75001 ",), ("11001",), (None,)], "CODGEO string")
    cmap = spark.createDataFrame([("11001", "11003")], "old_code string, new_code string")
    got = sorted(r["CODGEO"] for r in harmonize(codes, "CODGEO", cmap).collect())
    assert got == ["01001", "11003", "75001"]


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    got = {r["k"]: r["v"] for r in first_per_key(df, "k", ["o"]).collect()}
    assert got == {"a": "y", "b": "z"}
