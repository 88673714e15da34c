"""The schema object: load order, DDL and checks derived from the same data."""

import duckdb
import pytest

from tessera.operators.schema import Field, Schema, Table

PARENT = Table("parent", (Field("code", "VARCHAR(3)", False), Field("label", "VARCHAR(5)", False)), ("code",))
CHILD = Table("child", (Field("id", "INTEGER", False), Field("code", "VARCHAR(3)", False, None, ("parent", "code")), Field("rate", "DECIMAL(6,2)"),
                        Field("n", "INTEGER", False, "0"), Field("day", "DATE")), ("id",), (("code", "day"),))


def test_order_cycles_and_unknown_references():
    assert Schema([CHILD, PARENT]).load_order() == ["parent", "child"]
    a = Table("a", (Field("i", "INTEGER", False), Field("b", "INTEGER", True, None, ("b", "i"))), ("i",))
    b = Table("b", (Field("i", "INTEGER", False), Field("a", "INTEGER", True, None, ("a", "i"))), ("i",))
    with pytest.raises(ValueError, match="cycle: a, b"):
        Schema([a, b])
    with pytest.raises(ValueError, match="references parent.code"):
        Schema([CHILD])
    tree = Table("tree", (Field("i", "INTEGER", False), Field("up", "INTEGER", True, None, ("tree", "i"))), ("i",))
    assert Schema([tree]).load_order() == ["tree"]
    with pytest.raises(ValueError, match="unknown type"):
        Field("x", "BLOB")


def test_violations(spark):
    parent = spark.createDataFrame([("a", "one"), ("b", "longer"), ("b", None), (None, "x")], "code string, label string")
    rows = [(1, "a", 9999.99, 1, "2020-01-01"), (2, "z", 9999.996, 2, "2020-01-01"), (2, "a", -10000.0, 1 << 31, "2020-01-01"),
            (3, None, float("nan"), None, "no day"), (4, "a", float("inf"), 0, None), (5, "a", 9999.994, 5, None)]
    child = spark.createDataFrame(rows, "id int, code string, rate double, n long, day string")
    got = {r["constraint_name"]: r["violations"] for r in Schema([CHILD, PARENT]).violations({"parent": parent, "child": child}).collect()}
    assert got == {"pk_parent": 2, "length_parent_code": 0, "nn_parent_label": 1, "length_parent_label": 1, "pk_child": 1, "nn_child_code": 1,
                   "length_child_code": 0, "range_child_rate": 2, "nn_child_n": 1, "range_child_n": 1, "date_child_day": 1,
                   "unique_child_code_day": 1, "fk_child_code": 1}
    clean = {r["constraint_name"]: r["violations"] for r in
             Schema([CHILD, PARENT]).violations({"parent": parent.where("false"), "child": child.where("false")}).collect()}
    assert clean.keys() == got.keys() and not any(clean.values())
    with pytest.raises(ValueError, match="child lacks n, day"):
        Schema([CHILD, PARENT]).violations({"parent": parent, "child": child.drop("n", "day")})


def test_ddl_is_enforced_alike():
    con = duckdb.connect()
    con.execute(Schema([CHILD, PARENT]).ddl())
    con.execute("INSERT INTO parent VALUES ('a', 'one')")
    con.execute("INSERT INTO child (id, code, rate, day) VALUES (1, 'a', 9999.99, '2020-01-01')")
    assert con.execute("SELECT n FROM child").fetchall() == [(0,)]
    for bad in ("(1, 'a', 1, 0, NULL)", "(2, 'z', 1, 0, NULL)", "(3, 'a', 9999.996, 0, NULL)", "(4, 'a', 1, NULL, NULL)", "(5, 'a', 1, 0, 'no day')",
                "(6, 'a', 1, 0, '2020-01-01')", "(7, NULL, 1, 0, NULL)", "(8, 'a', 1, 2147483648, NULL)"):
        with pytest.raises(duckdb.Error):
            con.execute(f"INSERT INTO child VALUES {bad}")
