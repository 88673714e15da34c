"""Compare bound Spark queries with their DuckDB oracles (same rule as the driver:
columns sorted by name, row multiset equality).  Usable from pytest and as a CLI:

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.plans.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v) for v in rec))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, name: str, build, sql: str, sf_dir: str) -> dict:
    t0 = time.time()
    sdf = build(spark, sf_dir)
    sp = sdf.toPandas()
    t1 = time.time()
    dk = con.execute(sql).df()
    scols, srows = _rows(sp)
    dcols, drows = _rows(dk)
    res = {"query": name, "spark_rows": len(sp), "oracle_rows": len(dk), "cols_match": scols == dcols,
           "rows_match": srows == drows, "spark_sec": round(t1 - t0, 2)}
    if scols != dcols:
        res["spark_cols"] = scols
        res["oracle_cols"] = dcols
    elif srows != drows:
        bad = [(a, b) for a, b in zip(srows, drows) if a != b][:3]
        res["first_diffs"] = bad
        res["spark_types"] = [str(t) for t in sp[scols].dtypes]
        res["oracle_types"] = [str(t) for t in dk[dcols].dtypes]
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from tessera.plans import REGISTRY
    from tessera.session import build_session
    spark = build_session(os.environ.get("TESSERA_MASTER", "local[8]"),
                          shuffle_partitions=int(os.environ.get("TESSERA_SHUFFLE", "8")))
    con = duck(sf_dir)
    ok = True
    for name, q in REGISTRY.items():
        if names and name not in names:
            continue
        if not q.oracle:
            t0 = time.time()
            n = q.build(spark, sf_dir).count()
            print({"query": name, "rows_only": n, "spark_sec": round(time.time() - t0, 2)}, flush=True)
            continue
        try:
            r = compare(spark, con, name, q.build, q.oracle, sf_dir)
        except Exception as e:  # report and continue
            r = {"query": name, "error": repr(e)[:1500]}
        ok &= bool(r.get("rows_match"))
        print(r, flush=True)
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv))
