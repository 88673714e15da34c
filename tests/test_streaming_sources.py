"""Incremental staging, file inventory / manifest, delimited sources and sinks."""

import os
import shutil
import subprocess
import sys
import tempfile

from pyspark.sql import functions as F

from tessera.sources import files as S
from tessera.sources import manifest as M
from tessera.sources.sinks import insert_statements, write_sql_script
from tessera.streaming.incremental import stage_new_files


def test_incremental_staging_skips_processed_files(spark):
    src = "/root/testdata/sf0.001/region*.parquet"
    schema = spark.read.parquet("/root/testdata/sf0.001/region.parquet").schema
    out = tempfile.mkdtemp(prefix="tessera-stage-", dir="/tmp")
    first = stage_new_files(spark, src, out + "/rows", schema, out + "/checkpoint")
    second = stage_new_files(spark, src, out + "/rows", schema, out + "/checkpoint")
    assert first == 5 and second == 0
    assert spark.read.parquet(out + "/rows").count() == 5


def test_incremental_staging_in_a_second_application(spark):
    """The checkpoint is the named folder, so another application stages only what is new."""
    d = tempfile.mkdtemp(prefix="tessera-stage2-", dir="/tmp")
    shutil.copytree("/root/testdata/sf0.001", d + "/in", ignore=lambda _, names: [n for n in names if n != "region.parquet"])
    code = ("import sys; from tessera.session import build_session; from tessera.streaming.incremental import stage_new_files as s;"
            "spark = build_session('local[2]', 2); d = sys.argv[1];"
            "print('staged', s(spark, d + '/in/*.parquet', d + '/rows', spark.read.parquet(d + '/in/region.parquet').schema, d + '/checkpoint'))")
    said = []
    for _ in range(2):
        said.append(subprocess.run([sys.executable, "-c", code, d], capture_output=True, text=True, timeout=300,
                                   cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).stdout.split()[-2:])
    assert said == [["staged", "5"], ["staged", "0"]]
    assert spark.read.parquet(d + "/rows").count() == 5


def test_parts_with_other_column_order_are_read_by_name(spark):
    d = tempfile.mkdtemp(prefix="tessera-parts-", dir="/tmp")
    for name, text in (("a.csv", "k;v\nx;1\n"), ("b.csv", "v;k\n2;y\n"), ("c.csv", '﻿"k";w\n"z ""q"" ; z";3\n')):
        with open(f"{d}/{name}", "w") as fh:
            fh.write(text)
    df = S.read_delimited(spark, d)
    assert df.columns == ["k", "v", "w"]
    assert sorted(map(tuple, df.collect())) == [("x", "1", None), ("y", "2", None), ('z "q" ; z', None, "3")]


def test_manifest_status(spark):
    files = M.inventory(spark, "/root/testdata/sf0.001", "*.parquet")
    same = M.manifest_status(files, files)
    assert {r["status"] for r in same.collect()} == {"ok"}
    other = M.inventory(spark, "/root/testdata/sf0.01", "*.parquet")
    st = {r["name"]: r["status"] for r in M.manifest_status(files, other.where(F.col("name") != "pages.parquet")).collect()}
    assert st["pages.parquet"] == "new" and st["lineitem.parquet"] == "mismatch"
    acct = {r["status"]: r["n_files"] for r in M.load_accounting(M.manifest_status(files, other)).collect()}
    assert sum(acct.values()) == 14


def test_delimited_all_string_and_snapshot(spark):
    d = tempfile.mkdtemp(prefix="tessera-csv-", dir="/tmp")
    for snap, rows in (("2023", ["01001;s;1,5"]), ("2024", ["01001;18500;2,5", "2A004;s;3"])):
        os.makedirs(f"{d}/v{snap}")
        with open(f"{d}/v{snap}/part.csv", "w") as fh:
            fh.write("CODGEO;MED21;X\n" + "\n".join(rows) + "\n")
    df = S.read_delimited(spark, f"{d}/v*/part.csv", sep=";")
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["string"] * 3
    last = S.latest_snapshot(df, r"/v(\d{4})/")
    assert sorted(r["CODGEO"] for r in last.collect()) == ["01001", "2A004"]
    assert S.header(spark, f"{d}/v2024/part.csv") == ["CODGEO", "MED21", "X"]


def test_sheet_export_and_fallback(spark):
    d = tempfile.mkdtemp(prefix="tessera-sheet-", dir="/tmp")
    with open(f"{d}/sheet.csv", "w") as fh:
        fh.write("Title;;\nSource;;\n;;\nNote;;\nCODGEO;DENS;DENS7\n01001;1;2\n;3;4\n75056;5;6\n")
    df = S.read_sheet_export(spark, f"{d}/sheet.csv", "CODGEO")
    assert sorted(r["CODGEO"] for r in df.collect()) == ["01001", "75056"]
    got, used = S.read_with_fallback(spark, f"{d}/missing.parquet", "/root/testdata/sf0.001/region.parquet")
    assert used.endswith("region.parquet") and got.count() == 5


def test_sql_script_literals(spark):
    df = spark.createDataFrame([(1, "O'Neil", float("nan")), (2, None, 1.5)], "id int, name string, v double")
    rows = insert_statements(df, "t", ["id"], batch_rows=1).orderBy("batch").collect()
    assert rows[0]["statement"] == "INSERT INTO t (id, name, v) VALUES\n    (1, 'O''Neil', NULL);"
    assert rows[1]["statement"].endswith("(2, NULL, 1.500000);")
    out = tempfile.mkdtemp(prefix="tessera-sql-", dir="/tmp")
    write_sql_script(insert_statements(df, "t", ["id"]), out + "/script")
    text = "".join(open(os.path.join(out, "script", f)).read() for f in sorted(os.listdir(out + "/script"))
                   if f.startswith("part-"))
    assert text.startswith("BEGIN;") and text.rstrip().endswith("COMMIT;")
