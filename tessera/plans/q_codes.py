"""Bound queries for scalar cleaning and code history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import (canonical_int_string, clean_suppressed, normalize_name,
                               strip_float_suffix, valid_code, zfill)
from tessera.operators.codes import close_edges, harmonize
from tessera.plans.registry import query
from tessera.plans.tables import table

@query("name_normalize", "C1 C2", oracle=r"""
SELECT doc_id,
       strip_accents(replace(replace(upper(regexp_replace(text, '^\s+|\s+$', '', 'g')),
                                     'ẞ', 'SS'), 'ß', 'SS')) AS name_norm
FROM documents
""")
def name_normalize(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", normalize_name("text").alias("name_norm"))


@query("code_canonical", "C7 C8 C12 F8 D4", oracle=r"""
WITH raw AS (
  SELECT c_custkey,
         CAST(CAST(c_custkey AS DOUBLE) AS VARCHAR) AS code_raw,
         CAST(floor(c_acctbal / 100) AS VARCHAR) AS bal_raw,
         CAST(c_nationkey AS DOUBLE) AS nation_raw
  FROM customer),
stripped AS (
  SELECT c_custkey, regexp_replace(code_raw, '\.0$', '') AS c, regexp_replace(bal_raw, '\.0$', '') AS b,
         nation_raw FROM raw)
SELECT c_custkey,
       CASE WHEN length(c) >= 5 THEN c
            WHEN c LIKE '-%' OR c LIKE '+%' THEN substr(c, 1, 1) || lpad(substr(c, 2), 4, '0')
            ELSE lpad(c, 5, '0') END AS code,
       CASE WHEN length(b) >= 5 THEN b
            WHEN b LIKE '-%' OR b LIKE '+%' THEN substr(b, 1, 1) || lpad(substr(b, 2), 4, '0')
            ELSE lpad(b, 5, '0') END AS balance_code,
       CAST(CAST(nation_raw AS BIGINT) AS VARCHAR) AS nation_code
FROM stripped
WHERE length(CASE WHEN length(c) >= 5 THEN c ELSE lpad(c, 5, '0') END) = 5
""")
def code_canonical(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_acctbal", "c_nationkey")
    out = c.select(
        "c_custkey",
        zfill(strip_float_suffix(F.col("c_custkey").cast("double").cast("string"))).alias("code"),
        zfill(strip_float_suffix(F.floor(F.col("c_acctbal") / 100).cast("double").cast("string")))
        .alias("balance_code"),
        canonical_int_string(F.col("c_nationkey").cast("double")).alias("nation_code"))
    return out.where(valid_code("code", 5, ["00nan", "00NaN", "nan00"]))


@query("suppressed_numeric", "C3 C4 C5", oracle=r"""
WITH raw AS (
  SELECT s_suppkey,
         CASE WHEN s_acctbal < 0 THEN 's' ELSE replace(CAST(s_acctbal AS VARCHAR), '.', ',') END AS raw
  FROM supplier)
SELECT s_suppkey, raw,
       CASE WHEN nullif(raw, 's') IS NULL THEN NULL
            WHEN regexp_matches(replace(raw, ',', '.'), '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$')
            THEN TRY_CAST(trim(replace(raw, ',', '.')) AS DOUBLE) END AS value
FROM raw
""")
def suppressed_numeric(spark, d):
    s = table(spark, d, "supplier", "s_suppkey", "s_acctbal")
    raw = F.when(F.col("s_acctbal") < 0, F.lit("s")).otherwise(
        F.replace(F.col("s_acctbal").cast("string"), F.lit("."), F.lit(",")))
    return (s.select("s_suppkey", raw.alias("raw"))
             .select("s_suppkey", "raw", clean_suppressed("raw").alias("value")))


def part_edges(spark, d):
    """Merge edges derived from ``part``: a part merges into the next key when
    that part is strictly larger (an equi-join on key + 1, no skew)."""
    a = table(spark, d, "part", "p_partkey", "p_size").alias("a")
    b = table(spark, d, "part", "p_partkey", "p_size").alias("b")
    return (a.join(b, (F.col("b.p_partkey") == F.col("a.p_partkey") + 1)
                   & (F.col("b.p_size") > F.col("a.p_size")))
             .select(F.col("a.p_partkey").cast("string").alias("old_code"),
                     F.col("b.p_partkey").cast("string").alias("new_code")))


_CLOSURE_SQL = """
e AS (
  SELECT CAST(a.p_partkey AS VARCHAR) AS old_code, CAST(b.p_partkey AS VARCHAR) AS new_code
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 AND b.p_size > a.p_size),
walk(start, node, depth) AS (
  SELECT old_code, new_code, 1 FROM e
  UNION ALL
  SELECT w.start, e.new_code, w.depth + 1 FROM walk w JOIN e ON e.old_code = w.node),
closure AS (SELECT start AS old_code, max_by(node, depth) AS new_code FROM walk GROUP BY start)
"""


@query("code_closure", "D1 J15", oracle="WITH RECURSIVE" + _CLOSURE_SQL + "SELECT old_code, new_code FROM closure")
def code_closure(spark, d):
    return close_edges(part_edges(spark, d))


@query("code_harmonize", "D2 J4 F3 C2", oracle="WITH RECURSIVE" + _CLOSURE_SQL + r"""
, li AS (SELECT CAST(l_partkey AS VARCHAR) AS code, count(*) AS n, sum(l_quantity) AS q
         FROM lineitem GROUP BY 1)
SELECT coalesce(c.new_code, li.code) AS code, CAST(sum(n) AS BIGINT) AS n_lines, sum(q) AS sum_qty
FROM li LEFT JOIN closure c ON c.old_code = li.code
WHERE NOT starts_with(li.code, 'ZZ') AND NOT starts_with(li.code, '97')
GROUP BY 1
""")
def code_harmonize(spark, d):
    li = table(spark, d, "lineitem", "l_partkey", "l_quantity")
    # pre-aggregate per raw code: the harmonising join then sees one row per
    # code, and a hot code is combined map-side instead of skewing the join
    pre = (li.groupBy(F.col("l_partkey").cast("string").alias("code"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")))
    h = harmonize(pre, "code", close_edges(part_edges(spark, d)))
    return h.groupBy("code").agg(F.sum("n").alias("n_lines"), F.sum("q").alias("sum_qty"))


@query("numeric_columns_clean", "D3 P6 C3 C4 C5", oracle=r"""
WITH raw AS (
  SELECT CAST(c_custkey AS VARCHAR) AS CODGEO,
         CASE WHEN c_acctbal < 0 THEN 's' ELSE replace(CAST(c_acctbal AS VARCHAR), '.', ',') END AS acctbal,
         CAST(c_nationkey AS VARCHAR) AS nationkey,
         CASE WHEN c_acctbal > 9000 THEN 's' ELSE CAST(length(c_name) AS VARCHAR) END AS name_len
  FROM customer)
SELECT CODGEO,
  CASE WHEN nullif(acctbal, 's') IS NULL THEN NULL
       WHEN regexp_matches(replace(acctbal, ',', '.'), '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$')
       THEN TRY_CAST(trim(replace(acctbal, ',', '.')) AS DOUBLE) END AS acctbal,
  CASE WHEN nullif(nationkey, 's') IS NULL THEN NULL
       WHEN regexp_matches(replace(nationkey, ',', '.'), '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$')
       THEN TRY_CAST(trim(replace(nationkey, ',', '.')) AS DOUBLE) END AS nationkey,
  CASE WHEN nullif(name_len, 's') IS NULL THEN NULL
       WHEN regexp_matches(replace(name_len, ',', '.'), '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$')
       THEN TRY_CAST(trim(replace(name_len, ',', '.')) AS DOUBLE) END AS name_len
FROM raw
""")
def numeric_columns_clean(spark, d):
    """D3 on a census-like all-string extract of ``customer``: every string
    column except the key is cleaned (suppression marker, decimal comma)."""
    from tessera.operators.territory import clean_numeric_columns
    c = table(spark, d, "customer", "c_custkey", "c_acctbal", "c_nationkey", "c_name")
    raw = c.select(
        F.col("c_custkey").cast("string").alias("CODGEO"),
        F.when(F.col("c_acctbal") < 0, F.lit("s"))
         .otherwise(F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(","))).alias("acctbal"),
        F.col("c_nationkey").cast("string").alias("nationkey"),
        F.when(F.col("c_acctbal") > 9000, F.lit("s")).otherwise(F.length("c_name").cast("string")).alias("name_len"))
    return clean_numeric_columns(raw, "CODGEO")


@query("registry_clean", "D4 C7 C8 F7 F8 A15", oracle=r"""
WITH raw AS (
  SELECT CAST(CAST(o.o_custkey AS DOUBLE) AS VARCHAR) AS code, strftime(o.o_orderdate, '%Y-%m-%d') AS date_creat,
         CASE WHEN o.o_orderstatus = 'O' THEN '0001-01-01' ELSE strftime(o.o_orderdate, '%Y') || '-12-31' END AS date_disso
  FROM orders o),
z AS (SELECT regexp_replace(code, '\.0$', '') AS c, date_creat, date_disso FROM raw),
p AS (SELECT CASE WHEN length(c) >= 5 THEN c
                  WHEN c LIKE '-%' OR c LIKE '+%' THEN substr(c, 1, 1) || lpad(substr(c, 2), 4, '0')
                  ELSE lpad(c, 5, '0') END AS adrs_codeinsee, date_creat, date_disso FROM z)
SELECT DISTINCT adrs_codeinsee, date_creat, date_disso FROM p
WHERE adrs_codeinsee IS NOT NULL AND length(adrs_codeinsee) = 5 AND adrs_codeinsee NOT IN ('00nan', '00NaN', 'nan00')
  AND date_creat <> '0001-01-01' AND date_creat <= '2025-12-31'
""")
def registry_clean(spark, d):
    """D4 on a registry-like extract of ``orders`` (float-rendered codes,
    creation date, open sentinel or year-end dissolution)."""
    from tessera.operators.territory import clean_registry
    o = table(spark, d, "orders", "o_custkey", "o_orderdate", "o_orderstatus")
    raw = o.select(
        F.col("o_custkey").cast("double").cast("string").alias("adrs_codeinsee"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_creat"),
        F.when(F.col("o_orderstatus") == "O", F.lit("0001-01-01"))
         .otherwise(F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-12-31"))).alias("date_disso"))
    return clean_registry(raw)
