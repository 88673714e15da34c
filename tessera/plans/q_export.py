"""Bound export queries: dimensions, facts, unpivoted results, SQL script."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import export as E
from tessera.plans import q_features, q_rollup
from tessera.plans.registry import REGISTRY, query
from tessera.plans.tables import table
from tessera.sources.sinks import insert_statements

_WS = r"'^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$'"


def _canon(c):
    return f"CAST(CAST(CAST({c} AS DOUBLE) AS BIGINT) AS VARCHAR)"


@query("dim_semi", "E1 J9 C12 C2", oracle=f"""
WITH e AS ({q_features._enrichment_sql()})
SELECT 'region' AS level, {_canon('r_regionkey')} AS code, regexp_replace(r_name, {_WS}, '', 'g') AS nom,
       CAST(NULL AS VARCHAR) AS code_parent
FROM region WHERE {_canon('r_regionkey')} IN (SELECT {_canon('n_regionkey')} FROM e WHERE n_regionkey IS NOT NULL)
UNION ALL
SELECT 'departement', {_canon('n_nationkey')}, regexp_replace(n_name, {_WS}, '', 'g'), {_canon('n_regionkey')}
FROM nation WHERE {_canon('n_nationkey')} IN (SELECT {_canon('c_nationkey')} FROM e WHERE c_nationkey IS NOT NULL)
""")
def dim_semi(spark, d):
    e = q_features.enrichment_chain(spark, d)
    regions = E.used_dimension(table(spark, d, "region", "r_regionkey", "r_name"), e, "r_regionkey",
                               "n_regionkey", "r_name")
    nations = E.used_dimension(table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey"), e,
                               "n_nationkey", "c_nationkey", "n_name", "n_regionkey")
    return (regions.select(F.lit("region").alias("level"), "code", "nom", F.lit(None).cast("string").alias("code_parent"))
                   .unionByName(nations.select(F.lit("departement").alias("level"), "code", "nom", "code_parent")))


@query("dim_first_max", "E2 W3 A7 J2 C25", oracle=f"""
WITH e AS ({q_features._enrichment_sql()})
SELECT o_custkey AS code, coalesce(arg_min(c_mktsegment, annee), '') AS nom,
       CAST(trunc(max(sum_qty)) AS BIGINT) AS population, arg_min(c_nationkey, annee) AS code_parent
FROM e GROUP BY o_custkey
""")
def dim_first_max(spark, d):
    return E.entity_dimension(q_features.enrichment_chain(spark, d), "o_custkey", "annee", "c_mktsegment",
                              "c_nationkey", "sum_qty")


PERIOD_IDS = {"1997": 1, "2000": 2}
COUNTS = ["n_lines", "nb_active"]
INDICATORS = {"revenue": "revenue_total", "qty_per_line": "quantity_per_line", "pct_returned": "returned_share",
              "active_density": "active_density", "balance_change": "balance_change"}


@query("fact_surrogate", "E4 W4 C25 P2 J6", oracle=f"""
WITH t AS ({q_features._features_sql()})
SELECT row_number() OVER (ORDER BY annee, o_custkey) AS id, o_custkey AS code_commune,
       CAST(CASE annee WHEN '1997' THEN 1 WHEN '2000' THEN 2 END AS INTEGER) AS id_scrutin,
       {', '.join(f"CAST(trunc(CAST({c} AS DOUBLE)) AS BIGINT) AS {c}" for c in COUNTS)},
       {', '.join(f"CASE WHEN isfinite(CAST({s} AS DOUBLE)) THEN CAST({s} AS DOUBLE) END AS {t}" for s, t in INDICATORS.items())}
FROM t WHERE annee IN ('1997', '2000')
""")
def fact_surrogate(spark, d):
    return E.observation_fact(q_features.analytical_table(spark, d), ["annee", "o_custkey"], "annee", PERIOD_IDS,
                              "o_custkey", COUNTS, INDICATORS)


@query("unpivot_results", "E5 R4 C24 W4", oracle=f"""
WITH fs AS ({REGISTRY['family_shares'].oracle}),
o AS (SELECT row_number() OVER (ORDER BY annee, place) AS id, * FROM fs),
u AS (SELECT id, total_votes, 'alpha' AS code_famille, alpha AS voix FROM o
      UNION ALL SELECT id, total_votes, 'beta', beta FROM o
      UNION ALL SELECT id, total_votes, 'gamma', gamma FROM o),
q AS (SELECT id, code_famille, CAST(coalesce(voix, 0) AS BIGINT) AS voix, total_votes AS e,
             CASE WHEN total_votes > 0 THEN (coalesce(voix, 0) * 10000) // total_votes END AS q FROM u)
SELECT id AS id_observation, code_famille, voix,
       CASE WHEN e > 0 THEN (q + CASE WHEN 2 * (voix * 10000 - q * e) > e
                                       OR (2 * (voix * 10000 - q * e) = e AND q % 2 = 1) THEN 1 ELSE 0 END) / 100.0
       END AS pourcentage
FROM q
""")
def unpivot_results(spark, d):
    obs = E.surrogate_ids(REGISTRY["family_shares"].build(spark, d), ["annee", "place"], "id")
    return E.result_fact(obs, q_rollup.FLAG_FAMILIES, "total_votes")


_LIT = {
    "c_custkey": "CAST(c_custkey AS VARCHAR)",
    "c_name": "CASE WHEN c_name IS NULL THEN 'NULL' ELSE '''' || replace(c_name, '''', '''''') || '''' END",
    "c_nationkey": "coalesce(CAST(c_nationkey AS VARCHAR), 'NULL')",
    "c_acctbal": "CASE WHEN c_acctbal IS NULL OR isnan(c_acctbal) OR isinf(c_acctbal) THEN 'NULL' "
                 "ELSE printf('%.6f', c_acctbal) END",
    "c_mktsegment": "CASE WHEN c_mktsegment IS NULL THEN 'NULL' ELSE '''' || replace(c_mktsegment, '''', '''''') || '''' END",
}


@query("sql_script", "K3 W4 W7", oracle=f"""
WITH r AS (SELECT row_number() OVER (ORDER BY c_custkey) AS id,
                  '(' || {" || ', ' || ".join(_LIT.values())} || ')' AS tup FROM customer)
SELECT 'customer' AS table_name, CAST((id - 1) // 500 AS BIGINT) AS batch,
       'INSERT INTO customer ({', '.join(_LIT)}) VALUES' || chr(10) || '    '
       || string_agg(tup, ',' || chr(10) || '    ' ORDER BY id) || ';' AS statement
FROM r GROUP BY 2
""")
def sql_script(spark, d):
    c = table(spark, d, "customer", *_LIT.keys())
    return insert_statements(c, "customer", ["c_custkey"])
