"""Bound enrichment / feature / quality queries.

The customer x year grain plays the role of the source's place x election
grain: measures are rolled up, enriched by a chain of left joins, ratio
features are derived and the per-nation family shares are attached as
targets.  Later analysis queries (profile, correlation, imputation,
selection, models, projection) all run on this analytical table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.codes import has_no_prefix_keep_null
from tessera.operators import quality as Q
from tessera.operators.features import ByPeriod, PartsOrTotal, Ratio, ratio_features
from tessera.operators.joins import enrich, fanout_report
from tessera.plans import q_rollup
from tessera.plans.registry import REGISTRY, query
from tessera.plans.tables import shared_plan, table

MIN_QTY = 100.0


def enrichment_steps(spark, d):
    cust = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment") \
        .withColumnRenamed("c_custkey", "o_custkey")
    nation = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey") \
        .withColumnRenamed("n_nationkey", "c_nationkey")
    region = table(spark, d, "region", "r_regionkey", "r_name").withColumnRenamed("r_regionkey", "n_regionkey")
    shares = q_rollup.conditional_share(spark, d).withColumnRenamed("s_nationkey", "c_nationkey")
    active = q_rollup.active_at_dates(spark, d)
    return [(cust, ["o_custkey"]), (nation, ["c_nationkey"]), (region, ["n_regionkey"]),
            (shares, ["c_nationkey"]), (active, ["c_nationkey", "annee"])]


def _sql(name):
    return REGISTRY[name].oracle


def _enrichment_sql():
    return f"""
WITH base AS ({_sql('rollup_measures')}),
sh AS ({_sql('conditional_share')}),
act AS ({_sql('active_at_dates')})
SELECT b.*, c.c_nationkey, c.c_acctbal, c.c_mktsegment, n.n_name, n.n_regionkey, r.r_name,
       sh.pct_returned, CAST(act.nb_active AS BIGINT) AS nb_active
FROM base b
LEFT JOIN customer c ON c.c_custkey = b.o_custkey
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN sh ON sh.s_nationkey = c.c_nationkey
LEFT JOIN act ON act.c_nationkey = c.c_nationkey AND act.annee = b.annee
WHERE b.sum_qty IS NOT NULL AND b.sum_qty >= {MIN_QTY} AND coalesce(NOT starts_with(n.n_name, 'NATION_1'), true)
"""


@shared_plan
def enrichment_chain(spark, d):
    base = q_rollup.rollup_measures(spark, d)
    out = enrich(base, enrichment_steps(spark, d))
    return out.where(F.col("sum_qty").isNotNull() & (F.col("sum_qty") >= MIN_QTY)
                     & has_no_prefix_keep_null("n_name", ["NATION_1"]))


query("enrichment_chain", "J16 J1 J2 F4 F5 V5", oracle=_enrichment_sql())(enrichment_chain)


FEATURE_SPECS = [
    Ratio("qty_per_line", "sum_qty", "n_lines", 1.0, 2),
    Ratio("pct_net_tax", "net_tax", "revenue", 100.0, 4),
    Ratio("revenue_per_balance", "revenue", "c_acctbal", 1.0, 2),
    Ratio("active_density", "nb_active", "sum_qty", 1000.0, 2, fill_num=True),
    PartsOrTotal("activity_share", ["nb_active", "n_lines", "sum_qty"], "sum_qty", "revenue", 100.0, 4),
    ByPeriod("balance_change", "annee", {"1997": ("revenue", "net_tax"), "2000": ("sum_qty", "n_lines")},
             den="c_acctbal", scale=1000.0, digits=2),
]
FEATURES = ["n_lines", "sum_qty", "revenue", "net_tax", "c_acctbal", "pct_returned", "nb_active",
            "qty_per_line", "pct_net_tax", "revenue_per_balance", "active_density", "activity_share",
            "balance_change"]
TARGETS = ["pct_alpha", "pct_beta", "pct_gamma"]


@shared_plan
def analytical_table(spark, d):
    """Enrichment chain + ratio features + targets (family shares of the row's nation-year)."""
    t = ratio_features(enrichment_chain(spark, d), FEATURE_SPECS)
    shares = REGISTRY["family_shares"].build(spark, d).select(
        "annee", F.col("place").cast("int").alias("c_nationkey"), *TARGETS)
    return t.join(shares, ["annee", "c_nationkey"], "left")


def _features_sql():
    return f"""
WITH e AS ({_enrichment_sql()}),
fs AS ({_sql('family_shares')})
SELECT e.*,
  round_even(CAST(e.sum_qty AS DOUBLE) / nullif(CAST(e.n_lines AS DOUBLE), 0) * 1.0 * 100, 0) / 100 AS qty_per_line,
  round_even(e.net_tax / nullif(e.revenue, 0) * 100.0 * 10000, 0) / 10000 AS pct_net_tax,
  round_even(e.revenue / nullif(e.c_acctbal, 0) * 1.0 * 100, 0) / 100 AS revenue_per_balance,
  round_even(CAST(coalesce(e.nb_active, 0) AS DOUBLE) / nullif(e.sum_qty, 0) * 1000.0 * 100, 0) / 100 AS active_density,
  round_even(coalesce(e.nb_active + e.n_lines + e.sum_qty, e.sum_qty) / nullif(e.revenue, 0) * 100.0 * 10000, 0) / 10000
    AS activity_share,
  CASE WHEN e.annee = '1997' THEN round_even((e.revenue - e.net_tax) / nullif(e.c_acctbal, 0) * 1000.0 * 100, 0) / 100
       WHEN e.annee = '2000' THEN round_even((e.sum_qty - e.n_lines) / nullif(e.c_acctbal, 0) * 1000.0 * 100, 0) / 100
  END AS balance_change,
  fs.pct_alpha, fs.pct_beta, fs.pct_gamma
FROM e LEFT JOIN fs ON fs.annee = e.annee AND CAST(fs.place AS INTEGER) = e.c_nationkey
"""


query("ratio_features", "D10 C11 C15 C16 C17 P5", oracle=_features_sql())(analytical_table)


@query("completeness", "A13 A14", oracle=f"""
WITH t AS ({_features_sql()}),
tc AS (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FEATURES + TARGETS)} FROM t),
l AS (SELECT * FROM tc UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(FEATURES + TARGETS)})))
SELECT feature, CAST(sum(CASE WHEN value IS NULL OR isnan(value) THEN 1 ELSE 0 END) AS BIGINT) AS n_null,
       round_even(avg(CASE WHEN value IS NULL OR isnan(value) THEN 0.0 ELSE 1.0 END) * 100 * 100, 0) / 100 AS pct_complete
FROM l GROUP BY feature
""")
def completeness(spark, d):
    return Q.completeness(analytical_table(spark, d), FEATURES + TARGETS)


@query("row_total_check", "V2 C18 A10", oracle=f"""
WITH t AS ({_sql('family_shares')}),
s AS (SELECT coalesce(pct_alpha, 0.0) + coalesce(pct_beta, 0.0) + coalesce(pct_gamma, 0.0) AS tot FROM t)
SELECT round_even(min(tot) * 100, 0) / 100 AS total_pct_min,
       round_even(median(tot) * 100, 0) / 100 AS total_pct_median,
       round_even(max(tot) * 100, 0) / 100 AS total_pct_max
FROM s
""")
def row_total_check(spark, d):
    return Q.row_total_check(REGISTRY["family_shares"].build(spark, d), ["pct_alpha", "pct_beta", "pct_gamma"])


@query("table_report", "V1 A5 A6", oracle=f"""
WITH t AS ({_features_sql()})
SELECT 'rows' AS metric, CAST(annee AS VARCHAR) AS period, count(*) AS value FROM t GROUP BY annee
UNION ALL SELECT 'rows', NULL, count(*) FROM t
UNION ALL SELECT 'entities', NULL, count(DISTINCT o_custkey) FROM t
UNION ALL SELECT 'periods', NULL, count(DISTINCT annee) FROM t
""")
def table_report(spark, d):
    return Q.table_report(analytical_table(spark, d), "o_custkey", "annee")


@query("fanout_report", "V5", oracle=f"""
WITH sh AS ({_sql('conditional_share')}), act AS ({_sql('active_at_dates')})
SELECT 1 AS step, 'o_custkey' AS join_keys, (SELECT count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)) AS duplicate_keys
UNION ALL SELECT 2, 'c_nationkey', (SELECT count(*) FROM (SELECT n_nationkey FROM nation GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 3, 'n_regionkey', (SELECT count(*) FROM (SELECT r_regionkey FROM region GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 4, 'c_nationkey', (SELECT count(*) FROM (SELECT s_nationkey FROM sh GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 5, 'c_nationkey,annee', (SELECT count(*) FROM (SELECT c_nationkey, annee FROM act GROUP BY 1, 2 HAVING count(*) > 1))
""")
def fanout(spark, d):
    return fanout_report(enrichment_steps(spark, d))


def star_checks(spark, d):
    t = lambda name, *c: table(spark, d, name, *c)
    region, nation = t("region", "r_regionkey"), t("nation", "n_nationkey")
    return [
        Q.table_checks(region, "pk_region", "r_regionkey"),
        Q.table_checks(nation, "pk_nation", "n_nationkey"),
        Q.table_checks(t("customer", "c_custkey", "c_name", "c_acctbal"), "pk_customer", "c_custkey",
                       {"nn_customer_name": F.col("c_name").isNull(), "range_customer_acctbal_8_2": Q.beyond_decimal("c_acctbal", 8, 2)}),
        Q.table_checks(t("supplier", "s_suppkey"), "pk_supplier", "s_suppkey"),
        Q.table_checks(t("part", "p_partkey"), "pk_part", "p_partkey"),
        Q.table_checks(t("orders", "o_orderkey", "o_orderdate", "o_totalprice"), "pk_orders", "o_orderkey",
                       {"nn_orders_orderdate": F.col("o_orderdate").isNull(), "range_orders_totalprice_10_2": Q.beyond_decimal("o_totalprice", 10, 2)}),
        Q.table_checks(t("lineitem", "l_orderkey", "l_linenumber", "l_discount"), "pk_lineitem", ["l_orderkey", "l_linenumber"],
                       {"check_lineitem_discount_0_1": ~F.col("l_discount").between(0, 1)}),
        Q.unique_violations("unique_nation_name", t("nation", "n_name"), "n_name"),
        Q.fk_checks(t("nation", "n_regionkey"), {"fk_nation_region": ("n_regionkey", region, "r_regionkey")}),
        Q.fk_checks(t("customer", "c_nationkey"), {"fk_customer_nation": ("c_nationkey", nation, "n_nationkey")}),
        Q.fk_checks(t("supplier", "s_nationkey"), {"fk_supplier_nation": ("s_nationkey", nation, "n_nationkey")}),
        Q.fk_checks(t("orders", "o_custkey"), {"fk_orders_customer": ("o_custkey", t("customer", "c_custkey"), "c_custkey")}),
        Q.fk_checks(t("lineitem", "l_orderkey", "l_partkey", "l_suppkey"),
                    {"fk_lineitem_orders": ("l_orderkey", t("orders", "o_orderkey"), "o_orderkey"),
                     "fk_lineitem_part": ("l_partkey", t("part", "p_partkey"), "p_partkey"),
                     "fk_lineitem_supplier": ("l_suppkey", t("supplier", "s_suppkey"), "s_suppkey")}),
    ]


def _pk(name, tbl, keys):
    k = ", ".join(keys)
    nulls = " OR ".join(f"{c} IS NULL" for c in keys)
    return (f"SELECT '{name}' AS constraint_name, CAST((SELECT count(*) FROM (SELECT {k} FROM {tbl} GROUP BY {k} "
            f"HAVING count(*) > 1)) + (SELECT count(*) FROM {tbl} WHERE {nulls}) AS BIGINT) AS violations")


def _fk(name, child, ck, parent, pk):
    return (f"SELECT '{name}', CAST(count(*) AS BIGINT) FROM {child} c WHERE c.{ck} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {parent} p WHERE p.{pk} = c.{ck})")


@query("constraint_report", "V7", oracle="\nUNION ALL\n".join([
    _pk("pk_region", "region", ["r_regionkey"]),
    _pk("pk_nation", "nation", ["n_nationkey"]),
    _pk("pk_customer", "customer", ["c_custkey"]),
    _pk("pk_supplier", "supplier", ["s_suppkey"]),
    _pk("pk_part", "part", ["p_partkey"]),
    _pk("pk_orders", "orders", ["o_orderkey"]),
    _pk("pk_lineitem", "lineitem", ["l_orderkey", "l_linenumber"]),
    "SELECT 'unique_nation_name', CAST(count(*) AS BIGINT) FROM (SELECT n_name FROM nation WHERE n_name IS NOT NULL "
    "GROUP BY 1 HAVING count(*) > 1)",
    _fk("fk_nation_region", "nation", "n_regionkey", "region", "r_regionkey"),
    _fk("fk_customer_nation", "customer", "c_nationkey", "nation", "n_nationkey"),
    _fk("fk_supplier_nation", "supplier", "s_nationkey", "nation", "n_nationkey"),
    _fk("fk_orders_customer", "orders", "o_custkey", "customer", "c_custkey"),
    _fk("fk_lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    _fk("fk_lineitem_part", "lineitem", "l_partkey", "part", "p_partkey"),
    _fk("fk_lineitem_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    "SELECT 'nn_orders_orderdate', CAST(count(*) AS BIGINT) FROM orders WHERE o_orderdate IS NULL",
    "SELECT 'nn_customer_name', CAST(count(*) AS BIGINT) FROM customer WHERE c_name IS NULL",
    "SELECT 'range_orders_totalprice_10_2', CAST(count(*) AS BIGINT) FROM orders WHERE abs(o_totalprice) >= 100000000",
    "SELECT 'range_customer_acctbal_8_2', CAST(count(*) AS BIGINT) FROM customer WHERE abs(c_acctbal) >= 1000000",
    "SELECT 'check_lineitem_discount_0_1', CAST(count(*) AS BIGINT) FROM lineitem "
    "WHERE NOT (l_discount BETWEEN 0 AND 1)",
]))
def constraint_report(spark, d):
    return Q.constraint_report(star_checks(spark, d))
