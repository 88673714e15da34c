"""Bound roll-up / lookup / pivot / point-in-time queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import safe_ratio, stable_round
from tessera.functions.codes import year_prefix
from tessera.functions.text import normalize_name
from tessera.operators import rollup as R
from tessera.operators.reshape import vintage_stack
from tessera.plans.registry import query
from tessera.plans.tables import date_str, shared_plan, table

# Binding of the family lookup to the driver tables: a candidate is a
# (return flag, line status) pair; two pairs are deliberately unmapped.
FLAG_FAMILY = {("R", "F"): "alpha", ("A", "F"): "beta", ("N", "O"): "gamma", ("N", "F"): "alpha"}
FLAG_FAMILIES = ["alpha", "beta", "gamma"]


def families_df(spark):
    return R.lookup_table(spark, FLAG_FAMILY, ["nom_norm", "prenom_norm"], "famille")


def order_lines(spark, d):
    """lineitem joined to its order: the per-'polling station' rows."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus", "l_quantity")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    return li.join(o, li.l_orderkey == o.o_orderkey).drop("o_orderkey")


def _place(spark, d):
    return table(spark, d, "customer", "c_custkey", "c_nationkey").select(
        F.col("c_custkey"), F.col("c_nationkey").cast("string").alias("place"))


@shared_plan
def shares_rollup(spark, d):
    """D5 bound: orders are the general table, order lines the candidate rows,
    place = customer nation, election id = order date string."""
    cust = _place(spark, d)
    o = table(spark, d, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, d, "customer", "c_custkey", "c_acctbal")
    # pre-aggregate per (customer, election) before the customer join
    # the year is the election id here: pre-aggregating at that grain before
    # the customer join keeps one row per (customer, year)
    gen = (o.groupBy("o_custkey", year_prefix(date_str("o_orderdate")).alias("election"))
            .agg(F.count(F.lit(1)).alias("n_orders"),
                 F.sum(F.rint(F.col("o_totalprice") * 100).cast("long")).alias("total_cents"))
            .join(c, F.col("o_custkey") == F.col("c_custkey"))
            .withColumn("balance_cents", F.col("n_orders") * F.rint(F.col("c_acctbal") * 100).cast("long"))
            .join(cust, "c_custkey"))
    lines = (order_lines(spark, d)
             .groupBy("o_custkey", year_prefix(date_str("o_orderdate")).alias("election"), "l_returnflag",
                      "l_linestatus")
             .agg(F.sum(F.col("l_quantity").cast("long")).alias("voix"))
             .join(cust, F.col("o_custkey") == F.col("c_custkey")))
    out = R.family_rollup(gen, lines, families_df(spark), place_col="place", election_col="election",
                          count_cols=["n_orders", "total_cents", "balance_cents"], vote_col="voix",
                          surname_col="l_returnflag", firstname_col="l_linestatus",
                          family_values=FLAG_FAMILIES, positive_col="total_cents",
                          clip_cols=["balance_cents"])
    total = sum(F.col(f) for f in FLAG_FAMILIES) + F.coalesce(F.col("INCONNU"), F.lit(0))
    return out.withColumn("total_votes", total)


_SHARES_SQL = """
fam(r, s, famille) AS (VALUES ('R','F','alpha'), ('A','F','beta'), ('N','O','gamma'), ('N','F','alpha')),
gen0 AS (
  SELECT o_custkey, substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 4) AS election, count(*) AS n_orders,
         sum(CAST(round_even(o_totalprice * 100, 0) AS BIGINT)) AS total_cents
  FROM orders GROUP BY 1, 2),
gen AS (
  SELECT substr(g.election, 1, 4) AS annee, CAST(c.c_nationkey AS VARCHAR) AS place,
         sum(g.n_orders) AS n_orders, sum(g.total_cents) AS total_cents,
         sum(g.n_orders * CAST(round_even(c.c_acctbal * 100, 0) AS BIGINT)) AS balance_cents
  FROM gen0 g JOIN customer c ON c.c_custkey = g.o_custkey
  WHERE g.total_cents > 0 GROUP BY 1, 2),
votes AS (
  SELECT substr(strftime(o.o_orderdate, '%Y-%m-%d'), 1, 4) AS annee, CAST(c.c_nationkey AS VARCHAR) AS place,
         coalesce(f.famille, 'INCONNU') AS famille, sum(CAST(l.l_quantity AS BIGINT)) AS voix
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN fam f ON f.r = l.l_returnflag AND f.s = l.l_linestatus
  GROUP BY 1, 2, 3),
piv AS (
  SELECT annee, place,
         coalesce(sum(voix) FILTER (WHERE famille = 'alpha'), 0) AS alpha,
         coalesce(sum(voix) FILTER (WHERE famille = 'beta'), 0) AS beta,
         coalesce(sum(voix) FILTER (WHERE famille = 'gamma'), 0) AS gamma,
         coalesce(sum(voix) FILTER (WHERE famille = 'INCONNU'), 0) AS "INCONNU"
  FROM votes GROUP BY 1, 2),
roll AS (
  SELECT g.annee, g.place, CAST(g.n_orders AS BIGINT) AS n_orders, CAST(g.total_cents AS BIGINT) AS total_cents,
         CAST(greatest(g.balance_cents, 0) AS BIGINT) AS balance_cents,
         CAST(coalesce(p.alpha, 0) AS BIGINT) AS alpha, CAST(coalesce(p.beta, 0) AS BIGINT) AS beta,
         CAST(coalesce(p.gamma, 0) AS BIGINT) AS gamma, CAST(p."INCONNU" AS BIGINT) AS "INCONNU"
  FROM gen g LEFT JOIN piv p ON p.annee = g.annee AND p.place = g.place)
"""


@query("family_shares", "D5 A1 C9 C10 F5 C1 J5 A2 R1 J1 C13 C11", oracle="WITH" + _SHARES_SQL + """
SELECT *, CAST(alpha + beta + gamma + coalesce("INCONNU", 0) AS BIGINT) AS total_votes,
       round_even(alpha / nullif(CAST(alpha + beta + gamma + coalesce("INCONNU", 0) AS DOUBLE), 0) * 100 * 100, 0) / 100 AS pct_alpha,
       round_even(beta / nullif(CAST(alpha + beta + gamma + coalesce("INCONNU", 0) AS DOUBLE), 0) * 100 * 100, 0) / 100 AS pct_beta,
       round_even(gamma / nullif(CAST(alpha + beta + gamma + coalesce("INCONNU", 0) AS DOUBLE), 0) * 100 * 100, 0) / 100 AS pct_gamma
FROM roll
""")
@shared_plan
def family_shares(spark, d):
    return R.family_shares(shares_rollup(spark, d), FLAG_FAMILIES, "total_votes")


@query("lookup_default_pivot", "J5 A2 R1", oracle="WITH" + _SHARES_SQL + """
SELECT annee, place, CAST(alpha AS BIGINT) AS alpha, CAST(beta AS BIGINT) AS beta,
       CAST(gamma AS BIGINT) AS gamma, CAST("INCONNU" AS BIGINT) AS "INCONNU" FROM piv
""")
def lookup_default_pivot(spark, d):
    lines = (order_lines(spark, d)
             .groupBy("o_custkey", year_prefix(date_str("o_orderdate")).alias("annee"),
                      "l_returnflag", "l_linestatus")
             .agg(F.sum(F.col("l_quantity").cast("long")).alias("voix"))
             .join(_place(spark, d), F.col("o_custkey") == F.col("c_custkey")))
    c = (lines.groupBy("annee", "place", "l_returnflag", "l_linestatus").agg(F.sum("voix").alias("voix"))
              .withColumn("nom_norm", normalize_name("l_returnflag"))
              .withColumn("prenom_norm", normalize_name("l_linestatus")))
    c = R.lookup_with_default(c, families_df(spark), ["nom_norm", "prenom_norm"], "famille")
    return R.pivot_sum(c, ["annee", "place"], "famille", FLAG_FAMILIES + ["INCONNU"], "voix",
                       zero_fill=FLAG_FAMILIES + ["INCONNU"])


@query("unmapped_values", "V3", oracle="""
WITH fam(r, s) AS (VALUES ('R','F'), ('A','F'), ('N','O'), ('N','F'))
SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM fam WHERE fam.r = upper(trim(l.l_returnflag)) AND fam.s = upper(trim(l.l_linestatus)))
""")
def unmapped_values(spark, d):
    li = table(spark, d, "lineitem", "l_returnflag", "l_linestatus")
    return R.unmapped_values(li, families_df(spark), "l_returnflag", "l_linestatus")


@query("rollup_measures", "A1 C9 C10 F5", oracle="""
SELECT substr(strftime(o.o_orderdate, '%Y-%m-%d'), 1, 4) AS annee, o.o_custkey,
       count(*) AS n_lines, sum(l.l_quantity) AS sum_qty,
       round_even(round_even(sum(l.l_extendedprice * (1 - l.l_discount)) * 1e6, 0) / 1e4, 0) / 1e2 AS revenue,
       round_even(round_even(greatest(sum(l.l_tax - l.l_discount), 0) * 1e8, 0) / 1e4, 0) / 1e4 AS net_tax
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
WHERE l.l_quantity > 0
GROUP BY 1, 2
""")
@shared_plan
def rollup_measures(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    x = (li.where(F.col("l_quantity") > 0)
           .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
           .select(year_prefix(date_str("o_orderdate")).alias("annee"), "o_custkey", "l_quantity",
                   (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"),
                   (F.col("l_tax") - F.col("l_discount")).alias("net_tax")))
    agg = x.groupBy("annee", "o_custkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.coalesce(F.sum("l_quantity"), F.lit(0.0)).alias("sum_qty"),
        F.coalesce(F.sum("rev"), F.lit(0.0)).alias("revenue"),
        F.greatest(F.coalesce(F.sum("net_tax"), F.lit(0.0)), F.lit(0.0)).alias("net_tax"))
    # output rounding only (the source keeps raw sums): snapped first, so a
    # sum landing on x.xx5 rounds the same whatever the summation order
    return agg.select("annee", "o_custkey", "n_lines", "sum_qty",
                      stable_round("revenue", 2).alias("revenue"),
                      stable_round("net_tax", 4).alias("net_tax"))


@query("conditional_share", "A4 J2", oracle="""
WITH per_supp AS (
  SELECT l_suppkey, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS part, sum(l_quantity) AS total
  FROM lineitem GROUP BY 1),
per_nation AS (
  SELECT s.s_nationkey, coalesce(sum(p.part), 0) AS part, coalesce(sum(p.total), 0) AS total
  FROM per_supp p JOIN supplier s ON s.s_suppkey = p.l_suppkey GROUP BY 1)
SELECT s_nationkey, round_even(part / nullif(total, 0) * 100 * 100, 0) / 100 AS pct_returned
FROM per_nation WHERE total > 0
""")
@shared_plan
def conditional_share(spark, d):
    li = table(spark, d, "lineitem", "l_suppkey", "l_quantity", "l_returnflag")
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    # pre-aggregate lines per supplier (map-side combine), then attach the nation
    per_supp = li.groupBy("l_suppkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("part"),
        F.sum("l_quantity").alias("total"))
    x = per_supp.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    agg = x.groupBy("s_nationkey").agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("part"),
                                       F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"))
    return agg.where(F.col("total") > 0).select(
        "s_nationkey", safe_ratio("part", "total", 100.0, 2).alias("pct_returned"))


ACTIVE_SNAPSHOTS = {"1997": "1997-06-30", "2000": "2000-06-30"}


def order_intervals(spark, d):
    """Validity interval per order: [order date, last ship date); open orders
    (status 'O') carry the open sentinel as end."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_shipdate")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    last = li.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("mx"))
    return (o.join(last, F.col("o_orderkey") == F.col("l_orderkey"))
             .select("o_orderkey", "o_custkey", date_str("o_orderdate").alias("date_creat"),
                     F.when(F.col("o_orderstatus") == "O", F.lit("0001-01-01"))
                      .otherwise(date_str("mx")).alias("date_disso")))


@query("active_at_dates", "J12 A5", oracle="""
WITH iv AS (
  SELECT c.c_nationkey, strftime(o.o_orderdate, '%Y-%m-%d') AS s,
         CASE WHEN o.o_orderstatus = 'O' THEN '0001-01-01' ELSE strftime(m.mx, '%Y-%m-%d') END AS e
  FROM orders o JOIN (SELECT l_orderkey, max(l_shipdate) AS mx FROM lineitem GROUP BY 1) m ON m.l_orderkey = o.o_orderkey
  JOIN customer c ON c.c_custkey = o.o_custkey),
d(annee, dt) AS (VALUES ('1997', '1997-06-30'), ('2000', '2000-06-30'))
SELECT iv.c_nationkey, d.annee, count(*) AS nb_active
FROM iv JOIN d ON iv.s <= d.dt AND (iv.e > d.dt OR iv.e = '0001-01-01')
GROUP BY 1, 2
""")
@shared_plan
def active_at_dates(spark, d):
    iv = order_intervals(spark, d)
    # count per customer first (small), then roll customers up to nations
    per_cust = R.active_at_dates(iv, "o_custkey", "date_creat", "date_disso", ACTIVE_SNAPSHOTS)
    c = table(spark, d, "customer", "c_custkey", "c_nationkey")
    return (per_cust.join(c, F.col("o_custkey") == F.col("c_custkey"))
                    .groupBy("c_nationkey", "annee").agg(F.sum("nb_active").alias("nb_active")))


# period -> years averaged for it (binding of the source's election-year alignment)
PRICE_PERIODS = {"1997": [1996, 1997], "2000": [1999, 2000]}
PRIORITY_CATEGORY = {"1-URGENT": "urgent", "2-HIGH": "urgent", "3-MEDIUM": "medium",
                     "4-NOT SPECIFIED": "low", "5-LOW": "low"}
PRICE_CATEGORIES = ["urgent", "medium", "low"]


@query("fallback_overlay", "D8 J7 A3 R2 J3 P3 J6", oracle="""
WITH cat(p, categorie) AS (VALUES ('1-URGENT','urgent'), ('2-HIGH','urgent'), ('3-MEDIUM','medium'),
                                  ('4-NOT SPECIFIED','low'), ('5-LOW','low')),
per(annee, y) AS (VALUES ('1997', 1996), ('1997', 1997), ('2000', 1999), ('2000', 2000)),
rows AS (
  SELECT o.o_custkey, c.c_nationkey, per.annee, cat.categorie, o.o_totalprice, o.o_orderstatus
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN per ON per.y = year(o.o_orderdate) JOIN cat ON cat.p = o.o_orderpriority),
ent AS (
  SELECT o_custkey, annee,
         avg(o_totalprice) FILTER (WHERE categorie = 'urgent') AS urgent,
         avg(o_totalprice) FILTER (WHERE categorie = 'medium') AS medium,
         avg(o_totalprice) FILTER (WHERE categorie = 'low') AS low
  FROM rows WHERE o_orderstatus = 'F' GROUP BY 1, 2),
par AS (
  SELECT c_nationkey, annee,
         avg(o_totalprice) FILTER (WHERE categorie = 'urgent') AS urgent,
         avg(o_totalprice) FILTER (WHERE categorie = 'medium') AS medium,
         avg(o_totalprice) FILTER (WHERE categorie = 'low') AS low
  FROM rows GROUP BY 1, 2),
base AS (SELECT c.c_custkey, c.c_nationkey, p.annee FROM customer c, (VALUES ('1997'), ('2000')) p(annee))
SELECT b.c_custkey, b.c_nationkey, b.annee,
       round_even(round_even((coalesce(e.urgent, p.urgent)) * 1e6, 0) / 1e4, 0) / 1e2 AS price_urgent,
       round_even(round_even((coalesce(e.medium, p.medium)) * 1e6, 0) / 1e4, 0) / 1e2 AS price_medium,
       round_even(round_even((coalesce(e.low, p.low)) * 1e6, 0) / 1e4, 0) / 1e2 AS price_low
FROM base b LEFT JOIN par p ON p.c_nationkey = b.c_nationkey AND p.annee = b.annee
LEFT JOIN ent e ON e.o_custkey = b.c_custkey AND e.annee = b.annee
""")
def fallback_overlay(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority",
              "o_orderstatus")
    c = table(spark, d, "customer", "c_custkey", "c_nationkey")
    cat = R.lookup_table(spark, PRIORITY_CATEGORY, "o_orderpriority", "categorie")
    rows = R.attach_period(o.withColumn("_y", F.year("o_orderdate")), "_y", PRICE_PERIODS)
    rows = R.lookup_with_default(rows, cat, "o_orderpriority", "categorie", default=None)
    ent = R.pivot_sum(rows.where(F.col("o_orderstatus") == "F"), ["o_custkey", "annee"], "categorie",
                      PRICE_CATEGORIES, "o_totalprice", zero_fill=[], agg="avg")
    par = R.pivot_sum(rows.join(c, F.col("o_custkey") == F.col("c_custkey")), ["c_nationkey", "annee"],
                      "categorie", PRICE_CATEGORIES, "o_totalprice", zero_fill=[], agg="avg")
    out = R.fallback_overlay(c, "c_custkey", "c_nationkey",
                             ent.withColumnRenamed("o_custkey", "c_custkey"), par, PRICE_CATEGORIES,
                             periods=list(PRICE_PERIODS), prefix="price_")
    return out.select("c_custkey", "c_nationkey", "annee",
                      *[stable_round(f"price_{k}", 2).alias(f"price_{k}") for k in PRICE_CATEGORIES])


VINTAGES = {"2000": ("P00_", "C00_"), "1996": ("P96_", "C96_")}
VINTAGE_RULES = {"1996": [("_NBLINES", "_NLINES")]}


def vintage_wide(spark, d):
    """A wide 'census' table per customer holding two vintages side by side."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_extendedprice")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("_y", F.year("o_orderdate"))
    is00, is96 = F.col("_y") == 2000, F.col("_y") == 1996
    return x.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("NB_LINES_ALL"),
        F.sum(F.when(is00, F.col("l_quantity"))).alias("P00_QTY"),
        stable_round(F.sum(F.when(is00, F.col("l_extendedprice"))), 2).alias("P00_REV"),
        F.count(F.when(is00, 1)).alias("C00_NLINES"),
        F.sum(F.when(is96, F.col("l_quantity"))).alias("P96_QTY"),
        stable_round(F.sum(F.when(is96, F.col("l_extendedprice"))), 2).alias("P96_REV"),
        F.count(F.when(is96, 1)).alias("C96_NBLINES"))


@query("vintage_stack", "P4 U1 P9", oracle="""
WITH x AS (SELECT o.o_custkey, year(o.o_orderdate) AS y, l.l_quantity, l.l_extendedprice
           FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey),
w AS (SELECT o_custkey, count(*) AS NB_LINES_ALL,
             sum(l_quantity) FILTER (WHERE y = 2000) AS P00_QTY,
             round_even(round_even(sum(l_extendedprice) FILTER (WHERE y = 2000) * 1e6, 0) / 1e4, 0) / 1e2 AS P00_REV,
             count(*) FILTER (WHERE y = 2000) AS C00_NLINES,
             sum(l_quantity) FILTER (WHERE y = 1996) AS P96_QTY,
             round_even(round_even(sum(l_extendedprice) FILTER (WHERE y = 1996) * 1e6, 0) / 1e4, 0) / 1e2 AS P96_REV,
             count(*) FILTER (WHERE y = 1996) AS C96_NBLINES
      FROM x GROUP BY 1)
SELECT o_custkey, NB_LINES_ALL, P00_QTY AS P_QTY, P00_REV AS P_REV, C00_NLINES AS C_NLINES, '2000' AS annee FROM w
UNION ALL BY NAME
SELECT o_custkey, NB_LINES_ALL, P96_QTY AS P_QTY, P96_REV AS P_REV, C96_NBLINES AS C_NLINES, '1996' AS annee FROM w
""")
def vintage_stack_q(spark, d):
    return vintage_stack(vintage_wide(spark, d), VINTAGES, VINTAGE_RULES, year_col="annee")


@query("key_set_ops", "J10 J11 U2 U3", oracle="""
WITH y AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders),
a AS (SELECT o_custkey FROM y WHERE y = 1996),
b AS (SELECT o_custkey FROM y WHERE y = 2000)
SELECT o_custkey, 'both' AS membership FROM (SELECT o_custkey FROM b INTERSECT SELECT o_custkey FROM a)
UNION ALL
SELECT o_custkey, 'late_only' FROM (SELECT o_custkey FROM b EXCEPT SELECT o_custkey FROM a)
""")
def key_set_ops(spark, d):
    """Entities present in both periods (intersection) and only in the late one (difference)."""
    from tessera.operators.joins import key_except, key_intersect
    o = table(spark, d, "orders", "o_custkey", "o_orderdate").withColumn("_y", F.year("o_orderdate"))
    early, late = o.where(F.col("_y") == 1996), o.where(F.col("_y") == 2000)
    both = key_intersect(late, early, "o_custkey").withColumn("membership", F.lit("both"))
    only = key_except(late, early, "o_custkey").withColumn("membership", F.lit("late_only"))
    return both.unionByName(only)
