"""Join operators: enrichment chain with fan-out guard (J1-J3, J16, V5),
key set operations (J9-J11, U2, U3), size-checked broadcast.

Join strategy is left to Catalyst + AQE: with adaptive execution on, a
shuffle join whose build side is measured below
``spark.sql.adaptive.autoBroadcastJoinThreshold`` is converted to a
broadcast join at run time (a size-checked broadcast), and skewed shuffle
partitions of the big side are split.  Explicit ``broadcast()`` is used
only for literal tables whose size is fixed by construction.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.codes import first_per_key


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """V5/V7: keys occurring more than once, with their multiplicity."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).count().where(F.col("count") > 1)


def enrich(base: DataFrame, steps, on_duplicate: str = "keep") -> DataFrame:
    """Chain of left joins onto a base grain.

    steps: iterable of (right DataFrame, key list[, order cols for 'first']).
    on_duplicate:
      'keep'  - reference behaviour: duplicate right keys multiply base rows;
                use :func:`fanout_report` to see where;
      'first' - keep the first right row per key (explicit order);
      'error' - raise if any right side has a duplicate key (one job per step).
    """
    out = base
    for step in steps:
        right, keys = step[0], step[1]
        keys = [keys] if isinstance(keys, str) else list(keys)
        if on_duplicate == "first":
            order = step[2] if len(step) > 2 else [c for c in right.columns if c not in keys][:1] or keys
            right = first_per_key(right, keys, order)
        elif on_duplicate == "error":
            n = duplicate_keys(right, keys).limit(1).count()
            if n:
                raise ValueError(f"duplicate right keys on {keys}: the join would fan out")
        out = out.join(right, on=keys, how="left")
    return out


def fanout_report(steps) -> DataFrame:
    """V5 re-aimed: one row per enrichment step with the number of duplicated
    right-side keys (0 means the left join preserves the base row count)."""
    parts = []
    for i, step in enumerate(steps):
        right, keys = step[0], step[1]
        keys = [keys] if isinstance(keys, str) else list(keys)
        parts.append(duplicate_keys(right, keys).agg(F.count(F.lit(1)).alias("duplicate_keys"))
                     .select(F.lit(i + 1).alias("step"), F.lit(",".join(keys)).alias("join_keys"),
                             "duplicate_keys"))
    return reduce(DataFrame.unionByName, parts)


def key_intersect(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Keys present in both."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "inner")


def key_except(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Keys of ``a`` absent from ``b``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_anti")


def semi_used(dim: DataFrame, fact: DataFrame, dim_key: str, fact_key: str) -> DataFrame:
    """Dimension rows whose key is used by the fact (left semi join)."""
    used = fact.select(F.col(fact_key).alias(dim_key)).where(F.col(dim_key).isNotNull())
    return dim.join(used, dim_key, "left_semi")


def top_n_per_group(df: DataFrame, group_cols, order_cols, n: int, salt_buckets: int = 64,
                    rank_col: str | None = None) -> DataFrame:
    """First ``n`` rows per group under ``order_cols`` (a total order), skew-safe.

    Stage 1 ranks inside (group, salt) sub-groups, salt = hash of the whole
    row modulo ``salt_buckets``, and keeps the top n of each: a group holding
    a third of all rows is sorted in ``salt_buckets`` pieces.  Stage 2 ranks
    the at most n * salt_buckets survivors per group.  Exact."""
    from pyspark.sql.window import Window
    g = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    o = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*g, "_salt").orderBy(*o)
    stage1 = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= n).drop("_r1", "_salt")
    w2 = Window.partitionBy(*g).orderBy(*o)
    out = stage1.withColumn("_r2", F.row_number().over(w2)).where(F.col("_r2") <= n)
    return out.withColumnRenamed("_r2", rank_col) if rank_col else out.drop("_r2")


def any_per_group(df: DataFrame, group_cols, flag_col: str, out_col: str) -> DataFrame:
    """Attach to every row whether any row of its group has ``flag_col`` true
    (a map-side-combined aggregate joined back, instead of a window)."""
    g = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    agg = df.groupBy(*g).agg(F.max(F.col(flag_col).cast("int")).alias(out_col))
    return df.join(agg, g, "left").withColumn(out_col, F.coalesce(F.col(out_col), F.lit(0)) == 1)
