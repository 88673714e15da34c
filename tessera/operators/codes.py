"""Code history operators: merge map (D1 + J15 closure) and harmonisation.

The closure is computed by pointer doubling on a DataFrame: each round
replaces ``new`` by ``map(new)`` through a join, so a chain of depth d
resolves in ceil(log2 d) + 1 rounds.  Every round is cut with a reliable
checkpoint in the shared checkpoint folder, so the plan never grows and a
lost executor recomputes from the last round only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import domain
from tessera.functions.codes import has_no_prefix
from tessera.functions.text import strip_ws
from tessera.session import cut_lineage


def merge_edges(movements: DataFrame, *, mod_col="MOD", date_col="DATE_EFF",
                type_before="TYPECOM_AV", type_after="TYPECOM_AP",
                old_col="COM_AV", new_col="COM_AP", mods=tuple(domain.MERGE_MODS),
                min_date=domain.MERGE_MIN_DATE, entity_type="COM") -> DataFrame:
    """F6 + A15 + duplicate resolution: one (old, new) edge per old code.

    Filters merge movements (kind in ``mods``, effective on/after
    ``min_date``, entity type unchanged, old != new).  When one old code has
    several targets the latest effective date wins, then the greatest new
    code (deterministic; the source kept the last row read).
    """
    e = (movements
         .where(F.col(mod_col).isin(list(mods))
                & (F.col(date_col) >= F.lit(min_date))
                & (F.col(type_before) == entity_type)
                & (F.col(type_after) == entity_type)
                & (F.col(old_col) != F.col(new_col)))
         .select(F.col(old_col).alias("old_code"), F.col(new_col).alias("new_code"),
                 F.col(date_col).alias("_d")))
    # max_by over a struct keeps this a plain hash aggregation (partial + final)
    return (e.groupBy("old_code")
             .agg(F.max(F.struct("_d", "new_code")).alias("_w"))
             .select("old_code", F.col("_w.new_code").alias("new_code")))


def close_edges(edges: DataFrame, old_col="old_code", new_col="new_code") -> DataFrame:
    """Transitive closure of a functional graph old -> new.

    Returns (old_code, new_code) where new_code is the terminal code of the
    chain.  Members of cycles, and codes leading into them, are mapped to
    the smallest code of the cycle.

    Pointer doubling with the smallest code seen on the way: after k rounds a
    pointer stands 2^k moves further and ``_low`` is the smallest code it
    passed, its start left out.  Once 2^k reaches the number of edges, every
    pointer that is not at a terminal stands on a cycle, and the ``_low`` of
    the code it stands on has seen that whole cycle.
    """
    m = (edges.select(F.col(old_col).alias("old_code"), F.col(new_col).alias("new_code"))
              .where(F.col("old_code").isNotNull() & F.col("new_code").isNotNull()
                     & (F.col("old_code") != F.col("new_code"))))
    m = cut_lineage(m.withColumn("_low", F.col("new_code")))
    left = m.count()
    while True:
        ahead = m.select(F.col("old_code").alias("_k"), F.col("new_code").alias("_n"), F.col("_low").alias("_l"))
        step = m.join(ahead, F.col("new_code") == F.col("_k"), "left")
        if left <= 0:
            # on a cycle still: its smallest code
            return step.select("old_code", F.coalesce("_l", "new_code").alias("new_code"))
        step = cut_lineage(step.select("old_code", F.coalesce("_n", "new_code").alias("new_code"),
                                       F.least("_low", F.coalesce("_l", "_low")).alias("_low"), F.col("_k").isNotNull().alias("_open")))
        m = step.drop("_open")
        if step.where("_open").isEmpty():
            return m.select("old_code", "new_code")
        left //= 2


def merge_history_map(movements: DataFrame, **kw) -> DataFrame:
    """Merge movements -> closed (old_code, new_code) map."""
    return close_edges(merge_edges(movements, **kw))


def harmonize(df: DataFrame, col: str, code_map: DataFrame | None,
              excluded_prefixes=tuple(domain.EXCLUDED_PREFIXES)) -> DataFrame:
    """Trim, drop excluded prefixes, remap through the closed map (identity default).

    The map is joined (left) on the code; Spark/AQE chooses broadcast when
    the map is measured small, else a shuffle join whose skewed partitions
    AQE splits.  NULL codes are dropped (a pandas 'nan' string never joins).
    """
    out = df.withColumn(col, strip_ws(F.col(col).cast("string")))
    out = out.where(has_no_prefix(F.col(col), list(excluded_prefixes)))
    if code_map is None:
        return out
    m = code_map.select(F.col("old_code").alias("_old"), F.col("new_code").alias("_new"))
    return (out.join(m, out[col] == m["_old"], "left")
               .withColumn(col, F.coalesce(F.col("_new"), F.col(col)))
               .drop("_old", "_new"))


def first_per_key(df: DataFrame, key, order_cols, descending: bool = False) -> DataFrame:
    """Keep the first row per key under an explicit order (ascending by default).

    Expressed as ``min(struct(order..., rest...))`` per key: a hash
    aggregation with map-side partial combine, so a key holding a third of
    all rows is reduced inside every map task instead of being sorted in a
    single window task.
    """
    key = [key] if isinstance(key, str) else list(key)
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    rest = [c for c in df.columns if c not in key and c not in order_cols]
    packed = F.struct(*[F.col(c) for c in order_cols + rest])
    agg = F.max(packed) if descending else F.min(packed)
    return (df.groupBy(*key).agg(agg.alias("_first"))
              .select(*key, *[F.col(f"_first.{c}").alias(c) for c in order_cols + rest])
              .select(*df.columns))
