"""Reshape operators: vintage split-and-stack (P4 + U1), unpivot (R4), ordered column sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vintage_stack(wide: DataFrame, vintages: dict, rules: dict | None = None,
                  year_col: str = "annee") -> DataFrame:
    """Split a wide table holding several vintages into one projection per
    vintage, strip the vintage tag from the names (``P22_X`` -> ``P_X``),
    apply per-vintage synonym rules, tag the year and stack by name.

    vintages: {year_label: (prefix, prefix, ...)}; the first letter of each
    prefix is kept (``P22_`` -> ``P_``).  Columns belonging to no vintage
    are common and repeated in every branch.  Both branches read the same
    scan; the union is a narrow concatenation (no shuffle).
    """
    rules = rules or {}
    all_prefixes = tuple(p for ps in vintages.values() for p in ps)
    common = [c for c in wide.columns if not c.startswith(all_prefixes)]
    branches = []
    for label, prefixes in vintages.items():
        cols = []
        for c in wide.columns:
            if not c.startswith(tuple(prefixes)):
                continue
            p = next(p for p in prefixes if c.startswith(p))
            new = p[0] + "_" + c[len(p):]
            for old, rep in rules.get(label, []):
                new = new.replace(old, rep)
            cols.append(F.col(c).alias(new))
        branches.append(wide.select(*common, *cols, F.lit(label).alias(year_col)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)


def unpivot(df: DataFrame, ids, value_cols, name_col: str, value_col: str) -> DataFrame:
    """Wide value columns -> (ids..., name, value) rows (Spark ``unpivot``)."""
    return df.unpivot(list(ids), list(value_cols), name_col, value_col)


def ordered_unique(cols) -> list:
    """Ordered, duplicate-free column list."""
    return list(dict.fromkeys(cols))


def select_existing(df: DataFrame, wanted, prefixes=()) -> tuple[DataFrame, list]:
    """Project wanted ∩ existing (+ prefix-discovered columns); report missing.

    Uses only the schema (no job over the data)."""
    have = df.columns
    keep = [c for c in wanted if c in have]
    keep += [c for c in have if prefixes and c.startswith(tuple(prefixes)) and c not in keep]
    missing = [c for c in wanted if c not in have]
    return df.select(*keep), missing


def optional_col(df: DataFrame, name: str, dtype: str = "double"):
    """P5: the column if present, else a typed NULL literal."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)
