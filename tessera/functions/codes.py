"""Code scalar functions (C7, C8, C9, C28) and code predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions._cols import as_col


def strip_float_suffix(c) -> Column:
    """Remove a trailing ``.0`` left by a float -> string conversion
    (``endswith`` + ``left``: no regex, cheap when an optimiser rule inlines
    the expression into a pushed-down filter)."""
    s = as_col(c).cast("string")
    return F.when(s.endswith(".0"), F.left(s, F.length(s) - 2)).otherwise(s)


def zfill(c, width: int = 5) -> Column:
    """Python ``str.zfill``: left zero pad without truncation, sign kept in front.

    ``lpad`` to ``greatest(length, width)`` never truncates."""
    s = as_col(c).cast("string")
    n = F.length(s)
    signed = s.startswith("-") | s.startswith("+")
    body = F.substring(s, 2, 1 << 30)
    return (F.when(signed, F.concat(F.left(s, F.lit(1)), F.lpad(body, F.greatest(n - 1, F.lit(width - 1)), "0")))
             .otherwise(F.lpad(s, F.greatest(n, F.lit(width)), "0")))


def year_prefix(c) -> Column:
    """First four characters."""
    return F.substring(as_col(c).cast("string"), 1, 4)


def has_no_prefix(c, prefixes) -> Column:
    """not starting with any of the prefixes (NULL stays NULL -> dropped by filter)."""
    c = as_col(c)
    return reduce(lambda a, b: a & b, [~c.startswith(p) for p in prefixes])


def has_no_prefix_keep_null(c, prefixes) -> Column:
    """as F3 but a NULL value is kept."""
    return F.coalesce(has_no_prefix(c, prefixes), F.lit(True))


def valid_code(c, width: int = 5, invalid=()) -> Column:
    """F8: length == width, not an invalid literal, not NULL."""
    c = as_col(c)
    cond = c.isNotNull() & (F.length(c) == width)
    if invalid:
        cond = cond & ~c.isin(list(invalid))
    return cond


def priority_from_prefix(c, rules, default: int) -> Column:
    """Priority by the first rule whose prefix list matches."""
    c = as_col(c)
    expr = None
    for prio, prefixes in rules:
        cond = reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])
        expr = F.when(cond, F.lit(prio)) if expr is None else expr.when(cond, F.lit(prio))
    return expr.otherwise(F.lit(default))
