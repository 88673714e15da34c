"""Text scalar functions (C1, C2, C26) as Column expressions.

No Python UDF: accent stripping is a ``translate`` from a table generated
once from the Unicode database, followed by removal of non-spacing marks.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions._cols import as_col

# The characters Python's str.strip() removes: every code point with
# str.isspace() (Unicode whitespace plus the separators U+001C..U+001F),
# generated from the Unicode database, not listed by hand.
WHITESPACE = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())


def strip_ws(c) -> Column:
    """Trim leading/trailing whitespace exactly like ``str.strip()``
    (plain ``trim`` strips only spaces); ``btrim`` with a character set, no regex."""
    return F.btrim(as_col(c).cast("string"), F.lit(WHITESPACE))


@functools.lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """(source, target) strings mapping each precomposed BMP character whose
    canonical decomposition is one base character plus non-spacing marks to
    that base character.  Generated from the Unicode database (a rule, not a
    hand list)."""
    src, dst = [], []
    for cp in range(0x10000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        dec = unicodedata.normalize("NFD", ch)
        if dec == ch:
            continue
        base = "".join(x for x in dec if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


def normalize_name(c) -> Column:
    """Upper, strip, remove diacritics (NFD then drop category Mn).

    Hyphens and inner spaces are kept.
    """
    src, dst = accent_table()
    up = F.upper(strip_ws(c))
    return F.regexp_replace(F.translate(up, src, dst), r"\p{Mn}+", "")


def underscore_label(c) -> Column:
    """``code.replace('_', ' ')``."""
    return F.replace(as_col(c), F.lit("_"), F.lit(" "))
