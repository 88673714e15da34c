"""Scalar functions: every one returns a Spark ``Column`` (JVM-side, codegen'd)."""

from tessera.functions.codes import (has_no_prefix, has_no_prefix_keep_null, priority_from_prefix,
                                     strip_float_suffix, valid_code, year_prefix, zfill)
from tessera.functions.numeric import (all_or_total, canonical_int_string, clean_suppressed, fill,
                                       finite_or_null, floor_at, min_max_scaled, nan_to_null,
                                       round_half_even, row_mean, row_sum, safe_ratio, stable_round, status_rule,
                                       strict_number, to_long_truncating, to_number)
from tessera.functions.text import normalize_name, strip_ws, underscore_label

__all__ = [
    "all_or_total", "canonical_int_string", "clean_suppressed", "fill", "finite_or_null",
    "floor_at", "has_no_prefix", "has_no_prefix_keep_null", "min_max_scaled", "nan_to_null",
    "normalize_name", "priority_from_prefix", "round_half_even", "row_mean", "row_sum",
    "safe_ratio", "stable_round", "status_rule", "strict_number", "strip_float_suffix", "strip_ws",
    "to_long_truncating", "to_number", "underscore_label", "valid_code", "year_prefix", "zfill",
]
