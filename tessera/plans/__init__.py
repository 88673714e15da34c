"""Bound queries: the library's operators applied to the driver's test tables.

Importing this package registers every query module in ``REGISTRY``.
"""

from tessera.plans import q_analysis, q_codes, q_export, q_features, q_ingest, q_model, q_rollup  # noqa: F401  (registration side effects)
from tessera.plans.registry import REGISTRY, BoundQuery

__all__ = ["REGISTRY", "BoundQuery"]
