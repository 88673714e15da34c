"""tessera — territorial panel analytics on Spark DataFrames.

Every public operator is a function ``DataFrame(s) + parameters -> DataFrame``
built from Spark SQL expressions, joins, aggregations, windows and MLlib.
"""

from tessera.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
