"""Session construction and lineage cutting.

On a cluster the session is created by the platform; we only read
``spark.checkpoint.dir`` from it.  A scratch checkpoint folder is set only
when none is configured (local tests and the bench).
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: AQE re-plans joins from measured sizes
# (a size-checked broadcast), splits skewed shuffle partitions and
# coalesces small ones.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "tessera", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """Return the shared checkpoint folder named by the session.

    ``spark.checkpoint.dir`` is read from the session; only when it is
    unset (local runs) a fresh scratch folder is created and registered.
    Sessions without a local SparkContext (Spark Connect) keep the server's
    setting untouched.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: checkpointing is configured server-side
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tessera-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used by the iterative operators (closure, clustering, chained
    imputation) so that a lost executor recomputes from the checkpoint,
    never from round 0, and the plan does not grow with the round count.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: shuffle partitions for every split of the largest input
PARTITIONS_A_SPLIT = 8


@contextmanager
def sized_shuffles(largest: DataFrame):
    """Inside the block, shuffles have at least ``PARTITIONS_A_SPLIT`` partitions a split of ``largest``.

    With the session's fixed number a task's share, and so its memory, grows with the input.  For jobs
    that run inside the block (checkpoints); adaptive execution merges what stays small, and the
    session's number is back after it."""
    spark, name = largest.sparkSession, "spark.sql.shuffle.partitions"
    own = spark.conf.get(name)
    try:
        splits = largest.rdd.getNumPartitions()
    except Exception:  # Spark Connect: no splits to count
        splits = 0
    if PARTITIONS_A_SPLIT * splits > int(own):
        spark.conf.set(name, PARTITIONS_A_SPLIT * splits)
    try:
        yield
    finally:
        spark.conf.set(name, own)
