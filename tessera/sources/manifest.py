"""File inventory against a manifest (S10), load accounting (S14), stage
size summary (K5).  Files are read with the ``binaryFile`` source, one row
per file (files must stay below 2 GB each); hashing runs in the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def inventory(spark: SparkSession, path: str, glob: str = "*", with_hash: bool = True,
              recursive: bool = False) -> DataFrame:
    """(path, name, folder, size, modified[, sha256]) of the files under ``path``."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    df = r.load(path)
    cols = [F.col("path"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
            F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"),
            F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    if with_hash:
        cols.append(F.sha2(F.col("content"), 256).alias("sha256"))
    return df.select(*cols)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest as JSON: one object (multi-line) keyed by ``<dataset>/<file>``
    or JSON lines with (key, sha256, size)."""
    return spark.read.option("multiLine", True).json(path)


def manifest_status(files: DataFrame, manifest: DataFrame, key: str = "name") -> DataFrame:
    """Full outer join on the key -> status ok / mismatch / missing / new."""
    m = manifest.select(F.col(key), F.col("sha256").alias("_expected"), F.col("size").alias("_expected_size"))
    f = files.select(F.col(key), "sha256", "size")
    j = f.join(m, key, "full")
    status = (F.when(F.col("sha256").isNull(), F.lit("missing"))
               .when(F.col("_expected").isNull(), F.lit("new"))
               .when(F.col("sha256") == F.col("_expected"), F.lit("ok"))
               .otherwise(F.lit("mismatch")))
    return j.select(key, "size", F.col("_expected_size").alias("expected_size"), status.alias("status"))


def to_load(status: DataFrame) -> DataFrame:
    """Incremental load: everything not already present with the expected hash."""
    return status.where(F.col("status") != "ok")


def load_accounting(status: DataFrame, group_col: str = "status") -> DataFrame:
    """Files and bytes per status (or folder)."""
    return status.groupBy(group_col).agg(F.count(F.lit(1)).alias("n_files"),
                                         F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def stage_summary(spark: SparkSession, path: str) -> DataFrame:
    """K5: number of files and total MB under a stage folder (lengths only, no hash)."""
    inv = inventory(spark, path, with_hash=False, recursive=True)
    return inv.agg(F.count(F.lit(1)).alias("n_files"), F.round(F.sum("size") / 1e6, 1).alias("total_mb"))
