"""File sources (S1-S9): column-pruned parquet, all-string delimited text,
header discovery, multi-file folders, snapshot choice, preamble sheets,
fallback locations.  Schemas are explicit: delimited sources are read as
strings (codes keep their leading zeros) and cleaned by the C* functions.
"""

from __future__ import annotations

from fnmatch import fnmatch
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, path: str, cols=None) -> DataFrame:
    """Parquet scan; a column list becomes the scan's ReadSchema."""
    df = spark.read.parquet(path)
    return df.select(*cols) if cols else df


def _delimited(spark: SparkSession, sep: str, encoding: str):
    return (spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
            .option("escape", '"').option("mode", "PERMISSIVE"))


def header(spark: SparkSession, path: str, sep: str = ";", encoding: str = "UTF-8") -> list:
    """Column names of a delimited file, by the CSV reader (quotes and a
    byte order mark are its business); it reads the first line only."""
    return [c.strip() for c in _delimited(spark, sep, encoding).csv(path).columns]


def part_files(spark: SparkSession, path: str) -> list:
    """Paths of the files of a folder or glob (names only, contents stay unread)."""
    return sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())


def read_delimited(spark: SparkSession, path: str | list, sep: str = ";", cols=None, header_cols=None,
                   encoding: str = "UTF-8", multiline: bool = False) -> DataFrame:
    """Delimited text with a header, every column a string (no
    inference), optional projection.  ``path`` may be a folder, a glob or a list of files (S6):
    every part is read by its own header (one small job a file), parts of the
    same header in one scan, and the scans are united by column name; a column
    that a part lacks is NULL there.  ``header_cols`` names the columns of all
    parts by position instead.  ``multiline`` allows line breaks in quotes, at
    the price of unsplit files."""
    reader = _delimited(spark, sep, encoding).option("multiLine", multiline)
    if header_cols:
        by_header = {tuple(header_cols): path if isinstance(path, list) else [path]}
    else:
        by_header = {}
        for f in path if isinstance(path, list) else part_files(spark, path):
            by_header.setdefault(tuple(header(spark, f, sep, encoding)), []).append(f)
    scans = []
    for names, files in by_header.items():
        if names:  # an empty file has no columns and no rows
            schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
            scans.append(reader.schema(schema).csv(files))
    if not scans:
        raise ValueError(f"no delimited file with a header under {path}")
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
    return df.select(*cols) if cols else df


def matching_files(spark: SparkSession, path: str) -> list:
    """As ``part_files``; no match gives an empty list."""
    try:
        return part_files(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def latest_file(spark: SparkSession, path: str, first: bool = False) -> str | None:
    """S7 before any scan: the last (or first) match of a glob by name, a file or a folder
    of part files; None without a match."""
    last = path.rsplit("/", 1)[-1]

    def match(f: str) -> str:
        steps = f.split("/")
        return "/".join(steps[:1 + max(i for i, s in enumerate(steps) if fnmatch(s, last))])

    found = sorted({match(f) for f in matching_files(spark, path)})
    return found[0 if first else -1] if found else None


def latest_folder(spark: SparkSession, path: str) -> list:
    """S7 before any scan: the files of the last folder (by path) of a glob over folders and files."""
    found = matching_files(spark, path)
    parent = lambda f: f.rsplit("/", 1)[0]
    return [f for f in found if parent(f) == max(map(parent, found))]


def latest_snapshot(df: DataFrame, pattern: str, first: bool = False) -> DataFrame:
    """S7 on one multi-snapshot scan: keep rows of the lexicographically last
    (or first) source file whose path matches ``pattern`` (one regex group =
    snapshot id).  The choice is an aggregate over distinct file names."""
    x = df.withColumn("_snap", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))
    pick = x.agg((F.min if first else F.max)("_snap").alias("_pick"))
    return x.join(F.broadcast(pick), F.col("_snap") == F.col("_pick")).drop("_snap", "_pick")


def read_sheet_export(spark: SparkSession, path: str, key: str, sep: str = ";") -> DataFrame:
    """S8 re-aimed: a sheet exported as delimited text with preamble rows.

    The header row is located by its key cell (first column == ``key``);
    rows after it are renamed positionally and rows with a NULL key dropped.
    Row order comes from a per-file line index."""
    raw = spark.read.option("sep", sep).option("header", False).csv(path)
    raw = raw.withColumn("_file", F.col("_metadata.file_path")).withColumn("_line", F.monotonically_increasing_id())
    hdr = raw.where(F.col("_c0") == key).groupBy("_file").agg(F.min("_line").alias("_h"))
    names_row = raw.where(F.col("_c0") == key).limit(1).first()
    cols = [c for c in raw.columns if c.startswith("_c")]
    names = [names_row[c] if names_row[c] is not None else c for c in cols]
    body = raw.join(F.broadcast(hdr), "_file").where(F.col("_line") > F.col("_h"))
    out = body.select(*[F.col(c).alias(n) for c, n in zip(cols, names)])
    return out.dropna(subset=[key])


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def read_with_fallback(spark: SparkSession, primary: str, fallback: str) -> tuple[DataFrame, str]:
    """Read ``primary`` if it exists, else ``fallback``; returns (df, path used)."""
    chosen = primary if path_exists(spark, primary) else fallback
    return spark.read.parquet(chosen), chosen
