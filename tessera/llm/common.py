"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tessera.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROWS_PER_SLICE = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_kept: dict = {}


def kept(key, make):
    """``make()``, kept in the Python worker across tasks until another key is asked for or a task
    of ``map_lists`` doesn't keep it: the caches of different operators never add up in a worker."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    _kept.clear()


def _release() -> None:
    """Freed memory goes back to the system, Arrow's and (Arrow's system pool trims it) the C library's."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most a slice, and of some 16 MB: the executor and its worker hold one each a task.
    Jobs read this when they run, so it stays set; a smaller number of the session is left."""
    for name, most in (("maxRecordsPerBatch", ROWS_PER_SLICE), ("maxBytesPerBatch", 16 << 20)):
        name = f"spark.sql.execution.arrow.{name}"
        own = spark.conf.get(name, str(1 << 30)).removesuffix("b")
        if not own.isdigit() or not 0 < int(own) <= most:
            spark.conf.set(name, str(most))


def map_lists(df: DataFrame, schema: str | StructType, make, keeps: bool = False) -> DataFrame:
    """``mapInArrow`` with plain lists: ``make()`` runs once per task and returns a
    function from ``{column: list}`` to ``{column: list or array}``; it sees at most
    ``ROWS_PER_SLICE`` rows at a time.  A ``flush`` attribute of that function, if
    any, gives last rows at the end of the task.  What a worker has ``kept`` from other tasks goes
    unless the function ``keeps`` it, and freed memory is released before and after."""
    struct = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)
    _small_batches(df.sparkSession)

    def work(batches):
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_SLICE):
                part = batch.slice(at, ROWS_PER_SLICE)
                out = f({n: c.to_pylist() for n, c in zip(part.schema.names, part.columns)})
                if out:
                    yield _record_batch(out, arrow)
        last = getattr(f, "flush", None)
        if last and (out := last()):
            yield _record_batch(out, arrow)

    def run(batches):
        if not keeps:
            forget()
        _release()
        yield from work(batches)
        _release()

    return df.mapInArrow(run, struct)


def _record_batch(out: dict, arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)


def aside(df: DataFrame, names: list[str], work) -> DataFrame:
    """``work(df)`` for a ``work`` that adds columns called ``names``: the caller's columns of these names
    (in any case) carry others meanwhile, and are called as before in the result."""
    taken = {c.lower() for c in [*df.columns, *names]}
    renamed = {}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            new = f"{c}_own"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            renamed[c] = new
    return work(df.withColumnsRenamed(renamed)).withColumnsRenamed({new: old for old, new in renamed.items()})


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's setting for shuffle files that go at the end of a query (from 4.1 on)
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Inside the block, shuffle files go when their query ends, not when the driver next collects its
    garbage; sessions that don't know the setting, or whose caller set it, are left as they are."""
    if not spark.conf.isModifiable(CLEANUP) or spark.conf.get(CLEANUP) == "true":
        yield
        return
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, "false")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and reread: cuts lineage, survives lost
    executors, keeps columns prunable.  The write's shuffle files go when it ends."""
    path = shared_path(df.sparkSession, name)
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id):
    """crc32 of the id as text, modulo 5, is 0 (null id: crc32 of the empty text, held out)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest reachable id per node of an undirected edge table: (node, component).

    Alternating large-star and small-star rounds on DataFrames until every node
    points at one smallest id.  Every round aggregates before it joins, so a hub node
    is combined map-side and its rows are split by AQE; lineage is cut by a written table."""
    e = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
                    .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v") \
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, "edges")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether the distinct edges (u, v), v < u, end the rounds: no u has two edges or is the v of another."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")) \
        .unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    with _shuffles_removed(e.sparkSession):
        return node.where("up > 1 or up = 1 and down = 1").isEmpty()
