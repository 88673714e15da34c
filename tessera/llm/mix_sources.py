"""Operator 7, mixing sources to target weights by hash-threshold histograms.

Every document gets a 60-bit hash of its id.  Sizes are summed by source and top hash
bits; the running sum over the buckets (they nest: lower hash, taken first) shows the
bucket in which the source's budget ends, and only that bucket is summed again by its
next bits, until single hashes remain.  Then one comparison with the source's threshold
decides every document; nothing is sorted and reruns agree.

Targets: weights 5, 2, 1 repeating over the sources in code-point order (null last)
share all sizes; no target exceeds ``max_repeat`` times its source's size, the excess is
shared by weight among the others until none is above.  A source with a target of more
than its size takes every document ``floor(target / size)`` times and the rest by hash.

Cases: null text has size 0; null sources form one source; rows with equal ids (null
ids: by text) have one hash and are taken together; documents of size 0 take 0; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import aside, materialize

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
HASH_BITS = 60
STEP_BITS = 20


def text_size(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def doc_hash(doc_id: Column, text: Column) -> Column:
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), text), F.lit("null"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, weight, target; one row per source.

    With the sources ordered by cap over weight, those below the water level are capped;
    the level after k capped sources is (total - their caps) / (weight of the rest)."""
    cap = F.col("source_size") * max_repeat
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (place % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size").withColumn("weight", pick).withColumn("cap", cap)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("open", F.sum("weight").over(after))
    s = s.withColumn("left", F.sum("source_size").over(everything) - F.col("capped"))
    # the first source whose cap is not below its share ends the capped ones
    free = F.col("cap") * F.col("open") >= F.col("left") * F.col("weight")
    s = s.withColumn("level", F.min(F.when(free, F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "left", "open"))).over(everything))
    target = F.when(F.col("level.left") * F.col("weight") <= F.col("cap") * F.col("level.open"),
                    F.col("level.left").cast("double") * F.col("weight") / F.col("level.open")).otherwise(F.col("cap").cast("double"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), doc_hash(F.col("doc_id"), F.col("text")).alias("hash"))


def plan_mix(sized: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source (``s``): source_size, target, whole (copies every document gets) and
    threshold (documents of at most this hash get one more).  ``sized`` has source, size, hash."""
    t = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    t = materialize(t.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    state = t.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for bits in range(STEP_BITS, HASH_BITS + 1, STEP_BITS):
        state = materialize(_refine(sized, state, bits), "threshold")
    # the hash where the budget ends goes in if that comes nearer to it
    at = state.select(F.col("source").alias("s"), "prefix")
    edge = sized.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col("hash") == F.col("prefix"))).groupBy("s").agg(F.sum("size").alias("edge")).withColumnRenamed("s", "e")
    nearer = (F.col("budget") > 0) & (2 * (F.col("budget") - F.col("below")) >= F.coalesce("edge", F.lit(0)))  # a budget of 0 takes no more copies
    ends = state.join(edge, F.col("source").eqNullSafe(F.col("e")), "left").select(F.col("source").alias("s"), F.when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("threshold"))
    return materialize(t.join(ends, F.col("source").eqNullSafe(F.col("s"))).select("s", "source_size", "target", "whole", "threshold"), "mix-plan")


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """doc_id, source, size, hash, source_size, target, copies: how often the mix takes each document."""
    sized = materialize(_sized(docs), "mix")  # a few numbers a document; texts are read once
    joined = sized.join(plan_mix(sized, weights, max_repeat), F.col("source").eqNullSafe(F.col("s")))
    return joined.select("doc_id", "source", "size", "hash", "source_size", "target", _copies().alias("copies"))


def _copies() -> Column:
    return F.col("whole") + (F.col("hash") <= F.col("threshold")).cast("long")


def _refine(d: DataFrame, state: DataFrame, bits: int) -> DataFrame:
    """One level of the histogram: state has, per source, the hash prefix in which the budget
    ends and the sum of all sizes below it; this appends the prefix's next bits."""
    shift = HASH_BITS - bits
    s = state.select(F.col("source").alias("s"), "budget", "prefix", "below")
    inside = d.join(s, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", shift + STEP_BITS) == F.col("prefix")))
    histogram = inside.groupBy("s", "budget", "below", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"))
    w = Window.partitionBy("s").orderBy("bucket")
    running = histogram.withColumn("upto", F.col("below") + F.sum("n").over(w)).withColumn("last", F.lead("bucket").over(w).isNull())
    # the first bucket that reaches the budget, or the last one
    ends = running.where((F.col("upto") >= F.col("budget")) | F.col("last")).groupBy("s") \
        .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("below"))).alias("e"))
    return s.join(ends.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")), "left") \
        .select(F.col("s").alias("source"), "budget", F.coalesce("e.bucket", F.col("prefix") * (1 << STEP_BITS)).alias("prefix"), F.coalesce("e.below", F.col("below")).alias("below"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every row as often as the mix takes it.  Texts meet only the small plan,
    one row a source."""
    names = ("s", "source_size", "target", "whole", "threshold")
    plan = plan_mix(materialize(_sized(docs), "mix")).withColumnsRenamed({c: f"_mix_{c}" for c in names})
    copies = F.col("_mix_whole") + (doc_hash(F.col("doc_id"), F.col("text")) <= F.col("_mix_threshold")).cast("long")

    def repeated(d: DataFrame) -> DataFrame:
        found = d.join(plan, F.col("source").eqNullSafe(F.col("_mix_s")))
        return found.select(*d.columns, F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("_mix_copy")).select(*d.columns)

    return aside(docs, [*(f"_mix_{c}" for c in names), "_mix_copy"], repeated)
