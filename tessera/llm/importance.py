"""Operator 12, importance resampling towards a target distribution by hashed word features.

A text is brought to words by one byte table: ``bytes.translate`` lower-cases A-Z and turns
every ASCII byte that is no letter or digit into a blank (bytes from 0x80 on, so all letters
beyond ASCII, stay), and ``bytes.split`` cuts at the blanks.  The features are the runs of 1
to ``max_n`` words; a run's crc32 is its shorter run's crc32 carried on as the seed of the
blank and the next word, so no joined text is ever built.  Counters reduce a text's features
to (crc32, count), and a task's texts to one sum per bucket.

Every document and every benchmark text is counted.  A bucket's gain is the log ratio of its
smoothed share in the target (the benchmark) and in the documents, in thousandths, rounded
down; a document's weight is the mean gain of its features.  Gumbel noise from a hash of
the document's id turns "the k highest scores" into a draw without replacement in proportion
to exp(weight): documents like the target are drawn more often, and reruns draw the same.

The draw needs no global sort: scores are whole numbers within about +-70,000 (a gain is the
logarithm of counts below 2^63, the noise lies in [-3200, 22,200]), so one histogram of them
gives the score at which the draw ends; only documents at or above it are range-partitioned
by (score, id) and numbered from each partition's first place.

Bounds: the driver and every task hold two arrays of ``buckets`` numbers (10,000), a histogram
has at most 140,000 rows; a text is held whole, its words in lists of about ``PIECE`` bytes.

Cases: null and empty texts have no words and weight 0; documents below ``min_words`` words
are scored and never drawn; a null doc_id is hashed as the word ``null`` and comes first among
ties; rows with one id have one noise and are drawn as separate documents, equal rows among
themselves in any order; an empty benchmark makes every gain the documents' own smoothed
rarity; an empty table gives no rows; other columns are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_lists, materialize

MAX_N = 1
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
#: bytes of text whose words are listed at once
PIECE = 1 << 20

#: digits and lower-case letters stay, A-Z become a-z, other ASCII bytes become blanks, the rest stays
BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def word_lists(text: bytes | None):
    """The words of a text, in lists; cut only where the table left a blank."""
    low = (text or b"").translate(BYTES)
    at = 0
    while at < len(low):
        end = low.find(b" ", at + PIECE)
        end = len(low) if end < 0 else end
        yield low[at:end].split()
        at = end


def features(text: bytes | None, max_n: int) -> tuple[Counter, int]:
    """Counts of the crc32s of all runs of 1 to ``max_n`` words, and the number of words."""
    found, n_words, before = Counter(), 0, []
    for new in word_lists(text):
        words, n_words = before + new, n_words + len(new)
        crcs = list(map(crc32, words))
        for n in range(1, max_n + 1):
            if n > 1:  # crcs[i] is the run of n - 1 words from word i on
                crcs = [crc32(b" " + w, crc) for crc, w in zip(crcs, words[n - 1:])]
            found.update(crcs[max(len(before) - n + 1, 0):])  # runs that end in the new words
        before = words[len(words) - max_n + 1:] if max_n > 1 else []
    return found, n_words


def bucket_counts(texts: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all rows of ``texts`` (column text); a task sends one row a bucket."""
    def make():
        total = np.zeros(buckets, np.int64)

        def count(columns):
            for text in columns["text"]:
                found, _ = features(text, max_n)
                crcs = np.fromiter(found.keys(), np.int64, len(found))
                np.add.at(total, crcs % buckets, np.fromiter(found.values(), np.int64, len(found)))

        def flush():
            used = np.flatnonzero(total)
            return {"bucket": used, "n": total[used]} if len(used) else None

        count.flush = flush
        return count

    part = map_lists(texts.select(F.col("text").cast("binary").alias("text")), "bucket long, n long", make)
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(target: DataFrame, source: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket floor(1000 ln of its smoothed share in ``target`` over that in ``source``)."""
    sides = []
    for texts in (target, source):
        side = np.zeros(buckets)
        for row in bucket_counts(texts, max_n, buckets).collect():  # at most ``buckets`` rows
            side[row["bucket"]] = row["n"]
        sides.append(side)
    t, s = sides
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def noise(doc_id, seed: int) -> int:
    """floor of 1000 times a Gumbel value that the id alone decides."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, max_n: int = MAX_N, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document."""
    buckets = len(gain)

    def make():
        def score(columns):
            out = {c: [] for c in ("doc_id", "n_words", "n_features", "weight", "score")}
            for doc_id, text in zip(columns["doc_id"], columns["text"]):
                found, n_words = features(text, max_n)
                crcs = np.fromiter(found.keys(), np.int64, len(found))
                counts = np.fromiter(found.values(), np.int64, len(found))
                n = int(counts.sum())
                weight = int((gain[crcs % buckets] * counts).sum()) // n if n else 0
                for column, value in zip(out.values(), (doc_id, n_words, n, weight, weight + noise(doc_id, seed))):
                    column.append(value)
            return out
        return score

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_lists(docs.select("doc_id", F.col("text").cast("binary").alias("text")),
                     f"doc_id {id_type}, n_words long, n_features long, weight long, score long", make)


def _placed(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with rank 1, 2, 3... in ``order``, without bringing them into one task: each range
    partition is numbered by itself and moved by the number of rows before it."""
    tagged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    tagged = materialize(tagged, "draw").withColumn("_part", F.shiftright("_id", 33))
    sizes = tagged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return tagged.join(starts, F.col("_part") == F.col("_of")) \
        .select(*rows.columns, (F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).alias("rank"))


def draw(rows: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` rows with ``rank``: place among the floor(percent / 100 N) highest scores of the N
    documents with at least ``min_words`` words, null for all others."""
    rows = materialize(rows, "scored")  # five numbers a document
    fit = F.col("n_words") >= min_words
    histogram = rows.where(fit).groupBy("score").agg(F.count("*").alias("n"))
    running = histogram.withColumn("upto", F.sum("n").over(Window.orderBy(F.col("score").desc()))) \
        .withColumn("wanted", F.floor(F.sum("n").over(Window.partitionBy(F.lit(0))) * percent / 100))
    ends = running.where((F.col("upto") >= F.col("wanted")) & (F.col("wanted") > 0)) \
        .agg(F.max("score").alias("score"), F.max("wanted").alias("wanted")).first()
    if ends["score"] is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    able = F.coalesce(fit & (F.col("score") >= ends["score"]), F.lit(False))
    ranked = _placed(rows.where(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_words"), F.col("weight")])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= ends["wanted"], F.col("rank")))
    return ranked.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, seed: int = SEED,
             percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document, drawn towards ``target``."""
    return draw(scored(docs, gains(target, docs, max_n, buckets), max_n, seed), percent, min_words)


def importance(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank."""
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
