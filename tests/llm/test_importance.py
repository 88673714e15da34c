"""Importance resampling against a plain dictionary version."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

from tessera.llm import importance
from tessera.llm.common import table
from tests.conftest import SF_SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, max_n):
    w = WORD.findall((text or "").translate(LOW))
    return len(w), Counter(" ".join(w[i:i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1))


def brute(docs, bench, max_n=1, buckets=10_000, min_words=20, percent=10):
    def total(texts):
        c = Counter()
        for t in texts:
            for g, n in grams(t, max_n)[1].items():
                c[crc32(g.encode()) % buckets] += n
        return c

    s, t = total(x for _, x in docs), total(bench)
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)}
    rows = []
    for doc_id, text in docs:
        words, g = grams(text, max_n)
        n = sum(g.values())
        weight = sum(gain[crc32(k.encode()) % buckets] * c for k, c in g.items()) // n if n else 0
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, words, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[1], r[3]))
    drawn = {id(r): k + 1 for k, r in enumerate(fit[:percent * len(fit) // 100])}
    return [(r[0], r[2], r[3], r[4], drawn.get(id(r))) for r in rows]


def as_set(rows):
    return sorted(map(tuple, rows), key=repr)


def test_query_equals_brute_force_on_the_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF_SMALL, "documents").collect()]
    bench = [r["text"] for r in table(spark, SF_SMALL, "benchmark").collect()]
    got = importance.importance(table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "benchmark")).collect()
    assert as_set(got) == as_set(brute(docs, bench))
    assert sum(r["rank"] is not None for r in got) > 10


def edge_docs():
    rows = [(i, "word " * (i % 40) + f"É{i % 3} Tail-{i % 7}") for i in range(150)]
    rows += [(None, "lost " * 25), (None, "lost " * 25), (3, None), (4, ""), (5, "!!! --"), (7, "word " * 30), (7, "word " * 30)]
    return rows + [(1000, "one " * 30)] * 60  # a crowd with one score


def test_edge_rows_and_longer_runs(spark, monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 16)  # texts cut in many lists
    rows, bench = edge_docs(), ["Word tail 1", None, "", "one one é1"]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, rank string")
    target = spark.createDataFrame([(t,) for t in bench], "text string")
    for max_n, buckets in ((1, 10_000), (3, 97)):
        got = importance.resample(docs, target, max_n=max_n, buckets=buckets, percent=30).drop("n_words").collect()
        assert as_set(got) == as_set(brute(rows, bench, max_n, buckets, percent=30))
    again = importance.resample(docs.repartition(7), target, percent=30).drop("n_words").collect()
    assert as_set(again) == as_set(importance.resample(docs, target, percent=30).drop("n_words").collect())


def test_empty_tables(spark):
    docs = spark.createDataFrame(edge_docs(), "doc_id long, text string")
    none = docs.limit(0)
    assert importance.importance(none, docs).collect() == []
    got = importance.importance(docs, none).collect()
    assert as_set(got) == as_set(brute(edge_docs(), []))
    few = spark.createDataFrame([(1, "too short")], "doc_id long, text string")
    assert [r["rank"] for r in importance.importance(few, docs).collect()] == [None]


def test_pieces_do_not_change_features():
    text = ("Ab c-d é" * 50).encode()
    whole = importance.features(text, 3)
    old, importance.PIECE = importance.PIECE, 5
    try:
        assert importance.features(text, 3) == whole
    finally:
        importance.PIECE = old
    assert whole[0] == Counter({crc32(k.encode()): n for k, n in grams(text.decode(), 3)[1].items()})
