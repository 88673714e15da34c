"""Periodic runs: Lyndon arrays and runs against brute force, and the digest query."""

import hashlib
import random
from zlib import crc32

import pytest

from tessera.llm import runs
from tessera.llm.common import table
from tests.conftest import SF_SMALL


def brute_lyndon(w):
    out = []
    for i in range(len(w)):
        j = i + 1
        while j < len(w) and w[j:] > w[i:]:
            j += 1
        out.append(j - i)
    return out


def brute_runs(w, min_words=6, repeats=4):
    found = set()
    for p in range(1, len(w) // repeats + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            n = i + p - start
            shorter = any(all(w[start + k] == w[start + k + q] for k in range(n - q)) for q in range(1, p))
            if n >= max(min_words, repeats * p) and not shorter:
                found.add((start, n, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w] if text else []
    h = crc32(str(doc_id).encode() if doc_id is not None else b"")
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = min(((-n, s, p) for s, n, p in found), default=None)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), best and best[1], best and -best[0], best and best[2], best and 1000 * -best[0] // best[2],
            sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def sample_words(rng):
    n, letters = rng.randint(0, 60), rng.choice([1, 2, 3, 8])
    w = [str(rng.randint(1, letters)) for _ in range(n)]
    if n and rng.random() < 0.6:
        p, a = rng.randint(1, 7), rng.randint(0, n - 1)
        w = [x if i < a or a + (i - a) % p >= n else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def test_lyndon_lengths_and_runs_equal_brute_force():
    rng = random.Random(11)
    for _ in range(1500):
        w = sample_words(rng)
        letters = [int(x) for x in w]
        got = runs.lyndon_lengths([0] + letters + [0], max(letters, default=0))[1:-1]
        assert got == brute_lyndon(letters)
        for repeats in (2, 3, 4):
            assert runs.find_runs(w, 6, repeats) == brute_runs(w, 6, repeats)


def test_long_periodic_texts_stay_quick():
    for w in (["a"] * 200_000, (["a"] * 400 + ["b"]) * 500, [str(i % 1000) for i in range(200_000)]):
        found = runs.find_runs(w)
        assert found and found[0][0] == 0
    assert runs.find_runs([str(i) for i in range(100_000)]) == []


@pytest.fixture(scope="module")
def edge_rows():
    rng = random.Random(5)
    rows = [(i, " ".join(sample_words(rng))) for i in range(120)]
    return rows + [(None, None), (None, "a b " * 9), (3, ""), (4, " \t\n"), (5, "x " * 7), (5, "x " * 7), (6, "é\tü\n" * 8), (7, "one two")]


def test_query_equals_brute_force_on_edge_rows(spark, edge_rows):
    docs = spark.createDataFrame([(i, t, "x", [1]) for i, t in edge_rows], "doc_id long, text string, runs string, best array<int>")
    got = sorted(map(tuple, runs.periodic_runs(docs).collect()), key=repr)
    assert got == sorted((brute_row(i, t) for i, t in edge_rows), key=repr)
    assert runs.periodic_runs(docs.limit(0)).collect() == []


def test_query_equals_brute_force_on_the_table(spark):
    docs = table(spark, SF_SMALL, "documents")
    small = docs.where("length(text) < 3000")
    want = sorted((brute_row(r["doc_id"], r["text"]) for r in small.collect()), key=repr)
    assert sorted(map(tuple, runs.periodic_runs(small).collect()), key=repr) == want


def test_word_runs_keep_spans_and_texts(spark):
    docs = spark.createDataFrame([(1, "go a b a b a b a b end"), (2, "no runs here")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in runs.word_runs(docs).collect()}
    assert [tuple(r) for r in rows[1]["runs"]] == [(1, 8, 2)]
    assert rows[1]["collapsed"] == "go a b end" and rows[2]["collapsed"] == "no runs here"
