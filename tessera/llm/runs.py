"""Operator 11, periodic runs of words by Lyndon grouping.

A run is a stretch of words with smallest period q that cannot be extended.  Every run holds,
under one of the two orders of the alphabet (any order and its reverse), Lyndon words of
length q one after the other, each the longest Lyndon word from its place on.  So the
candidates are the entries of two Lyndon arrays:

* Grouping (phase one of Baier's suffix sorter).  Places with one letter form a group; the
  groups are handled from the highest letter down.  A handled group with context u leaves the
  list of open places; the open place before each of its members takes u (as often as
  members follow it) onto its own context and moves to a new group just above its old one.
  When all are handled, a place's context is the longest Lyndon word that starts there: the
  sorter's first phase gives the Lyndon array directly, and its second phase is not needed.
* Roots.  A run of at least ``repeats`` periods holds ``repeats - 1`` neighbouring Lyndon roots
  of one length.  The first root of such a chain is extended to both sides by the longest
  common extension of a place and the place one period on, compared in blocks that double;
  roots inside the run found are passed over.  Longest Lyndon words are nested or apart, so
  the extensions together compare O(n log n) words.

Words that occur fewer than ``repeats`` times in the text cannot lie in such a run; they and
stretches between them that are too short become one separator, smaller than every letter
under both orders, which no Lyndon word from a letter on contains.  This loses no run.

Bounds: a text is handled by one task, with memory in proportion to that text; nothing is
shuffled, collected or broadcast.

Cases: null and blank texts have no words, no runs, and the digests of the empty text; equal
rows get equal results; runs may overlap, and equal lengths are told apart by start, then
period; a null doc_id is the empty text to crc32 (h = 0); an empty table gives no rows; other
columns are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_lists

MIN_WORDS = 6
REPEATS = 4
#: words compared at first by an extension; doubles as long as all agree
BLOCK = 16


def lyndon_lengths(letters: list[int], n_letters: int) -> list[int]:
    """Length of the longest Lyndon word from each place on.  Letters are 1..n_letters; 0 is a
    separator and gets 0.  ``letters`` must begin and end with a separator."""
    n = len(letters)
    members: list[list[int]] = [[] for _ in range(n_letters + 1)]
    for i, letter in enumerate(letters):
        members[letter].append(i)
    alive = [len(m) for m in members]
    context = [1] * (n_letters + 1)
    below = list(range(-1, n_letters))
    above = list(range(1, n_letters + 2))
    group = list(letters)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    length = [0] * n
    current = n_letters
    while current > 0:
        u = context[current]
        if alive[current]:
            before: dict[int, int] = {}
            for i in members[current]:
                if group[i] == current:
                    length[i] = u
                    j, k = left[i], right[i]
                    right[j], left[k] = k, j
                    before[j] = before.get(j, 0) + 1
            if len(before) == 1:
                (j, times), = before.items()
                moves = [((times, group[j]), [j])] if group[j] else []
            else:
                moved: dict[tuple[int, int], list[int]] = {}
                for j, times in before.items():
                    if group[j]:
                        moved.setdefault((times, group[j]), []).append(j)
                moves = sorted(moved.items(), reverse=True) if len(moved) > 1 else list(moved.items())
            for (times, old), places in moves:
                if len(places) == alive[old]:  # the whole group takes u: it stays where it is
                    context[old] += times * u
                    continue
                new = len(context)
                alive[old] -= len(places)
                alive.append(len(places))
                context.append(context[old] + times * u)
                members.append(places)
                for j in places:
                    group[j] = new
                up = above[old]
                below.append(old)
                above.append(up)
                below[up] = new
                above[old] = new
        members[current] = ()
        current = below[current]
    return length


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    n, at, block = min(len(a), len(b)), 0, BLOCK
    while at < n:
        end = min(at + block, n)
        different = a[at:end] != b[at:end]
        first = int(different.argmax())
        if different[first]:
            return at + first
        at, block = end, block * 2
    return n


def _candidates(ids: np.ndarray, min_words: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """The places that may lie in a run, with separators between their stretches: (letters from
    1 on, 0 for a separator; place of each letter)."""
    at = np.arange(len(ids))
    letters = ids + 1
    keep = np.bincount(ids)[ids] >= repeats
    edges = np.flatnonzero(np.diff(np.concatenate(([False], keep, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= min_words
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    parts, places = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for a, b in zip(starts.tolist(), ends.tolist()):
        parts += [letters[a:b], np.zeros(1, np.int64)]
        places += [at[a:b], np.zeros(1, np.int64)]
    return np.concatenate(parts), np.concatenate(places)


def find_runs(words: list, min_words: int = MIN_WORDS, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least max(min_words, repeats * period) words,
    by start, then period."""
    if len(words) < min_words:
        return []
    seen: dict = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    letters, places = _candidates(ids, min_words, repeats)
    if len(letters) == 1:
        return []
    used, dense = np.unique(letters, return_inverse=True)  # 0 stays 0
    top = len(used) - 1
    backwards = ids[::-1]
    n, found = len(ids), set()
    for order in (dense, np.where(dense > 0, top + 1 - dense, 0)):
        length = np.array(lyndon_lengths(order.tolist(), top), np.int64)
        chain = length > 0
        for k in range(1, repeats - 1):  # the next roots have the same length
            to = np.minimum(np.arange(len(length)) + k * length, len(length) - 1)
            chain &= length[to] == length
        covered: dict[int, int] = {}
        for k in np.flatnonzero(chain).tolist():
            i, p = int(places[k]), int(length[k])
            if i < covered.get(p, 0):
                continue
            after = _common(ids[i:], ids[i + p:])
            ahead = _common(backwards[n - i:], backwards[n - i - p:])
            start, words_long = i - ahead, ahead + p + after
            if words_long >= max(min_words, repeats * p):
                found.add((start, words_long, p))
                covered[p] = start + words_long - p
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(words: list, doc_id) -> list:
    """Every tenth document (by the crc32 of its id) repeats a stretch of itself to its end."""
    h = crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    stretch = words[a:a + p]
    return words[:a] + (stretch * ((n - a) // p + 1))[:n - a]


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that only repeat a run's first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def word_runs(docs: DataFrame, min_words: int = MIN_WORDS, repeats: int = REPEATS, plant: bool = False) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start, then period) and the collapsed text of
    every document; ``plant`` first makes every tenth text periodic (``planted``)."""
    def make():
        def scan(columns):
            runs_of, texts = [], []
            for doc_id, text in zip(columns["doc_id"], columns["text"]):
                words = (text or b"").split()
                words = planted(words, doc_id) if plant else words
                runs = find_runs(words, min_words, repeats)
                runs_of.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                texts.append(b" ".join(collapse(words, runs)).decode("utf-8", "replace"))
            return {"doc_id": columns["doc_id"], "runs": runs_of, "collapsed": texts}
        return scan

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_lists(docs.select("doc_id", F.col("text").cast("binary").alias("text")),
                     f"doc_id {id_type}, runs array<struct<start:long,length:long,period:long>>, collapsed string", make)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs; start, length, period, exponent_milli of the longest run; runs_sha256, collapsed_sha256."""
    def line(r):
        return F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))

    found = word_runs(docs, plant=True)
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    found = found.withColumn("best", first)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.n")).alias("length"),
        F.col("best.period").alias("period"), F.floor(-1000 * F.col("best.n") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
