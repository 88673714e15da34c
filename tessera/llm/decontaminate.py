"""Operator 6, benchmark decontamination: a generalised suffix automaton of the
normalised test items, through which document words are streamed.

For every document word the automaton gives the length of the longest match that ends
there and the state of that match; the suffix links lead from it to the state of the
last ten words and to every shorter item that ends there, and states know their items.

Benchmarks are read in shards of at most ``SHARD_WORDS`` words, by whole items, so what
the driver sends to tasks is bounded; with more shards the documents pass several
times and the found intervals are merged.

Cases: null and empty texts have no words and are never hit; an item without words has
no window; an item given twice, or with a null id, counts by its id (null ids never
appear in the list); repeated documents give repeated rows; empty tables give no hits
or no rows; only the named columns are read, others pass through ``remove_spans``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import aside, map_lists, materialize
from tessera.llm.words import WORD, words

WINDOW = 10
SHARD_WORDS = 100_000


class SuffixAutomaton:
    """Generalised suffix automaton over item words, with the items of each state."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        runs = [(item, ws) for item, ws in items if ws]
        for _, ws in runs:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        full: list[set] = [set() for _ in self.next]   # items whose windows the state holds
        short: list[list] = [[] for _ in self.next]    # (words, item) of whole short items
        for item, ws in runs:
            s = 0
            for w in ws:
                s = self.next[s][w]
                t = s
                while t > 0 and self.length[t] >= window and item not in full[t]:
                    full[t].add(item)
                    t = self.link[t]
            if len(ws) < window:
                s = 0
                for w in ws:
                    s = self.next[s][w]
                short[s].append((len(ws), item))
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            short[s] = short[s] + short[self.link[s]]
        self.full, self.short = full, short
        self.least = min([window, *(len(ws) for _, ws in runs)])

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = c
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def scan(self, ws: list[bytes]) -> tuple[list[int], set]:
        """Merged word intervals [start, end, start, end, ...) of all occurring windows, and their items."""
        nxt, link, length, window, least = self.next, self.link, self.length, self.window, self.least
        state = matched = 0
        spans: list[list[int]] = []
        items: set = set()
        for i, w in enumerate(ws):
            while w not in nxt[state] and state:
                state = link[state]
                matched = length[state]
            if w not in nxt[state]:
                continue
            state = nxt[state][w]
            matched += 1
            if matched < least:
                continue
            size = 0
            for k, item in self.short[state]:
                if k <= matched:
                    size = max(size, k)
                    items.add(item)
            if matched >= window:
                size, s = window, state
                while length[link[s]] >= window:
                    s = link[s]
                items |= self.full[s]
            if size:
                start = i + 1 - size
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return [x for s in spans for x in s], items


def _merge(spans: list[int]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def item_shards(benchmark: DataFrame, shard_words: int = SHARD_WORDS):
    """Lists of (item id as text, words) of at most ``shard_words`` words (one item more at most);
    items stream to the driver one partition at a time and only one shard is held."""
    held, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        held.append((row["item_id"], words(row["text"])))
        n += len(held[-1][1])
        if n >= shard_words:
            yield held
            held, n = [], 0
    yield held


def _scanner(items: list, window: int):
    def make():
        automaton = SuffixAutomaton(items, window)

        def step(cols):
            n, spans, hit = [], [], []
            for text, old, had in zip(cols["text"], cols["_item_spans"], cols["_item_items"]):
                ws = words(text)
                s, i = automaton.scan(ws)
                n.append(len(ws))
                spans.append(_merge(old + s) if old else s)
                hit.append(sorted({*had, *(x for x in i if x is not None)}))
            return cols | {"_item_n_words": n, "_item_spans": spans, "_item_items": hit}
        return step
    return make


def _all_but_last(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> tuple:
    """``docs`` scanned for all shards of the benchmark but the last, and the last one's scanner for ``map_lists``:
    with what follows it, it makes one pass of one Python worker a task."""
    names = [c for c in docs.columns if c not in ("_item_n_words", "_item_spans", "_item_items")]
    found = docs.select(*names, F.lit(0).cast("long").alias("_item_n_words"), F.array().cast("array<long>").alias("_item_spans"), F.array().cast("array<string>").alias("_item_items"))
    schema, scan = found.schema, None
    for items in item_shards(benchmark, shard_words):
        if scan:
            found = materialize(map_lists(found, schema, scan), "decontaminate")
        scan = _scanner(items, window)
    return found, schema, scan


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with ``_item_n_words``, ``_item_spans`` (merged word intervals, start and end in turn) and
    ``_item_items`` (distinct items as text)."""
    return map_lists(*_all_but_last(docs, benchmark, window, shard_words))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_spans(docs.select("doc_id", "text"), benchmark, **options).drop("text")
    n_hit = F.expr("aggregate(transform(_item_spans, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (a, x) -> a + x)")
    return found.select("doc_id", F.col("_item_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_item_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("_item_items", ","), 256).alias("items_sha256"), (F.size("_item_spans") > 0).alias("contaminated"))


def cut_words(text: str, spans: list[int]) -> str:
    """The text without the words of the given intervals."""
    raw, out, at = text.encode(), [], 0
    places = [m.span() for m in WORD.finditer(raw.lower())]
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(raw[at:places[a][0]])
        at = places[b - 1][1]
    return (b"".join(out) + raw[at:]).decode()


def remove_spans(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.5, **options) -> DataFrame:
    """``docs`` (same columns) with contaminated spans cut out of the text; documents of which
    more than ``max_coverage`` of the words are hit go.  Clean documents are unchanged.
    The length limit is the window: every run that reaches it is cut whole."""
    return aside(docs, ["_item_n_words", "_item_spans", "_item_items"], lambda d: _without_spans(d, benchmark, max_coverage, options))


def _without_spans(docs: DataFrame, benchmark: DataFrame, max_coverage: float, options: dict) -> DataFrame:
    names, schema = docs.columns, docs.schema
    found, _, scan = _all_but_last(docs, benchmark, **options)

    def make():
        scanned = scan()

        def step(cols):
            cols = scanned(cols)
            keep, texts = [], []
            for i, (text, n, spans) in enumerate(zip(cols["text"], cols["_item_n_words"], cols["_item_spans"])):
                hit = sum(spans[1::2]) - sum(spans[::2])
                if hit <= max_coverage * n:
                    keep.append(i)
                    texts.append(cut_words(text, spans) if spans else text)
            return {c: [cols[c][i] for i in keep] for c in names} | {"text": texts}
        return step

    return map_lists(found, schema, make)
