"""Operator 4, token counts: prefix dynamic programming.

For every text the operator stores the exact token count at the end of every chunk
(white-space separated run), built by the recurrence count(prefix + chunk) =
count(prefix) + count(chunk); chunks never merge under the word vocabulary.  Inside a
chunk the same is done per character by ``PieceDp``: the last token of every prefix
follows from the last tokens of shorter prefixes, without running the merges.  From
these tables come truncation points and budget answers without encoding again: a cut is the
longest prefix within the budget, inside a chunk too.

Cases: null and empty texts have 0 bytes and 0 tokens; special strings inside texts
count as the library counts them, and are entries of the table of their own; repeated
rows give repeated results; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import sys
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.chunks import word_counts
from tessera.llm.common import map_lists


#: what the vocabulary's splitter drops (Python counts \\x1c-\\x1f as white space too, the splitter doesn't)
SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_CHUNK = re.compile(f"[^{SPACE}]+")


@functools.cache
def _joining() -> frozenset[str]:
    """Characters that NFC may join with, or move before, the one in front of them."""
    found = set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
    for c in map(chr, range(sys.maxunicode + 1)):
        if unicodedata.combining(c):
            found.add(c)
        elif (d := unicodedata.decomposition(c)) and d[0] != "<" and " " in d:
            found.add(chr(int(d.split()[1], 16)))
    return frozenset(found)


class PieceDp:
    """Exact token counts at every prefix of one pre-split piece, for merge
    vocabularies with an end-of-word mark.

    A sequence of tokens is what the merges give exactly if each adjacent pair is
    what they give for the two joined.  So the last token of a prefix is the one that
    fits the last token of the prefix before it."""

    def __init__(self, path: str):
        with open(path, encoding="utf8") as f:
            model = json.load(f)["model"]
        self.vocab, self.mark = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.longest = max(len(t.removesuffix(self.mark)) for t in self.vocab)
        self.fits: dict[tuple[str, str], bool] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            best = min(((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:]))))
            if best[0] == 1 << 60:
                break
            left, right = symbols[best[1]:best[1] + 2]
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and symbols[i] == left and symbols[i + 1] == right:
                    out.append(left + right)
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def _alone(self, token: str) -> list[str]:
        body = token.removesuffix(self.mark) if token.endswith(self.mark) and self.mark else token
        symbols = list(body)
        if body != token:
            symbols[-1] += self.mark
        return symbols

    def pair_fits(self, left: str, right: str) -> bool:
        key = (left, right)
        if key not in self.fits:
            self.fits[key] = self.merged(list(left) + self._alone(right)) == [left, right]
        return self.fits[key]

    def counts(self, piece: str, budget: int | None = None) -> list[int]:
        """Token counts of piece[:1], piece[:2], ... each closed by the end mark; with a budget, up to
        where all longer prefixes exceed it."""
        inner: list[tuple[int, str]] = [(0, "")]  # count and last token of each open prefix
        closed = []
        over = 0  # so many open prefixes in a row leave nothing for another token
        for end in range(1, len(piece) + 1):
            over = over + 1 if budget is not None and inner[-1][0] >= budget else 0
            if over > self.longest:
                break
            for marked in (False, True):
                for size in range(min(end, self.longest), 0, -1):
                    token = piece[end - size:end] + (self.mark if marked else "")
                    if token not in self.vocab:
                        continue
                    n, last = inner[end - size]
                    if (self.merged(self._alone(token)) == [token]) if end == size else self.pair_fits(last, token):
                        (closed.append(n + 1) if marked else inner.append((n + 1, token)))
                        break
        return closed


class PrefixCounter:
    """Prefix table of a text, and the questions it answers."""

    def __init__(self, path: str):
        self.words, self.path, self.dp = word_counts(path), path, None

    def _units(self, text: str) -> list[tuple[int, int, bool]]:
        """(start, end, special) of the special strings and the chunks between them."""
        out, at = [], 0
        for special in [*re.finditer("|".join(map(re.escape, self.words.special)) or "(?!)", text), None]:
            out += [(m.start(), m.end(), False) for m in _CHUNK.finditer(text, at, special.start() if special else len(text))]
            if special:
                out.append((special.start(), special.end(), True))
                at = special.end()
        return out

    def table(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(ends, counts): the text up to character ends[i] has counts[i] tokens."""
        if not text:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        chunks = self.words.split(text)
        if chunks is None:
            units = self._units(text)
            each = [1 if special else self.words.whole(text[a:b]) for a, b, special in units]
            return np.array([b for _, b, _ in units], np.int64), np.cumsum(np.array(each, np.int64))
        ends, at = np.empty(len(chunks), np.int64), 0
        for i, c in enumerate(chunks):
            at = text.index(c, at) + len(c)
            ends[i] = at
        return ends, np.cumsum(self.words.counts(chunks))

    def total(self, text: str | None) -> int:
        """The last entry of the table, without the positions."""
        if not text:
            return 0
        chunks = self.words.split(text)
        return self.words.whole(text) if chunks is None else int(self.words.counts(chunks).sum())

    def _pieces(self, part: str) -> list[str]:
        if self.dp is None:
            self.dp = PieceDp(self.path)
        tok = self.words.tokenizer
        return [p for p, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(part))]

    def _inside(self, part: str) -> int:
        """Count of one chunk's beginning, by the pieces' dynamic programs."""
        return sum(self.dp.counts(p)[-1] for p in self._pieces(part))

    def _open(self, text: str, ends, counts, k: int) -> tuple[int, int, int]:
        """(start, done, end): where the k-th entry's part of the text begins, the count before it, and
        how far the part goes.  An incomplete special string is plain text and belongs to the chunk
        that it follows."""
        end = int(ends[k])
        if self.words.split(text) is None:
            units = self._units(text)
            if units[k][2]:
                end -= 1
                if k and units[k - 1][1] == units[k][0] and not units[k - 1][2]:
                    k -= 1
            elif k + 1 < len(units) and units[k + 1][2] and units[k + 1][0] == end:
                end = units[k + 1][1] - 1
            start = units[k][0]
        else:
            start = int(ends[k - 1]) if k else 0
            start = end - len(text[start:end].lstrip(SPACE))
        return start, int(counts[k - 1]) if k else 0, end

    def _reach(self, part: str, budget: int) -> int:
        """How many characters the longest prefix of a part without white space has that is within the budget."""
        pieces, norm = self._pieces(part), self.words.tokenizer.normalizer.normalize_str
        joining = _joining()
        starts = [i for i, c in enumerate(part) if not i or c not in joining]
        ends = [*starts[1:], len(part)]
        sizes = np.cumsum([len(norm(part[a:b]).encode()) for a, b in zip(starts, ends)])  # ends in normalized bytes
        best, done, at, x = 0, 0, 0, 0
        anchors = [(0, 0)]  # (character, count) where a piece and a group of joining characters end
        for p in pieces:
            if p[0] == "'" and p[1:2].isascii() and p[1:2].isalpha():  # an incomplete contraction is split
                closed = [self._inside(p[:j]) for j in range(1, len(p) + 1)]
            else:
                closed = self.dp.counts(p, budget - done)
            while x < len(ends) and sizes[x] <= at + len(closed):
                if done + closed[sizes[x] - at - 1] <= budget:
                    best = ends[x]
                x += 1
            at += len(closed)
            if len(closed) < len(p):
                break
            done += closed[-1]
            if x and sizes[x - 1] == at:
                anchors.append((ends[x - 1], done))
            if done > budget:
                break
        # cuts inside a group, up to the one in which all prefixes exceed the budget
        inner = [k for a, b in zip(starts[:x + 1], ends[:x + 1]) if b > best for k in range(a + 1, b)]
        for k in sorted(inner, reverse=True):
            if k <= best:
                break
            start, before = anchors[bisect.bisect_right(anchors, (k, -1)) - 1]
            if before + self._inside(part[start:k]) <= budget:
                return k
        return best

    def at(self, text: str, chars: int, table=None) -> int:
        """Exact token count of ``text[:chars]``."""
        ends, counts = table or self.table(text)
        k = bisect.bisect_right(ends, chars)
        if k == len(ends):
            return int(counts[k - 1]) if k else 0
        if k and ends[k - 1] == chars:
            return int(counts[k - 1])
        start, done, _ = self._open(text, ends, counts, k)
        rest = text[start:chars]
        return done + self._inside(rest) if rest else int(counts[k - 1]) if k else 0

    def cut(self, text: str | None, budget: int) -> int:
        """Characters of the longest prefix whose count is within the budget, without white space at its end."""
        ends, counts = self.table(text)
        k = int(np.searchsorted(counts, budget, side="right"))
        if k == len(ends):
            return int(ends[k - 1]) if k else 0
        start, done, end = self._open(text, ends, counts, k)
        more = self._reach(text[start:end], budget - done)
        return start + more if more else int(ends[k - 1]) if k else 0


def prefix_tables(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ends, counts: the stored prefix table of every whole text."""
    def make():
        counter = PrefixCounter(tokenizer_path)

        def step(cols):
            made = [counter.table(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "ends": [e for e, _ in made], "counts": [c for _, c in made]}
        return step

    return map_lists(docs.select("doc_id", "text"), "doc_id long, ends array<long>, counts array<long>", make)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, kept_chars: exact counts of whole texts, and
    how many characters the longest prefix within ``limit`` tokens keeps."""
    def make():
        counter = PrefixCounter(tokenizer_path)

        def step(cols):
            texts = cols["text"]
            n = [counter.total(t) for t in texts]
            return {"doc_id": cols["doc_id"], "n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_tokens": n,
                    "kept_chars": [counter.cut(t, limit) if k > limit else len(t or "") for t, k in zip(texts, n)]}
        return step

    rows = map_lists(docs.select("doc_id", "text"), "doc_id long, n_bytes long, n_tokens long, kept_chars long", make)
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "kept_chars")
