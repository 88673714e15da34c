"""Token lookups by chunk: the tokenizers library encodes each distinct chunk once
per Python worker, and texts are read as runs of chunks.

The two vocabularies split a text before merging (a word never merges with its
neighbour), so the ids of a text are the ids of its chunks in a row whenever the
chunks are cut where the splitter always cuts.  Texts for which that isn't certain
(special strings, runs of white space, rare white space) go to the library whole.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.common import kept

#: texts are read together up to so many characters; speed and memory only
BATCH_CHARS = 8_000_000
#: so many chunks not seen yet are encoded as one text, and so many such texts at a time
JOINED, JOINED_TEXTS = 256, 64
#: so many entries a cache keeps, some 60 bytes each in ``ByteIds`` and 150 in ``_Cache``, which keeps as many older ones; speed only
CACHE_ENTRIES = 750_000
#: longer chunks are encoded each time
CACHE_CHARS = 48
#: white space other than the blank and the line feed, and what only Python counts as such
_ODD_SPACE = re.compile("[%s]" % "".join(map(re.escape, map(chr, [9, 11, 12, 13, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))))
_CONTROL_SPACE = re.compile("[\x1c-\x1f]")


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def _latin(c: str) -> bool:
    return c.isalpha() and ord(c) < 0x250


_LATIN = np.array([c < 0x250 and chr(c).isalpha() for c in range(0x280)])
#: factors of ``_hashes``: a byte's, and its place's in the key
_BYTE, _PLACE = np.split(np.random.default_rng(1).integers(1, 1 << 63, 256 + 64, np.uint64) * np.uint64(2) + np.uint64(1), [256])


def _strings(kind: pa.DataType, lens: np.ndarray, raw: np.ndarray) -> pa.Array:
    """An array of ``kind`` whose values lie in ``raw`` one after the other, ``lens`` bytes each."""
    offsets = np.concatenate(([0], np.cumsum(lens))).astype(np.int64)
    return pa.Array.from_buffers(kind, len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that a large string or binary array lies in, and where its values begin and the last one ends."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2] or b"", np.uint8), offsets


def _hashes(keys: pa.Array) -> np.ndarray:
    """64-bit hashes of strings of which none is empty, from their first bytes and their lengths; equal ones may be of different strings."""
    raw, offsets = _bytes(keys)
    lens = np.diff(offsets)
    some = np.minimum(lens, len(_PLACE))
    starts = np.cumsum(some) - some
    place = np.arange(some.sum()) - np.repeat(starts, some)
    return np.add.reduceat(_BYTE[raw[np.repeat(offsets[:-1], some) + place]] * _PLACE[place], starts) + lens.astype(np.uint64)


def byte_ids(path: str, entries: int = CACHE_ENTRIES, batch_chars: int = BATCH_CHARS) -> ByteIds:
    """One instance per Python worker, kept while tasks ask for it."""
    return kept(("byte_ids", path, entries, batch_chars), lambda: ByteIds(path, entries, batch_chars))


@functools.cache
def word_counts(path: str) -> WordCounts:
    return WordCounts(path)


class _Cache(dict):
    """Value of a chunk; a missing one is made from the library's ids."""

    def __init__(self, tokenizer, value, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.tokenizer, self.value, self.entries = tokenizer, value, entries
        self.older: dict = {}

    def __missing__(self, chunk: str):
        made = self.older.get(chunk)
        if made is not None:  # still in use: recent again
            pass
        elif len(chunk) > 1 and chunk[-1] in ".," and _latin(chunk[-2]):  # letters and marks never merge
            made = self[chunk[:-1]] + self.value(self.tokenizer.encode(chunk[-1], add_special_tokens=False).ids)
        else:
            made = self.value(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[chunk] = made
        return made


class ByteIds:
    """Ids of whole texts under the byte-level vocabulary, as little-endian unsigned
    32-bit integers: ``ByteIds(path)(text) -> bytes``, ``ByteIds(path).batch(texts) -> [bytes]``.

    A chunk's first character says what stands before it: a line feed or, for the first
    chunk of a text, a tab (texts with tabs are encoded whole) has nothing before it, any
    other a blank.  A batch splits its texts and numbers their distinct chunks in Arrow,
    looks each distinct chunk up once, and gathers the ids by these numbers.  A chunk is
    known by its key: a last point or comma after a letter is left off, as letters and marks
    never merge, and a tab stands for a line feed.  Keys not seen yet are encoded many at a
    time, joined by blanks or by line feeds: the ids that begin with the joint are where they begin.

    The cache is two Arrow arrays, keys and their ids, and the keys' hashes in order, searched for
    whole batches; a key found by its hash is compared.  Some 60 bytes an entry, no Python object for any."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES, batch_chars: int = BATCH_CHARS):
        self.tokenizer, self.entries, self.batch_chars = load(path), entries, batch_chars
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keys, self.runs = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.used, self.batches = np.zeros(0, np.int32), 0
        #: hashes of the keys, ascending, and the keys' places
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.before = pa.array([b"", self._encode("\n")], pa.large_binary())
        self.after = pa.array([b"", self._encode("."), self._encode(",")], pa.large_binary())
        blank = self.tokenizer.id_to_token(self.tokenizer.encode(" ", add_special_tokens=False).ids[0])
        self.blank = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.blank[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(blank)]] = True
        self.feed = np.zeros(len(self.blank), bool)
        self.feed[np.frombuffer(self.before[1].as_py(), "<u4")] = True

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def _encode(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _joined(self, chunks: pa.Array, joint: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks in a row, and how many each has; after a blank these count it, after a line feed they don't."""
        raw, offsets = _bytes(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), chunks, pa.scalar(joint, pa.large_string())))
        cuts = [*offsets[:-1:JOINED].tolist(), int(offsets[-1])]
        texts = [raw[a:b].tobytes().decode() for a, b in zip(cuts, cuts[1:])]
        # without offsets in the texts, which nobody reads here
        ids = np.concatenate([np.array(e.ids, "<u4") for at in range(0, len(texts), JOINED_TEXTS)
                              for e in self.tokenizer.encode_batch_fast(texts[at:at + JOINED_TEXTS], add_special_tokens=False)])
        first = (self.blank if joint == " " else self.feed)[ids]
        starts = np.flatnonzero(first)
        if len(starts) != len(chunks):
            raise ValueError(f"{len(chunks)} chunks begin at {len(starts)} ids: not a byte-level vocabulary that splits at blanks")
        lens = np.diff(np.append(starts, len(ids)))
        return (ids, lens) if joint == " " else (ids[~first], lens - 1)

    def _encoded(self, keys: pa.Array) -> pa.Array:
        """Ids of keys not seen yet."""
        bare = pc.starts_with(keys, "\t")
        groups = [(" ", keys.filter(pc.invert(bare))), ("\n", pc.utf8_slice_codeunits(keys.filter(bare), 1))]
        parts = [self._joined(group, joint) for joint, group in groups if len(group)]
        runs = _strings(pa.large_binary(), np.concatenate([lens for _, lens in parts]) * 4, np.concatenate([ids for ids, _ in parts]))
        order = np.argsort(bare.to_numpy(zero_copy_only=False), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return runs.take(pa.array(place))

    def _find(self, keys: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Places of distinct keys in the cache, -1 where it has none."""
        found = np.full(len(keys), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            like = np.flatnonzero(self.hashes[at] == hashes)
            places = self.places[at[like]]
            same = pc.equal(self.keys.take(pa.array(places)), keys.take(pa.array(like))).to_numpy(zero_copy_only=False)
            found[like[same]] = places[same]
        return found

    def _known(self, keys: pa.Array) -> pa.Array:
        """Ids of distinct keys; new ones are kept, and the longest unused go beyond ``entries``."""
        self.batches += 1
        hashes = _hashes(keys)
        at = self._find(keys, hashes)
        gone = at < 0
        seen = at[~gone]
        self.used[seen] = self.batches
        if not gone.any():
            return self.runs.take(pa.array(at))
        new = keys.filter(pa.array(gone))
        runs = self._encoded(new)
        found = pa.concat_arrays([self.runs.take(pa.array(seen)), runs]).take(pa.array(np.where(gone, len(seen) + np.cumsum(gone), np.cumsum(~gone)) - 1))
        self._keep(new, runs, hashes[gone])
        return found

    def _keep(self, new: pa.Array, runs: pa.Array, hashes: np.ndarray) -> None:
        short = np.flatnonzero(pc.utf8_length(new).to_numpy() <= CACHE_CHARS)[:self.entries]
        if len(self.keys) + len(short) > self.entries:
            left = np.sort(np.argsort(-self.used, kind="stable")[:min(self.entries // 2, self.entries - len(short))])
            place = np.full(len(self.keys), -1, np.int32)
            place[left] = np.arange(len(left), dtype=np.int32)
            stay = place[self.places] >= 0
            self.hashes, self.places = self.hashes[stay], place[self.places[stay]]
            self.keys, self.runs, self.used = self.keys.take(pa.array(left)), self.runs.take(pa.array(left)), self.used[left]
        # one key a hash
        hashes, first = np.unique(hashes[short], return_index=True)
        at = np.searchsorted(self.hashes, hashes)
        free = np.append(self.hashes, np.uint64(0))[at] != hashes
        hashes, at, short = hashes[free], at[free], short[first[free]]
        self.hashes = np.insert(self.hashes, at, hashes)
        self.places = np.insert(self.places, at, np.arange(len(self.keys), len(self.keys) + len(short), dtype=np.int32))
        self.keys = pa.concat_arrays([self.keys, new.take(pa.array(short))])
        self.runs = pa.concat_arrays([self.runs, runs.take(pa.array(short))])
        self.used = np.concatenate((self.used, np.full(len(short), self.batches, np.int32)))

    def _values(self, chunks: pa.Array) -> pa.Array:
        """Ids of distinct chunks, each with its first character as described above."""
        raw, offsets = _bytes(chunks)
        starts, ends = offsets[:-1], offsets[1:]
        last, one, two = (raw[np.maximum(ends - k, starts)] for k in (1, 2, 3))
        letter = _LATIN[np.where(one < 0x80, one, np.where((two >= 0xC2) & (two <= 0xC9), (two & 0x1F).astype(np.int64) << 6 | one & 0x3F, 0))]
        mark = np.where(letter & (ends - starts > 2), (last == ord(".")) + 2 * (last == ord(",")), 0)
        feed = raw[starts] == ord("\n")
        lens = ends - starts - (mark > 0)
        to = np.cumsum(lens)
        kept = raw[np.repeat(starts - to + lens, lens) + np.arange(to[-1])]
        kept[(to - lens)[feed]] = ord("\t")
        keys = _strings(pa.large_string(), lens, kept).dictionary_encode()
        runs = self._known(keys.dictionary).take(keys.indices)
        return pc.binary_join_element_wise(self.before.take(pa.array(feed.astype(np.int8))), runs, self.after.take(pa.array(mark)), pa.scalar(b"", pa.large_binary()))

    def _chunked(self, text: str) -> str | None:
        """The text with its chunks parted by single blanks, or None where it goes to the library whole."""
        # a single blank, or a single line feed, between two other characters always starts a new piece
        spaced = text.replace("\n", " \n")
        if "  " in spaced or "\n " in spaced or spaced[0] == " " or spaced[-1] in " \n" or _ODD_SPACE.search(text) or any(s in text for s in self.special):
            return None
        return "\t" + spaced

    def __call__(self, text: str | None) -> bytes:
        return self.batch([text])[0]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        out, held, places, size = [b""] * len(texts), [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            chunked = self._chunked(text)
            if chunked is None:
                out[i] = self._encode(text)
                continue
            held.append(chunked)
            places.append(i)
            size += len(chunked)
            if size >= self.batch_chars:
                self._gather(held, places, out)
                held, places, size = [], [], 0
        if held:
            self._gather(held, places, out)
        return out

    def _gather(self, chunked: list[str], places: list[int], out: list[bytes]) -> None:
        parts = pc.split_pattern(pa.array(chunked, pa.large_string()), " ")
        numbered = parts.values.dictionary_encode()
        ids = self._values(numbered.dictionary).take(numbered.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[parts.offsets.to_numpy()].tolist()
        raw = memoryview(ids.buffers()[2])
        for i, a, b in zip(places, ends, ends[1:]):
            out[i] = raw[a:b].tobytes()


class WordCounts:
    """Token counts under the word vocabulary, which drops white space: for a text,
    the counts of its white-space separated chunks, or None where the whole text
    has to be encoded."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = _Cache(self.tokenizer, len)

    def split(self, text: str) -> list[str] | None:
        if any(s in text for s in self.special) or _CONTROL_SPACE.search(text):
            return None
        return text.split()

    def counts(self, chunks: list[str]) -> np.ndarray:
        cache = self.cache
        return np.array([cache[c] for c in chunks], np.int64)

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
