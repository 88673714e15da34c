"""Words of texts as bytes, and 64-bit word and shingle hashes of whole texts."""

from __future__ import annotations

import re

import numpy as np

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z, on UTF-8 bytes
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: largest piece of text hashed at once; longer texts are cut at white space
PIECE_BYTES = 1 << 18

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text; null has none."""
    return [] if text is None else WORD.findall(text.encode().lower())


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    p = np.full(n + 1, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_POW, _INV = _powers(PIECE_BYTES * 2, _BASE), _powers(PIECE_BYTES * 2, _INVERSE)


def _hash_words(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of the white-space separated words of a buffer."""
    global _POW, _INV
    raw = np.frombuffer(buffer, np.uint8)
    if len(raw) >= len(_POW):
        _POW, _INV = _powers(len(raw), _BASE), _powers(len(raw), _INVERSE)
    edge = np.diff(np.concatenate(([True], _SPACE[raw], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _POW[:len(raw)], dtype=np.uint64)))
    return start, mix((total[end] - total[start]) * _INV[start] + (end - start).astype(np.uint64))


def _pieces(text: bytes):
    """The text cut at white space into pieces of at most about PIECE_BYTES."""
    while len(text) > PIECE_BYTES:
        cut = max(text.rfind(b" ", 0, PIECE_BYTES), text.rfind(b"\n", 0, PIECE_BYTES))
        if cut <= 0:
            nearest = re.search(rb"[\x20\x09-\x0d]", text)
            cut = nearest.start() if nearest and nearest.start() else 0
            if not cut:
                break
        yield text[:cut]
        text = text[cut + 1:]
    yield text


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """For each text, the 64-bit hashes of its words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased)."""
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    group, held = [], 0

    def finish():
        if not group:
            return
        low = [b for _, b in group]
        start, hashes = _hash_words(b" ".join(low))
        ends = np.searchsorted(start, np.cumsum([len(b) + 1 for b in low]))
        for (i, _), a, b in zip(group, np.concatenate(([0], ends[:-1])), ends):
            out[i] = hashes[a:b]

    for i, text in enumerate(texts):
        if not text:
            continue
        low = text.encode().lower()
        if len(low) > PIECE_BYTES:
            out[i] = np.concatenate([_hash_words(p)[1] for p in _pieces(low)])
            continue
        if held + len(low) > PIECE_BYTES:
            finish()
            group, held = [], 0
        group.append((i, low))
        held += len(low) + 1
    finish()
    return out


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width``-word shingles; fewer words make one shingle, none make none."""
    if not len(hashes):
        return hashes
    n = max(len(hashes) - width + 1, 1)
    h = np.full(n, np.uint64(min(width, len(hashes))), np.uint64)
    for k in range(min(width, len(hashes))):
        h = mix(h * _BASE + hashes[k:k + n])
    return np.unique(h)
