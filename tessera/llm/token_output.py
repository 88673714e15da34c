"""Operator 10, token-ID / binary output: directly addressable codes.

A segment holds the ids of consecutive documents.  Ids are split into chunks of 8
bits; level 0 has the lowest chunk of every id, level k the k-th chunk of those ids
that need it.  A continuation bitmap per level says which ids go on, and a rank
directory (set bits before every 512-bit block) finds the place of an id on the next
level, so any token is read by itself, without decoding a block.

Files are Parquet tables of segments (one row each) written by Spark's committer, so
they work on every store Spark writes to and survive lost executors.

Cases: null and empty texts have no ids of their own (only the end id); null doc_ids
come first; repeated rows and equal doc_ids each keep their own run of ids, equal ids
in text order; an empty table gives no segment; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.chunks import BATCH_CHARS, CACHE_ENTRIES, byte_ids
from tessera.llm.common import map_lists, shared_path

BITS = 8
BLOCK = 512
#: a segment is closed at this many ids (a document is never divided)
SEGMENT_IDS = 1 << 18

SEGMENTS = "part int, segment int, start_in_part long, n_docs long, n_ids long, doc_ids binary, doc_nulls binary, doc_lens binary, codes binary"


def encode_codes(ids: np.ndarray) -> bytes:
    """Directly addressable codes of an id array."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> BITS
        go_on = more > 0
        bits = np.packbits(go_on, bitorder="little")
        bits = np.concatenate((bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)))
        ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(1))))[:-1] if len(bits) else np.zeros(0)
        levels.append((len(rest), (rest & ((1 << BITS) - 1)).astype(np.uint8).tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()))
        if not go_on.any():
            break
        rest = more[go_on]
    head = struct.pack("<II", len(ids), len(levels)) + b"".join(struct.pack("<IIII", n, len(c), len(b), len(r)) for n, c, b, r in levels)
    return head + b"".join(x for _, c, b, r in levels for x in (c, b, r))


class Codes:
    """Reader of one segment's codes: ``codes[i]`` touches one chunk, bit and rank a level."""

    def __init__(self, raw: bytes):
        self.n, k = struct.unpack_from("<II", raw)
        at, self.levels = 8 + 16 * k, []
        for i in range(k):
            _, c, b, r = struct.unpack_from("<IIII", raw, 8 + 16 * i)
            self.levels.append((np.frombuffer(raw, np.uint8, c, at), np.frombuffer(raw, np.uint8, b, at + c), np.frombuffer(raw, "<u4", r // 4, at + c + b)))
            at += c + b + r

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << (BITS * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            inside = bits[block * BLOCK // 8: (i >> 3) + 1].copy()
            inside[-1] &= (1 << (i & 7)) - 1
            i = int(ranks[block]) + int(np.bitwise_count(inside).sum())
        return value

    def decode(self) -> np.ndarray:
        out = np.zeros(self.n, np.uint32)
        at = np.arange(self.n)
        for k, (chunk, bits, _) in enumerate(self.levels):
            out[at] |= chunk.astype(np.uint32) << np.uint32(BITS * k)
            at = at[np.unpackbits(bits, count=len(at), bitorder="little").astype(bool)]
        return out


def write_segments(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, cache_entries: int = CACHE_ENTRIES, batch_chars: int = BATCH_CHARS) -> None:
    """Encode ``doc_id, text`` in ascending doc_id order and write segment files to ``path``.

    The range exchange moves compressed text once; encoding comes after it, so nothing is
    encoded twice and no id array is shuffled.  Ties of doc_id are ordered by text."""
    end = np.array([end_id], "<u4").tobytes()

    def make():
        encode, part = byte_ids(tokenizer_path, cache_entries, batch_chars), TaskContext.get().partitionId()
        held: list[tuple[int | None, bytes]] = []
        state = {"segment": 0, "start": 0, "ids": 0}

        def close() -> dict:
            runs = [b for _, b in held]
            ids = np.frombuffer(b"".join(runs), "<u4")
            row = {"part": part, "segment": state["segment"], "start_in_part": state["start"], "n_docs": len(held), "n_ids": len(ids),
                   "doc_ids": np.array([i or 0 for i, _ in held], "<i8").tobytes(), "doc_nulls": np.packbits([i is None for i, _ in held], bitorder="little").tobytes(),
                   "doc_lens": np.array([len(b) // 4 for b in runs], "<u4").tobytes(), "codes": encode_codes(ids)}
            state.update(segment=state["segment"] + 1, start=state["start"] + len(ids), ids=0)
            held.clear()
            return row

        def columns(rows: list[dict]) -> dict | None:
            return {k: [r[k] for r in rows] for k in rows[0]} if rows else None

        def step(cols):
            rows = []
            for doc_id, run in zip(cols["doc_id"], encode.batch(cols["text"])):
                run += end
                held.append((doc_id, run))
                state["ids"] += len(run) // 4
                if state["ids"] >= SEGMENT_IDS:
                    rows.append(close())
            return columns(rows)

        step.flush = lambda: columns([close()] if held else [])
        return step

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    map_lists(ordered, SEGMENTS, make, keeps=True).write.option("compression", "zstd").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``start``: ids of all segments before.  Only per-part totals (one
    row per written partition) are summed over in order and broadcast."""
    segments = spark.read.parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    return segments.join(F.broadcast(parts), "part").withColumn("start", F.col("part_start") + F.col("start_in_part"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, decoded from the files: doc_id, start, n_tokens, ids_crc32."""
    def make():
        def step(cols):
            out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
            for start, n, ids, nulls, lens, codes in zip(*(cols[c] for c in ("start", "n_docs", "doc_ids", "doc_nulls", "doc_lens", "codes"))):
                raw, lens = Codes(codes).decode().astype("<u4").tobytes(), np.frombuffer(lens, "<u4").astype(np.int64)
                ends = np.cumsum(lens)
                gone = np.unpackbits(np.frombuffer(nulls, np.uint8), count=n, bitorder="little")
                out["doc_id"] += [None if g else i for i, g in zip(np.frombuffer(ids, "<i8").tolist(), gone)]
                out["start"] += (start + ends - lens).tolist()
                out["n_tokens"] += lens.tolist()
                out["ids_crc32"] += [zlib.crc32(raw[4 * (e - k): 4 * e]) for e, k in zip(ends.tolist(), lens.tolist())]
            return out
        return step

    rows = read_segments(spark, path).select("start", "n_docs", "doc_ids", "doc_nulls", "doc_lens", "codes")
    return map_lists(rows, "doc_id long, start long, n_tokens long, ids_crc32 long", make)


def token_output(docs: DataFrame, tokenizer_path: str, cache_entries: int = CACHE_ENTRIES, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """Write the documents' segments below the shared folder and read the documents back.
    ``cache_entries`` and ``batch_chars`` trade a worker's memory against looking chunks up again."""
    path = shared_path(docs.sparkSession, "token-ids")
    write_segments(docs, path, tokenizer_path, cache_entries=cache_entries, batch_chars=batch_chars)
    return read_documents(docs.sparkSession, path)
