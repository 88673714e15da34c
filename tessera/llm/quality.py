"""Operator 5, quality classifier: nearest-neighbour voting in a latent-semantic space.

A text is a bag of word shapes (letters, capitals, digits and marks, runs collapsed),
pairs of neighbouring shapes, and buckets of how much of it repeats.  The weighted bags
of a bounded sample of labelled rows are decomposed (SVD); the sample's latent vectors
and labels are sent to every task, and each document's exact cosine with all of them is
one blocked matrix product.  The ``NEIGHBOURS`` most similar vote with the
``SHARPNESS``-th power of their similarity.

Only labelled rows with crc32(doc_id) % 5 <> 0 are learned from, at most
``SAMPLE_PER_LABEL`` of each label (the lowest id hashes).  Sent to tasks: two labels
times that bound vectors of ``RANK`` numbers, and one ``BUCKETS`` x ``RANK`` matrix.

Cases: null and empty texts are bags of one special token and get a score as any other;
repeated rows get equal scores; without labels of both kinds every score is the one
label's share (1 without any label); an empty table gives no rows; other columns are
never read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out, map_lists

BUCKETS = 2048
RANK = 32
NEIGHBOURS = 25
SHARPNESS = 8
SAMPLE_PER_LABEL = 1000
THRESHOLD = 0.3

_CLASS = bytearray(range(256))
for _b in range(256):
    c = chr(_b)
    _CLASS[_b] = ord("a") if "a" <= c <= "z" or _b >= 128 else ord("A") if "A" <= c <= "Z" else ord("0") if "0" <= c <= "9" else ord(" ") if _b in (9, 10, 11, 12, 13, 32) else _b
_CLASS = bytes(_CLASS)


def bag(text: str | None) -> dict[int, float]:
    """Bucket -> weight (square root of the share) of a whole text's tokens."""
    raw = (text or "").encode()
    kinds = np.frombuffer(raw.translate(_CLASS), np.uint8)
    if len(kinds):
        kinds = kinds[np.concatenate(([True], kinds[1:] != kinds[:-1]))]
    shapes = kinds.tobytes().split()
    if not shapes:
        return {zlib.crc32(b"empty") % BUCKETS: 1.0}
    n = len(shapes)
    tokens: Counter = Counter(shapes)
    pairs = Counter(zip(shapes, shapes[1:]))
    words = raw.split()
    same = sum(map(bytes.__eq__, words, words[1:])) / n
    triples = list(zip(words, words[1:], words[2:]))
    repeated = 1 - len(set(triples)) / len(triples) if triples else 0.0
    out: dict[int, float] = {}
    for token, k in tokens.items():
        b = zlib.crc32(token) % BUCKETS
        out[b] = out.get(b, 0.0) + (k / n) ** 0.5
    for (x, y), k in pairs.items():
        b = zlib.crc32(x + b" " + y) % BUCKETS
        out[b] = out.get(b, 0.0) + (k / n) ** 0.5
    for name, share in ((b"same %d", same), (b"repeated %d", repeated)):
        for level in range(1, 6):  # as a thermometer: near shares have near bags
            if share > level / 10:
                out[zlib.crc32(name % level) % BUCKETS] = 1.0
    return out


def _dense(bags: list[tuple[list[int], list[float]]]) -> np.ndarray:
    m = np.zeros((len(bags), BUCKETS), np.float32)
    for row, (at, x) in zip(m, bags):
        row[at] = x
    return m


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> DataFrame:
    """(label, text) of at most ``per_label`` rows for each of 0 and 1, lowest id hash first, held-out
    rows left out; of several rows of an id the one with the smallest text.  The ids chosen (a bounded table)
    are sent to the documents' scan."""
    own = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("_label"))
    by_hash = own.withColumn("_order", F.xxhash64("doc_id"))
    chosen = by_hash.where("_label = 0").orderBy("_order").limit(per_label).unionByName(by_hash.where("_label = 1").orderBy("_order").limit(per_label))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    return rows.select(F.col("_label").cast("int").alias("label"), "text")


class Model:
    def __init__(self, bags: list, labels: list[int]):
        self.labels = np.array(labels, np.float32)
        self.trained = len(set(labels)) == 2
        if not self.trained:
            return
        m = _dense(bags)
        self.idf = (np.log((1 + len(m)) / (1 + (m > 0).sum(0))) + 0.3).astype(np.float32)
        x = _unit(m * self.idf)
        values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        self.basis = vectors[:, np.argsort(-values, kind="stable")[:RANK]].astype(np.float32)
        self.vectors = _unit(x @ self.basis)
        # both labels weigh as if equally frequent when they vote
        share = self.labels.mean()
        self.weight = np.where(self.labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)

    def scores(self, bags: list) -> np.ndarray:
        if not self.trained:
            return np.full(len(bags), float(self.labels.mean()) if len(self.labels) else 1.0)
        z = _unit(_unit(_dense(bags) * self.idf) @ self.basis)
        cosine = z @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(cosine, near, 1), 1e-3) ** SHARPNESS * self.weight[near]
        return (votes * self.labels[near]).sum(1) / votes.sum(1)


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Model:
    def make():
        def step(cols):
            bags = [bag(t) for t in cols["text"]]
            return {"label": cols["label"], "at": [list(b) for b in bags], "x": [list(b.values()) for b in bags]}
        return step

    rows = map_lists(training_rows(docs, labels, "quality", per_label), "label int, at array<int>, x array<double>", make).collect()
    rows = sorted(((r["label"], r["at"], r["x"]) for r in rows), key=lambda r: (r[0], r[1], r[2]))  # the same model whatever the partitions
    return Model([(at, x) for _, at, x in rows], [y for y, _, _ in rows])


def quality(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_label))

    def make():
        def step(cols):
            bags = [(list(b), list(b.values())) for b in map(bag, cols["text"])]
            return {"doc_id": cols["doc_id"], "score": model.value.scores(bags).astype(np.float64)}
        return step

    rows = map_lists(docs.select("doc_id", "text"), "doc_id long, score double", make)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
