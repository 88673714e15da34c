"""Operator 9, toxicity: a subsequence string-kernel support vector machine with Nyström
landmarks over the words of a text.

The kernel compares two words by their subsequences of three bytes that span at most
``SPAN`` places; each occurrence weighs DECAY to the power of its span, so gapped and
inserted characters cost a little, not the match.  Runs of single letters ("i d i o t")
are read as one word.  Landmark words L give the features K(s, L) K(L, L)^(-1/2), in
which a linear support vector machine (squared hinge) is trained.  Its score is linear in
the subsequences of s, so after training landmarks, root and weights fold into one table
of subsequence weights.

Labels are of whole texts, so training picks witnesses: starting from the word parts most
typical of toxic texts, the best-scored words of each toxic text become positives, the
words of clean texts are negatives (of the sample's distinct ones at most ``NEGATIVES``, those of
the lowest crc32), and the machine is retrained ``ROUNDS`` times.  A logistic model on a text's best word, number and share of positive words gives its score.

Only labelled rows with crc32(doc_id) % 5 <> 0 are learned from, at most
``SAMPLE_PER_LABEL`` of each label (the lowest id hashes); conflicting labels of an id count as
the larger one.

Cases: null and empty texts have no words and get the score of a text without any
positive word; long texts are read whole; repeated rows get equal scores; without labels of
both kinds, or without a word that tells them apart, every score is the share of label 1 (0
without any label), and ``keep_civil`` keeps every row; an empty table gives no rows; other
columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import aside, held_out, map_lists
from tessera.llm.quality import training_rows
from tessera.llm.words import WORD

SPAN = 5
DECAY = 0.7
TABLE = 1 << 18
LANDMARKS = 256
ROUNDS = 3
WITNESSES = 4
NEGATIVES = 8_000
SAMPLE_PER_LABEL = 600
THRESHOLD = 0.5
#: scored words kept per task (speed only)
CACHE_WORDS = 250_000
#: words whose subsequences are laid out at once, and texts whose words are held at once (memory only)
BLOCK_WORDS = 5_000
HELD_TEXTS = 256

_SPELLED = re.compile(rb"(?:(?<![0-9a-z\x80-\xff])[a-z][^0-9a-z\x80-\xff\n]{1,2}){3,}[a-z](?![0-9a-z\x80-\xff])")


def units(text: str | None) -> list[bytes]:
    """Words, and spelled-out words joined."""
    low = (text or "").encode().lower()
    found = WORD.findall(low)
    if any(len(w) == 1 for w in found):
        found += [b"".join(WORD.findall(m[0])) for m in _SPELLED.finditer(low)]
    return found


def subsequences(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, subsequence slot, weight) of all occurrences, each word's weights scaled to length 1."""
    raw = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in words), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))
    who, slot, weight = [], [], []
    for last in range(2, SPAN):
        for middle in range(1, last):
            n = len(raw) - last
            if n <= 0:
                continue
            same = owner[:n] == owner[last:]
            code = (raw[:n] << 16 | raw[middle:middle + n] << 8 | raw[last:])[same]
            who.append(owner[:n][same])
            slot.append(code * 0x9E3779B1 % (1 << 32) >> 14)
            weight.append(np.full(len(code), DECAY ** (last + 1)))
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    who, slot, weight = map(np.concatenate, (who, slot, weight))
    norm = np.sqrt(np.bincount(who, weight ** 2, len(words)))
    return who, slot, weight / norm[who]


class WordMachine:
    """Support vector machine over words; after training only its subsequence table is kept."""

    def __init__(self, positives: list[bytes], negatives: list[bytes], cost: np.ndarray):
        words = positives + negatives
        y = np.concatenate((np.ones(len(positives)), -np.ones(len(negatives))))
        pick = lambda n, k: np.unique(np.linspace(0, n - 1, min(n, k)).astype(int))
        marks = [positives[i] for i in pick(len(positives), LANDMARKS // 2)] + [negatives[i] for i in pick(len(negatives), LANDMARKS // 2)]
        who, slot, weight = subsequences(marks)
        slots, at = np.unique(slot, return_inverse=True)
        phi = np.zeros((len(marks), len(slots)))
        np.add.at(phi, (who, at), weight)
        values, vectors = np.linalg.eigh(phi @ phi.T)
        root = vectors / np.sqrt(np.maximum(values, 1e-6)) * (values > 1e-6)   # K(L, L)^(-1/2), up to a rotation
        project = phi.T @ root                                               # subsequence -> feature
        who, slot, weight = subsequences(words)
        at = np.minimum(np.searchsorted(slots, slot), len(slots) - 1)
        known = slots[at] == slot
        x = np.zeros((len(words), root.shape[1]))
        order = np.argsort(who[known], kind="stable")
        w_known, a_known, v_known = who[known][order], at[known][order], weight[known][order]
        for a in range(0, len(w_known), BLOCK_WORDS):
            np.add.at(x, w_known[a:a + BLOCK_WORDS], project[a_known[a:a + BLOCK_WORDS]] * v_known[a:a + BLOCK_WORDS, None])
        beta, self.bias = _squared_hinge(x, y, cost)
        self.table = np.zeros(TABLE, np.float32)
        self.table[slots] = project @ beta

    def scores(self, words: list[bytes]) -> np.ndarray:
        out = [np.zeros(0)]
        for a in range(0, len(words), BLOCK_WORDS):
            block = words[a:a + BLOCK_WORDS]
            who, slot, weight = subsequences(block)
            out.append(np.bincount(who, self.table[slot] * weight, len(block)) + self.bias)
        return np.concatenate(out)


def _squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton steps on the primal of the linear machine (bias as a lightly penalised feature)."""
    x = np.hstack((x, np.ones((len(x), 1))))
    b = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(12):
        inside = y * (x @ b) < 1
        xs = x[inside] * cost[inside, None]
        new = np.linalg.solve(xs.T @ x[inside] + np.diag(penalty), xs.T @ y[inside])
        if np.allclose(new, b, atol=1e-6):
            break
        b = new
    return b[:-1], float(b[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.hstack((x, np.ones((len(x), 1))))
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (y - p) - 0.05 * b
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b += step
        if np.abs(step).max() < 1e-7:
            break
    return b


def _parts(word: bytes) -> set[bytes]:
    """The word, and its beginnings of four to seven bytes."""
    return {word} | {word[:k] for k in range(4, min(len(word), 8))}


class Model:
    def __init__(self, texts: list[Counter], labels: list[int]):
        y = np.array(labels)
        self.share = float(y.mean()) if len(y) else 0.0
        self.trained = 0 < self.share < 1
        if not self.trained:
            return
        toxic, clean = [t for t, k in zip(texts, y) if k], [t for t, k in zip(texts, y) if not k]
        df_toxic, df_clean = Counter(), Counter()
        for t in toxic:
            df_toxic.update(set().union(*map(_parts, t)))
        df_toxic = Counter({p: k for p, k in df_toxic.items() if k >= 2})
        for t in clean:
            df_clean.update({p for w in t for p in _parts(w) if p in df_toxic})
        n, m = len(toxic), len(clean)

        def contrast(part: bytes) -> float:
            p, q = (df_toxic[part] + 0.5) / (n + 1), (df_clean[part] + 0.5) / (m + 1)
            return (p - q) / np.sqrt((p + q) / 2 * (1 / n + 1 / m)) + np.log(p / q)

        part_score = {p: contrast(p) for p in df_toxic}
        df_word = Counter(w for t in clean for w in t)
        negatives = sorted(df_word, key=lambda w: zlib.crc32(w))[:NEGATIVES]
        score = {w: max(part_score.get(p, -9.0) for p in _parts(w)) for t in toxic for w in t}
        self.machine = None
        least = np.quantile(list(part_score.values()), 0.9) if part_score else 0.0
        for k in range(ROUNDS):
            chosen: Counter = Counter()
            for t in toxic:
                best = sorted(t, key=lambda w: (-score[w], w))[:WITNESSES]
                chosen.update(w for i, w in enumerate(best) if score[w] > least or i == 0 and k == 0)
            positives = sorted(chosen, key=lambda w: (-chosen[w], w))
            gone = set(positives)
            against = [w for w in negatives if w not in gone or df_word[w] > chosen[w]]
            positives = [w for w in positives if w not in df_word or chosen[w] * m > df_word[w] * n]
            if not positives or not against:
                break
            cost = np.concatenate((np.minimum([chosen[w] for w in positives], 20.0) * 2, np.minimum([df_word[w] for w in against], 20.0)))
            self.machine = WordMachine(positives, against, cost)
            own = list(score)
            score, least = dict(zip(own, self.machine.scores(own))), 0.0
        if self.machine is None:  # no word tells the labels apart
            self.trained = False
            return
        x = np.array([self.features(np.repeat(self.machine.scores(list(t)), list(t.values())).tolist(), sum(t.values())) for t in texts])
        self.spread = np.maximum(x.std(0), 1e-6)
        self.logistic = _logistic(x / self.spread, y)

    @staticmethod
    def features(scores: list[float], n: int) -> list[float]:
        above = sum(s > 0 for s in scores)
        return [min(max(scores, default=-2.0), 2.0), np.log1p(above), np.log1p(100 * above / max(n, 1)), np.log1p(sum(s > 0.5 for s in scores))]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.hstack((x / self.spread, np.ones((len(x), 1)))) @ self.logistic
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Model:
    def make():
        def step(cols):
            bags = [Counter(units(t)) for t in cols["text"]]
            return {"label": cols["label"], "word": [list(b) for b in bags], "n": [list(b.values()) for b in bags]}
        return step

    rows = map_lists(training_rows(docs, labels, "toxic", per_label), "label int, word array<binary>, n array<int>", make).collect()
    rows = sorted(((r["label"], list(map(bytes, r["word"])), r["n"]) for r in rows), key=lambda r: (r[0], r[1]))  # the same model whatever the partitions
    return Model([Counter(dict(zip(w, n))) for _, w, n in rows], [y for y, _, _ in rows])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (all its columns) with ``_toxic_score`` appended."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*docs.columns, F.lit(0.0).alias("_toxic_score")).schema

    def make():
        model, cache = sent.value, {}

        def step(cols):
            if not model.trained:
                return cols | {"_toxic_score": [model.share] * len(cols["text"])}
            x = []
            for at in range(0, len(cols["text"]), HELD_TEXTS):
                texts = [units(t) for t in cols["text"][at:at + HELD_TEXTS]]
                new = list(set().union(*texts).difference(cache))
                if len(cache) + len(new) > CACHE_WORDS:
                    cache.clear()
                    new = list(set().union(*texts))
                cache.update(zip(new, model.machine.scores(new).tolist()))
                x += [model.features([cache[w] for w in t], len(t)) for t in texts]
            return cols | {"_toxic_score": model.score(np.array(x))}
        return step

    return map_lists(docs, schema, make)


def toxicity(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = scored(docs.select("doc_id", "text"), train(docs, labels, per_label))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_toxic_score").alias("score"), (F.col("_toxic_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """``docs`` without the texts scored toxic; none goes if nothing can be learned from the labels."""
    model = train(docs, labels, per_label)
    if not model.trained:
        return docs
    return aside(docs, ["_toxic_score"], lambda d: scored(d, model).where(F.col("_toxic_score") < THRESHOLD).drop("_toxic_score"))
