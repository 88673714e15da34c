"""Legal input that once lost links, crashed or met an operator's own column names."""

import gc
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontaminate, jaccard_join, mix_sources, toxicity
from tessera.llm.common import aside
from tests.llm.test_operators import brute_components, same_rows


def words(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


def test_links_through_rows_without_an_id(spark):
    rows = [(1, words(0, 52)), (None, words(3, 55)), (2, words(6, 58)), (None, words(100, 140)), (None, words(101, 141)), (9, words(200, 220))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_components(docs).collect()
    same_rows(got, brute_components(rows), ("doc_id", "n_shingles", "component_id"))
    kept = jaccard_join.one_of_each(docs).collect()
    assert sorted((r["doc_id"] or 0 for r in kept)) == [0, 1, 9]


def test_one_row_of_each_component_stays_the_same(spark):
    # one id with two texts, one of them a copy of another document; repeated rows; empty texts
    rows = [(5, words(0, 40), "a"), (5, words(50, 90), "b"), (3, words(0, 40), "c"), (7, words(50, 90), "d"), (7, words(50, 90), "e"), (8, "", "f"), (8, "", "g"), (4, None, "h"), (None, " ", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _dup_id string")
    want = None
    for parts in (1, 3, 5):
        kept = sorted(((r["doc_id"], r["text"], r["_dup_id"]) for r in jaccard_join.one_of_each(docs.repartition(parts)).collect()), key=repr)
        want = want or kept
        assert kept == want
    assert sorted(((i, t) for i, t, _ in want), key=repr) == sorted([(3, words(0, 40)), (5, words(50, 90)), (8, ""), (4, None), (None, " ")], key=repr)


@pytest.mark.parametrize("toxic, clean", [(None, "hello there"), ("", "hello there"), ("same", "same")])
def test_toxicity_without_a_telling_word(spark, toxic, clean):
    docs = spark.createDataFrame([(i, toxic if i % 2 else clean) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 40 and all(0 <= r["score"] <= 1 for r in rows) and len({r["score"] for r in rows}) == 1
    assert toxicity.keep_civil(docs, labels).count() == 40


def test_callers_columns_with_the_operators_names(spark):
    docs = spark.createDataFrame([(i, f"some plain words {i}" if i % 3 else "you total idiot", "a", f"v{i}") for i in range(60)], "doc_id long, text string, source string, v string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([("x", "one two three four five six seven eight nine ten")], "item_id string, text string")
    for name, work in (("_toxic_score", lambda d: toxicity.keep_civil(d, labels)), ("_mix_s", mix_sources.mix_documents), ("_mix_copy", mix_sources.mix_documents),
                       ("_item_spans", lambda d: decontaminate.remove_spans(d, bench)), ("_ITEM_ITEMS", lambda d: decontaminate.remove_spans(d, bench)),
                       ("_dup_hash", jaccard_join.one_of_each)):
        out = work(docs.withColumnRenamed("v", name))
        assert out.columns == ["doc_id", "text", "source", name]
        rows = out.collect()
        assert rows and all(r[name] == f"v{r['doc_id']}" for r in rows)
    assert aside(docs.withColumnRenamed("v", "a").withColumnRenamed("source", "A_own"), ["A"], lambda d: d).columns == ["doc_id", "text", "A_own", "a"]


def test_empty_documents_are_not_copied_beyond_a_full_budget(spark):
    docs = spark.createDataFrame([(i, "" if i < 20 else "one two three", s) for i in range(60) for s in ("a", "b", "c")], "doc_id long, text string, source string")
    mixed = mix_sources.mix(docs).groupBy("source").agg({"copies": "max"}).collect()
    assert all(r[1] <= 3 for r in mixed)


@pytest.mark.parametrize("entries", [64, 1_000_000])
def test_batches_of_chunks_have_the_tokenizers_ids(entries):
    """Small caches forget all the time; ids stay those of the whole text."""
    from tessera.llm.chunks import ByteIds
    from tessera.llm.queries import BYTE_VOCABULARY, tokenizer_path
    encoder, rng = ByteIds(tokenizer_path(BYTE_VOCABULARY), entries), random.Random(4)
    texts = [None, "", " ", "\n", "a.", "a.\nb,", "\na", "a ", "a\n\nb", "a  b", "a\tb", "x<|endoftext|> y", "don't we'll", "z" * 99 + " z. z, 漢字 é."]
    texts += ["".join(rng.choice("ab.,\n  é1'漢\t&") for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    texts += [" ".join("".join(rng.choice("aeTst.,") for _ in range(rng.randint(1, 9))) for _ in range(60)).replace(" a", "\na") for _ in range(200)]
    want = [encoder.pack(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [b for at in range(0, len(texts), 500) for b in encoder.batch(texts[at:at + 500])] == want
    assert encoder(texts[-1]) == want[-1] and encoder.batch([]) == []


def test_chunks_of_one_hash_keep_their_own_ids(monkeypatch):
    from tessera.llm import chunks
    from tessera.llm.queries import BYTE_VOCABULARY, tokenizer_path
    monkeypatch.setattr(chunks, "_hashes", lambda keys: np.array([len(k) % 3 for k in keys.to_pylist()], np.uint64))
    encoder = chunks.ByteIds(tokenizer_path(BYTE_VOCABULARY), 2)
    texts = ["one two three", "two one\nfour five.", "six two one, four", "seven seven"] * 3
    want = [encoder.pack(encoder.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [encoder(t) for t in texts] == want and encoder.batch(texts) == want
    assert len(encoder.keys) == len(encoder.hashes) == len(encoder.places) <= 2 and sorted(encoder.places) == list(range(len(encoder.keys)))


def test_a_lookup_takes_no_longer_in_a_full_cache():
    from tessera.llm.chunks import ByteIds
    from tessera.llm.queries import BYTE_VOCABULARY, tokenizer_path

    def seconds(n):
        encoder, took = ByteIds(tokenizer_path(BYTE_VOCABULARY)), []
        encoder.batch([" ".join(f"w{i}" for i in range(at, at + 1000)) for at in range(0, n, 1000)])
        for _ in range(9):
            began = time.process_time()
            encoder("w1 w2 w3")
            took.append(time.process_time() - began)
        assert len(encoder.keys) >= n
        return min(took)

    assert seconds(300_000) < 10 * seconds(1000) + 0.002


def held_bytes(work):
    """What ``work()`` leaves allocated, by Python and NumPy and by Arrow, and the most that the first two held."""
    gc.collect()
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        work()
        now, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    return now + pa.total_allocated_bytes() - arrow, most


def test_a_kept_chunk_takes_few_bytes():
    from tessera.llm.chunks import ByteIds
    from tessera.llm.queries import BYTE_VOCABULARY, tokenizer_path
    encoder = ByteIds(tokenizer_path(BYTE_VOCABULARY), 200_000)
    texts = [" ".join(f"w{1000 * i + k}" for k in range(1000)) for i in range(150)]
    held, _ = held_bytes(lambda: [encoder.batch(texts[at:at + 10]) for at in range(0, 150, 10)])
    assert held < 120 * 150_000
    encoder.batch([f"{a} {b}" for a, b in zip(texts, texts[1:])])  # all known
    encoder.batch([t.replace("w", "v") for t in texts])  # beyond the entries
    assert len(encoder.keys) == len(encoder.runs) == len(encoder.used) <= 200_000


def test_a_worker_forgets_the_chunks_of_earlier_operators(spark):
    from tessera.llm import token_output
    from tessera.llm.common import map_lists
    from tessera.llm.queries import BYTE_VOCABULARY, tokenizer_path
    docs = spark.createDataFrame([(i, f"word {i}") for i in range(64)], "doc_id long, text string")
    token_output.write_segments(docs, token_output.shared_path(spark, "forget"), tokenizer_path(BYTE_VOCABULARY))

    def make():
        def step(cols):
            return {"n": [sum(type(o).__name__ == "ByteIds" for o in gc.get_objects())] * len(cols["doc_id"])}
        return step

    assert {r["n"] for r in map_lists(docs.select("doc_id").repartition(16), "n long", make).collect()} == {0}


def test_word_scores_lay_out_few_words_at_once():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(10)).encode() for _ in range(20_000)]
    machine = toxicity.WordMachine(words[:50], words[50:100], np.ones(100))
    whole = []
    _, most = held_bytes(lambda: whole.append(machine.scores(words)))
    assert most < 35_000_000
    assert whole[0].tolist() == [s for at in range(0, 20_000, 7000) for s in machine.scores(words[at:at + 7000]).tolist()]


def test_spans_are_found_and_cut_in_one_pass(spark, capsys):
    docs = spark.createDataFrame([(1, words(0, 60)), (2, words(30, 34) + " " + words(100, 160))], "doc_id long, text string")
    bench = spark.createDataFrame([("a", words(100, 112)), ("b", words(300, 320)), ("c", words(10, 21))], "item_id string, text string")
    for shard_words in (5, 1000):
        out = decontaminate.remove_spans(docs, bench, shard_words=shard_words)
        out.explain()
        assert capsys.readouterr().out.count("MapInArrow") == 1
        assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: words(0, 10) + "  " + words(21, 60), 2: words(30, 34) + "  " + words(112, 160)}


def test_arrow_batches_hold_a_slice_at_most(spark):
    from tessera.llm.common import ROWS_PER_SLICE, map_lists
    docs = spark.range(5000).coalesce(1).selectExpr("id", "repeat('x', 20000) as text")
    map_lists(docs, "id long, text string", lambda: lambda cols: cols)
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches), "n long, size long").collect()
    assert sum(r["n"] for r in sizes) == 5000
    assert max(r["n"] for r in sizes) <= ROWS_PER_SLICE and max(r["size"] for r in sizes) < 24_000_000
