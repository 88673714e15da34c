"""The training-data operators against brute force, the tokenizers library and SQL, with edge rows."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard_join, licenses, mix_sources, near_vectors, quality, quotations, token_counts, token_output, toxicity
from tessera.llm.common import connected_components, table
from tessera.llm.queries import BYTE_VOCABULARY, ORACLES, QUERIES, WORD_VOCABULARY, tokenizer_path
from tests.conftest import SF_SMALL
from tests.oracle_check import compare, duck

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="module")
def edge_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(5)
    long = " ".join(rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(30_000))
    base = " ".join(rng.choice(WORDS) + str(i) for i in range(120))
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, base + " tail", "en", None), (3, base + " tail", "en", None), (4, None, None, "b"), (5, "", "en", "b"), (6, " \n ", "en", "b"),
            (7, long, "en", "c"), (8, long + " x y", "en", "c"), (None, "one two", "en", "c"), (9, "one two", "fr", "é"), (10, "Released under the MIT License.", "en", "a"),
            (11, "the same four words", "en", "a"), (12, "The Same four words", "en", "a"), (13, "<|endoftext|> don't\t\tstop    ÉTÉ", "fr", "b")]
    return spark.createDataFrame([(*r, i, "x", 1.5, 0) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, component_id string, score double, size int")


def same_rows(got, want, columns):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r[c] for c in columns) for r in got), key=key) == sorted(want, key=key)


def empty(df):
    return df.where("false")


def brute_components(rows):
    """(doc_id, n, component) by comparing all pairs."""
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append((i, frozenset(tuple(w[k:k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])))
    group = list(range(len(sets)))
    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                old, new = group[x], group[y]
                group = [new if g == old else g for g in group]
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if group[j] == group[k] and sets[j][0] is not None]
        out.append((i, len(s), min(ids) if ids else None))
    return out


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    r = compare(spark, duck(SF_SMALL), name, QUERIES[name], ORACLES[name], SF_SMALL)
    assert r["cols_match"] and r["rows_match"], r


def edge_sql(name, docs, **tables):
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    for t, df in tables.items():
        con.register(t, df.toPandas().astype({"item_id": "Int64"}))
    return con.execute(ORACLES[name]).fetchall(), [d[0] for d in con.description]


def test_edge_rows_against_sql(spark, edge_docs):
    benchmark = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (None, "x y"), (4, " ".join(WORDS)), (4, "same four"), (5, "same four")], "item_id long, text string")
    for name, got in (("op2_license_scan", licenses.license_scan(edge_docs)), ("op6_decontaminate", decontaminate.contamination(edge_docs, benchmark)),
                      ("op7_mix_sources", mix_sources.mix_report(edge_docs))):
        want, columns = edge_sql(name, edge_docs, benchmark=benchmark)
        same_rows(got.collect(), want, columns)
    assert licenses.license_scan(empty(edge_docs)).count() == mix_sources.mix_report(empty(edge_docs)).count() == 0
    assert decontaminate.contamination(empty(edge_docs), benchmark).count() == 0
    assert not decontaminate.contamination(edge_docs, empty(benchmark)).where("contaminated").count()


def test_license_templates(spark):
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this {} and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    rows = [(1, text.format("software")), (2, text.format("software product")), (3, text.format("a b c")), (4, text.format("software").replace("granted", "denied")),
            (5, "Licensed under CC BY-NC 4.0."), (6, "cc by cc by"), (7, "GNU lesser general public license")]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in range(1, 8)] == ["mit-text", "mit-text", "", "", "cc-by,cc-by-notice", "cc-by", ""]
    assert (got[6]["n_base"], got[6]["first_word"], got[6]["last_word"]) == (2, 0, 2)


def test_automaton_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        draw = lambda n: [rng.choice("abc").encode() for _ in range(n)]  # noqa: E731, B023
        items = [(str(k), draw(rng.randrange(0, 9))) for k in range(5)]
        doc, window = draw(40), 4
        spans, found = decontaminate.SuffixAutomaton(items, window).scan(doc)
        hit, want = set(), set()
        for item, ws in items:
            k = min(window, len(ws))
            for i in range(len(ws) - k + 1) if k else ():
                for j in range(len(doc) - k + 1):
                    if doc[j:j + k] == ws[i:i + k]:
                        hit |= set(range(j, j + k))
                        want.add(item)
        assert {x for a, b in zip(spans[::2], spans[1::2]) for x in range(a, b)} == hit
        assert found == want
        assert all(a > b for a, b in zip(spans[2::2], spans[1::2]))


def test_remove_spans(spark):
    bench = spark.createDataFrame([(1, " ".join(WORDS[:12]))], "item_id long, text string")
    passage = " ".join(WORDS[:12]).upper()
    rows = [(1, f"Before it, {passage}. After it all, many more words stand here than in it, so it stays.", "s"), (2, passage, "s"), (3, "clean text", None), (4, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _spans string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench).collect()}
    assert got == {1: "Before it, . After it all, many more words stand here than in it, so it stays.", 3: "clean text", 4: None}
    sharded = decontaminate.contamination(docs, bench.unionByName(spark.createDataFrame([(2, "clean text")], "item_id long, text string")), shard_words=2)
    assert {r["doc_id"]: r["n_hit"] for r in sharded.collect()} == {1: 12, 2: 12, 3: 2, 4: 0}


def test_jaccard(spark, edge_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    same_rows(jaccard_join.jaccard_components(edge_docs).collect(), brute_components(rows), ("doc_id", "n_shingles", "component_id"))
    assert jaccard_join.jaccard_components(empty(edge_docs)).count() == 0
    kept = jaccard_join.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 4, 5, 6, 7, 9, 10, 11, 13]


def test_jaccard_crowd(spark, monkeypatch):
    """A crowd around the limit in one large tile, so that all rounds, bands and blocks are used."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "SMALL_TILE", 4)
    rng = random.Random(3)
    common = [rng.choice(WORDS) + str(i) for i in range(80)]
    rows = []
    for i in range(90):
        w = list(common) + [f"own{i}_{k}" for k in range(rng.randrange(0, 8))]
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(400)}"
        rows.append((i, " ".join(w)))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    same_rows(got.collect(), brute_components(rows), ("doc_id", "n_shingles", "component_id"))


def test_jaccard_trimmed_chains(spark):
    """Small chains of trimmed texts: the only common tile of two links may have no other class in it."""
    rng = random.Random(11)
    rows = []
    for c in range(150):
        base = [f"c{c}w{k}" for k in range(rng.randrange(30, 70))]
        for _ in range(rng.randrange(2, 6)):
            off = len(base) // 10
            left, right = rng.randrange(off + 1), rng.randrange(off + 1)
            rows.append((len(rows), " ".join(base[left:len(base) - right])))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    same_rows(got.collect(), brute_components(rows), ("doc_id", "n_shingles", "component_id"))


def test_signature_bound():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, m = rng.integers(1, 60, 2)
        pool = np.unique(rng.integers(0, 2**63, 70).astype(np.uint64))
        a, b = np.sort(rng.choice(pool, min(n, len(pool)), False)), np.sort(rng.choice(pool, min(m, len(pool)), False))
        bits = [np.frombuffer(jaccard_join.signature(s), np.uint8) for s in (a, b)]
        assert jaccard_join.may_link(len(a), bits[0], len(b), bits[1]) or not jaccard_join.links(a, b)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 70)] + [(100 + i, 100) for i in range(1, 30)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {i: 0 for i in range(71)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}


def test_vectors(spark):
    rng = np.random.default_rng(7)
    centers = rng.standard_normal((60, 16))
    x = [(c + 0.2 * rng.standard_normal(16)).astype("float32").tolist() for c in centers for _ in range(25)]
    rows = [(i, v, i % 3) for i, v in enumerate(x)] + [(2000 + k, x[0], 0) for k in range(40)] + [(None, x[0], 0)]
    bad = [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [float("nan")] * 16, 0), (3003, x[0], None), (3004, [None] * 16, 0), (3005, [float("inf")] * 16, 0), (3006, x[0][:8], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, embedding array<float>, label int, component_id string")
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(df, leaf=64).collect()}
    assert len(got) == len(rows) + len(bad)
    m = np.array([r[1] for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    true = (m @ m.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(true, False)
    links = np.array([got[r[0]]["n_links"] for r in rows])
    assert (links <= true.sum(1)).all() and links.sum() >= 0.9 * true.sum() > 0
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, *_ in bad)
    assert all(got[i]["component_id"] == got[0]["component_id"] for i in [None, *range(2000, 2040)]) and not got[None]["kept"]
    assert near_vectors.near_vectors(empty(df)).count() == 0
    nameless = near_vectors.near_vectors(spark.createDataFrame([(None, x[0], 0), (None, x[1], 0), (None, None, 0)], df.select("vec_id", "embedding", "label").schema))
    assert sorted((r["n_links"], r["component_id"], r["kept"]) for r in nameless.collect())[0] == (0, None, False)


def brute_links(m, threshold=0.93):
    m = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    true = m @ m.T >= threshold
    np.fill_diagonal(true, False)
    return true


def test_vectors_deep_forest(spark):
    """Default parameters, 64 dimensions, five levels of splits: no link too many, recall of the links of at least 0.9."""
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((1500, 64))
    m = (np.repeat(centers, 6, 0) + 0.22 * rng.standard_normal((9000, 64))).astype("float32")
    df = spark.createDataFrame([(i, v.tolist(), "one") for i, v in enumerate(m)], "vec_id long, embedding array<float>, label string")
    classes = df.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    found = near_vectors.leaves(classes)
    assert found.agg(F.max(F.length("node"))).first()[0] >= 4 and found.select("tree").distinct().count() == near_vectors.TREES
    true = brute_links(m)
    got = sorted(near_vectors.near_vectors(df).collect())
    links = np.array([r["n_links"] for r in got])
    recall = links.sum() / true.sum()
    print(f"recall of links {recall:.4f}")
    assert (links <= true.sum(1)).all() and recall >= 0.9


def test_vectors_crowd(spark):
    """A crowd of near copies is compared whole, in blocks: links and components equal brute force."""
    rng = np.random.default_rng(4)
    m = (rng.standard_normal(32) + 0.16 * rng.standard_normal((1500, 32))).astype("float32")
    m[::10] = m[0]
    df = spark.createDataFrame([(i, v.tolist(), 5) for i, v in enumerate(m)], "vec_id long, embedding array<float>, label int")
    got = sorted(near_vectors.near_vectors(df, leaf=200, block=128).collect())
    want = {r: c for r, _, c in brute_pairs_components(brute_links(m))}
    assert [r["n_links"] for r in got] == brute_links(m).sum(1).tolist()
    assert [r["component_id"] for r in got] == [want[i] for i in range(len(m))]


def brute_pairs_components(linked):
    low = np.arange(len(linked))
    while True:
        new = np.minimum(low, np.where(linked, low, len(low)).min(1))
        if (new == low).all():
            return [(i, int(linked[i].sum()), int(c)) for i, c in enumerate(low)]
        low = new


def test_token_counts(spark, edge_docs):
    from tokenizers import Tokenizer
    path = tokenizer_path(WORD_VOCABULARY)
    tok = Tokenizer.from_file(path)
    docs = edge_docs.select("doc_id", "text").unionByName(table(spark, SF_SMALL, "documents").select("doc_id", "text"))
    count = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    want = [(r["doc_id"], len((r["text"] or "").encode()), count(r["text"]), count(r["text"]) > 2048) for r in docs.collect()]
    same_rows(token_counts.token_counts(docs, path, 2048).collect(), want, ("doc_id", "n_bytes", "n_tokens", "over_limit"))
    assert token_counts.prefix_tables(empty(docs), path).count() == 0
    counter = token_counts.PrefixCounter(path)
    for t in ("It's the 2nd of-the, unbelievable ÉTÉ of'll ça!! <b> 東京タワー naïveté", "thntblere  ofandédon\n\nthhesting."):
        assert [counter.at(t, k) for k in range(len(t) + 1)] == [count(t[:k]) for k in range(len(t) + 1)]
        cut = counter.cut(t, 5)
        assert count(t[:cut]) <= 5 and (cut == 0 or not t[cut - 1].isspace())


def test_cut_is_longest(spark):
    """Every budget, against the library on every prefix: one long chunk, special strings, control characters, decomposed letters."""
    from tokenizers import Tokenizer
    path = tokenizer_path(WORD_VOCABULARY)
    tok = Tokenizer.from_file(path)
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    counter = token_counts.PrefixCounter(path)
    rng = random.Random(2)
    texts = ["東京タワーは日本の電波塔である高さは三百三十三メートル", "VGhpcyBpcyBhIGxvbmcgYmFzZTY0IHN0cmluZyB3aXRob3V0IGJsYW5rcw==", "function(a,b){return'll'+a.b!==(b<<2)||we'll&&they're've}",
             "one two!<|endoftext|>three <|startoftext|><|endoftext|> four!!<|endoft end", "a\x1cb c\x1d\x1e d <|endoftext|>", "Tie\u0302\u0301ng Vie\u0323\u0302t x\u0301y\u0301 e\u0301e\u0301e\u0301e\u0301 \u1112\u1161\u11ab\u1100\u116e\u11a8",
             "İstanbul'S É!! ÉTÉ  \u3000 ¿no?", "<|endoftext|>"]
    texts += ["".join(rng.choice(["ab", "the", "'", "s", "ll", "!", "<|", " ", "7", "é", "e\u0301", "日", "<|endoftext|>", "\x1f"]) for _ in range(24)) for _ in range(40)]
    for t in texts:
        each = [count(t[:k]) for k in range(len(t) + 1)]
        assert [counter.at(t, k) for k in range(len(t) + 1)] == each, t
        for budget in range(max(each) + 2):
            assert counter.cut(t, budget) == max(len(t[:k].rstrip(token_counts.SPACE)) for k in range(len(t) + 1) if each[k] <= budget), (t, budget)
    long = "".join(rng.choice("東京都日本語電波塔高三百メル") for _ in range(6000))
    rows = [(1, long), (2, "<|endoftext|>" + "word and " * 3000), (3, "x\x1c " + "ab12" * 5000)]
    for r in token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path, 2048).collect():
        t, k = dict(rows)[r["doc_id"]], r["kept_chars"]
        assert r["over_limit"] and count(t[:k]) <= 2048 < min(count(t[:k + j]) for j in range(2, 60))


def test_token_output(spark, edge_docs):
    from tokenizers import Tokenizer
    path = tokenizer_path(BYTE_VOCABULARY)
    tok = Tokenizer.from_file(path)
    docs = edge_docs.unionByName(table(spark, SF_SMALL, "documents"), allowMissingColumns=True)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, start = [], 0
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    same_rows(token_output.token_output(docs, path).collect(), want, ("doc_id", "start", "n_tokens", "ids_crc32"))
    assert token_output.token_output(empty(docs), path).count() == 0


def test_codes():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 300, 3000), rng.integers(0, 2**31, 700), np.zeros(1, int), np.zeros(0, int), np.arange(250, 262)):
        codes = token_output.Codes(token_output.encode_codes(ids))
        assert (codes.decode() == ids).all() and [codes[i] for i in range(0, len(ids), 7)] == ids[::7].tolist()


def test_mix_totals(spark):
    got = mix_sources.mix_report(table(spark, SF_SMALL, "documents")).toPandas()
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "source").toPandas()
    by = got.merge(docs, on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), own=("source_size", "first"), most=("size", "max"))
    assert abs(by["target"].sum() - by["own"].sum()) < 1e-6 * by["own"].sum()
    assert (by["target"] <= 3 * by["own"] + 1e-9).all() and ((by["taken"] - by["target"]).abs() <= by["most"]).all()
    assert (got["taken"] <= 3 * got["size"]).all()
    mixed = mix_sources.mix_documents(table(spark, SF_SMALL, "documents"))
    assert mixed.agg({"*": "count"}).first()[0] == (got["taken"] / got["size"]).fillna(0).sum()


@pytest.mark.parametrize("name, run, label", [("quality", quality.quality, "quality"), ("toxic", toxicity.toxicity, "toxic")])
def test_classifiers(spark, edge_docs, name, run, label):
    d = SF_SMALL.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    got = run(docs.select("doc_id", "text").unionByName(edge_docs.selectExpr("-1 - doc_id as doc_id", "text")), labels)
    held = got.join(labels, "doc_id").where("held_out").selectExpr(f"avg(if(predicted = {label}, 1.0, 0.0)) as acc", "count(*) as n").first()
    assert held["n"] >= 50 and held["acc"] >= 0.95
    assert got.where("score is null or score < 0 or score > 1 or predicted is null").count() == 0
    assert run(empty(docs), labels).count() == 0
    assert run(edge_docs, empty(labels)).count() == edge_docs.count()


def test_training_rows_bounded(spark):
    """An id on very many rows is one row of the sample."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(7, f"text {k}") for k in range(500)] + [(8, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = quality.training_rows(docs, labels, "quality", 100).collect()
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    assert {7, 8} <= set(ids)
    same_rows(got, [(i % 2, "text 0" if i == 7 else f"text {i}") for i in ids], ("label", "text"))


def test_quotations(spark):
    rows = [(1, 0, "user", "How do I bake bread?\nI have flour."), (1, 1, "assistant", "Mix and wait."), (1, 2, "user", "> how do i  bake bread?\n> I have flour.\nNo yeast, by the way."),
            (1, 3, "assistant", ">> I have flour.\n> No yeast, by the way.\nThen soda."), (1, 4, "user", "> nobody said this\nok"), (2, 0, "user", None), (2, 1, "assistant", ""),
            (None, 0, "user", "hello"), (None, 1, "user", "> hello\nbye"), (3, None, "user", "x"), (3, 1, "user", "> x\ny"), (4, 0, "user", "same"), (4, 0, "user", "same"), (4, 1, "user", "> same\nyes")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, place string")
    got = {(r["conv_id"], r["turn"]): r for r in quotations.reply_order(df).collect()}
    assert [got[1, t]["reply_to"] for t in range(5)] == [None, 0, 0, 2, 3]
    assert [got[1, t]["n_quoted"] for t in range(5)] == [0, 0, 1, 2, 0]
    assert [got[1, t]["place"] for t in range(5)] == [0, 1, 2, 3, 4]
    assert got[1, 3]["body"] == "Then soda." and got[1, 2]["body"] == "No yeast, by the way." and got[2, 0]["body"] == ""
    assert got[None, 1]["reply_to"] == 0 and got[3, 1]["n_quoted"] == 0 and got[4, 1]["reply_to"] == 0
    assert quotations.reply_order(empty(df)).count() == 0 and quotations.quotation_links(empty(df)).count() == 0
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    result = con.execute(ORACLES["op3_quotation_links"])
    columns = [d[0] for d in result.description]
    same_rows(quotations.reply_order(df).collect(), result.fetchall(), columns)


def test_native_plan(spark):
    plan = QUERIES["op3_quotation_links"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
