"""Each pipeline stage on its own input, against brute force or the operator it calls."""

import corpus_pipeline
from tessera.llm import toxicity
from tessera.llm.common import materialize, table
from tests.conftest import SF_SMALL
from tests.llm.test_operators import brute_components


def test_stages(spark):
    docs = table(spark, SF_SMALL, "documents")
    columns, held = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF_SMALL), name)
        held[name] = (before, docs)
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    before, after = held["toxicity"]
    scores = toxicity.toxicity(before, table(spark, SF_SMALL, "labels"))
    assert ids(after) == ids(scores.where("predicted = 0"))
    before, after = held["near_duplicates"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert ids(after) == sorted({c for _, _, c in brute_components(rows)})
    before, after = held["decontamination"]
    text = {r["doc_id"]: r["text"] for r in before.collect()}
    from tessera.llm.decontaminate import contamination
    clean = {r["doc_id"] for r in contamination(before, table(spark, SF_SMALL, "benchmark")).where("not contaminated").collect()}
    kept = {r["doc_id"]: r["text"] for r in after.collect()}
    assert all(kept[i] == text[i] for i in clean)
    before, after = held["mix"]
    assert set(ids(after)) <= set(ids(before))
    before, after = held["token_ids"]
    assert ids(after) == ids(before)


def test_near_duplicates_rule(spark):
    """Five words a shingle, 0.8 or more: a changed block of 6 in 100 words has 0.81 (on four words 0.83)."""
    base = [f"w{k}" for k in range(100)]
    changed = lambda n: " ".join(f"x{k}" if 40 <= k < 40 + n else w for k, w in enumerate(base))
    rows = [(1, " ".join(base), "en", "a", 1), (2, changed(6), "en", "a", 1), (3, changed(40), "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.distinct(spark, docs, SF_SMALL).collect()) == [1, 3]


def test_run(spark):
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0
