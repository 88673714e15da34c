"""Feature analysis and model/projection compositions on a synthetic final table
(the reference's end-to-end expectations: 3 x targets comparison rows,
projected years, one projection per commune and year)."""

import random

from tessera import domain
from tessera.operators import territory as TT

N = 60


def test_feature_analysis_and_models(spark):
    rnd = random.Random(42)
    rows = []
    for i in range(N):
        base = [rnd.random() for _ in range(7)]
        for annee in ("2017", "2022"):
            w = [b + rnd.random() * 0.2 for b in base]
            shares = [round(x / sum(w) * 100, 2) for x in w]
            rows.append((f"{10000 + i:05d}", annee, "75" if i % 2 else "13", f"C{i}", *shares,
                         rnd.uniform(5, 20), rnd.uniform(15000, 30000), rnd.uniform(10, 40), rnd.uniform(5, 40),
                         rnd.uniform(2, 20), None if i % 7 == 0 else rnd.uniform(5, 30), rnd.uniform(1, 10),
                         rnd.uniform(10, 30)))
    cols = ["CODGEO", "annee", "DEP", "lib_commune"] + domain.TARGETS + [
        "taux_chomage", "MED21", "pct_diplome_sup", "pct_immigres", "densite_associative", "TP6021",
        "pct_emploi_indus", "pct_sans_diplome"]
    schema = ", ".join(f"{c} string" if i < 4 else f"{c} double" for i, c in enumerate(cols))
    df = spark.createDataFrame(rows, schema)
    fa = TT.feature_analysis(df)
    feats = fa["features"]
    assert feats and set(feats) <= set(fa["final"].columns)
    assert fa["final"].where("TP6021 IS NULL").count() == 0          # imputed
    assert fa["audit"].count() >= 8
    mp = TT.model_and_projection(fa["final"], feats, families=["Ridge", "Random Forest"])
    assert mp["comparison"].count() == 2 * len(domain.TARGETS)
    proj = mp["projections"]
    assert {r["annee_projetee"] for r in proj.select("annee_projetee").distinct().collect()} == set(domain.PROJECTION_YEARS)
    assert proj.select("CODGEO").distinct().count() == N
    assert proj.count() == 3 * N
    assert mp["importance"].count() == len(feats)


def test_analytical_shuffles_grow_with_the_input(spark, monkeypatch):
    """A task's memory is a share of the input: more splits, more shuffle partitions, and the session's number after it."""
    from tessera.plans import q_analysis
    from tests.conftest import SF_SMALL
    name, seen = "spark.sql.shuffle.partitions", []
    own, cut = spark.conf.get(name), q_analysis.cut_lineage
    monkeypatch.setattr(q_analysis, "cut_lineage", lambda df: (seen.append(int(spark.conf.get(name))), cut(df))[1])
    want = sorted(map(str, q_analysis.analytical(spark, SF_SMALL).select("o_custkey", "annee", *q_analysis.TARGETS).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = sorted(map(str, q_analysis.analytical(spark, SF_SMALL).select("o_custkey", "annee", *q_analysis.TARGETS).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want and spark.conf.get(name) == own
    assert seen[1] >= 2 * seen[0] and seen[1] > 8 * int(own)
