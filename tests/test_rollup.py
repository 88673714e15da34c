"""Roll-up, lookup, pivot, point-in-time and overlay operators on small synthetic frames
(mirrors the reference's smoke tests: families present, no unknowns, n x 2 rows)."""

import random

from pyspark.sql import functions as F

from tessera import domain
from tessera.operators import rollup as R
from tessera.operators.reshape import vintage_stack

CANDIDATES = [("MACRON", "Emmanuel"), ("Le Pen", "Marine"), ("Mélenchon", "Jean-Luc"), ("FILLON", "François"),
              ("Jadot", "Yannick"), ("Hidalgo", "Anne")]


def elections(spark, n=20):
    rnd = random.Random(0)
    gen, cand = [], []
    for year in ("2017_pres_t1", "2022_pres_t1"):
        for i in range(n):
            code = f"{10000 + i:05d}"
            for bv in range(2):
                votes = [rnd.randint(10, 900) for _ in CANDIDATES]
                gen.append((year, code, str(bv), 5000, 1000, 4000, 100, -50 if bv == 0 else 50, sum(votes)))
                for (nom, prenom), v in zip(CANDIDATES, votes):
                    cand.append((year, code, str(bv), nom, prenom, v))
    g = spark.createDataFrame(gen, "id_election string, code_commune string, code_bv string, inscrits long, "
                                   "abstentions long, votants long, blancs long, nuls long, exprimes long")
    c = spark.createDataFrame(cand, "id_election string, code_commune string, code_bv string, nom string, "
                                    "prenom string, voix long")
    return g, c


def test_family_rollup_shape_and_families(spark):
    g, c = elections(spark)
    fam = R.lookup_table(spark, domain.CANDIDATE_FAMILY, ["nom_norm", "prenom_norm"], "famille")
    out = R.family_rollup(g, c, fam, place_col="code_commune", election_col="id_election",
                          count_cols=["inscrits", "abstentions", "votants", "blancs", "nuls", "exprimes"],
                          vote_col="voix", surname_col="nom", firstname_col="prenom",
                          family_values=domain.FAMILIES, positive_col="inscrits", clip_cols=["nuls"])
    rows = out.collect()
    assert len(rows) == 40
    assert {r["annee"] for r in rows} == {"2017", "2022"}
    assert all(r["INCONNU"] == 0 for r in rows)               # every candidate mapped; pivot cells zero-filled
    assert all(r["souverainisme"] == 0 for r in rows)         # absent family zero-filled
    assert all(r["nuls"] == 0 for r in rows)                  # -50 + 50 clipped sum stays >= 0
    assert all(r["liberalisme_centre"] > 0 and r["droite_nationale"] > 0 for r in rows)
    shares = R.family_shares(out, domain.FAMILIES, "exprimes").collect()
    assert all(0 <= r["pct_liberalisme_centre"] <= 100 for r in shares)


def test_unmapped_values(spark):
    c = spark.createDataFrame([("X", "Unknown"), ("Macron", "Emmanuel")], "nom string, prenom string")
    fam = R.lookup_table(spark, domain.CANDIDATE_FAMILY, ["nom_norm", "prenom_norm"], "famille")
    assert [tuple(r) for r in R.unmapped_values(c, fam, "nom", "prenom").collect()] == [("X", "Unknown")]


def test_active_at_dates_semantics(spark):
    rows = [("A", "2017-04-23", "0001-01-01"),   # open, created on the day -> active
            ("A", "2017-01-01", "2017-04-23"),   # dissolved on the day -> not active
            ("A", "2017-01-01", None),           # NULL end -> not active
            ("A", "2010-01-01", "2022-04-11"),   # active at both dates
            ("B", "2023-01-01", "0001-01-01")]   # created later -> never
    df = spark.createDataFrame(rows, "k string, s string, e string")
    got = {(r["k"], r["annee"]): r["nb_active"] for r in
           R.active_at_dates(df, "k", "s", "e", domain.ACTIVE_DATES).collect()}
    assert got == {("A", "2017"): 2, ("A", "2022"): 2}


def test_fallback_overlay(spark):
    base = spark.createDataFrame([("c1", "D1"), ("c2", "D1"), ("c3", "D2")], "code string, dep string")
    ent = spark.createDataFrame([("c1", 5.0, None)], "code string, v double, w double")
    par = spark.createDataFrame([("D1", 1.0, 2.0)], "dep string, v double, w double")
    got = {r["code"]: (r["crim_v"], r["crim_w"]) for r in
           R.fallback_overlay(base, "code", "dep", ent, par, ["v", "w"], prefix="crim_").collect()}
    assert got == {"c1": (5.0, 2.0), "c2": (1.0, 2.0), "c3": (None, None)}


def test_conditional_share(spark):
    df = spark.createDataFrame([("a", 1, 30.0), ("a", 0, 70.0), ("b", 0, 0.0)], "k string, immi int, nb double")
    got = {r["k"]: r["pct"] for r in R.conditional_share(df, ["k"], "nb", F.col("immi") == 1).collect()}
    assert got == {"a": 30.0}


def test_vintage_stack_rules(spark):
    wide = spark.createDataFrame([("01001", 1.0, 2.0, 3.0, 4.0, 9.0)],
                                 "CODGEO string, P22_POP double, C22_MEN_CELIBATAIRE double, "
                                 "P16_POP double, C16_MEN_NONMARIEE double, MED21 double")
    out = vintage_stack(wide, {"2022": ("P22_", "C22_"), "2017": ("P16_", "C16_")},
                        {"2017": domain.VINTAGE_SYNONYMS})
    got = {r["annee"]: (r["P_POP"], r["C_MEN_CELIBATAIRE"], r["MED21"]) for r in out.collect()}
    assert got == {"2022": (1.0, 2.0, 9.0), "2017": (3.0, 4.0, 9.0)}


def test_unknown_bucket_null_only_without_candidates(spark):
    g, c = elections(spark, 2)
    extra = spark.createDataFrame([("2017_pres_t1", "99999", "0", 10, 1, 9, 0, 0, 9)],
                                  "id_election string, code_commune string, code_bv string, inscrits long, "
                                  "abstentions long, votants long, blancs long, nuls long, exprimes long")
    fam = R.lookup_table(spark, domain.CANDIDATE_FAMILY, ["nom_norm", "prenom_norm"], "famille")
    out = R.family_rollup(g.unionByName(extra), c, fam, place_col="code_commune", election_col="id_election",
                          count_cols=["inscrits", "exprimes"], vote_col="voix", surname_col="nom",
                          firstname_col="prenom", family_values=domain.FAMILIES)
    got = {r["code_commune"]: (r["INCONNU"], r["ecologisme"]) for r in out.where("annee = '2017'").collect()}
    assert got["99999"] == (None, 0) and got["10000"][0] == 0
