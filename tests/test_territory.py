"""End-to-end on synthetic staging tables: merge map -> roll-ups -> analytical
table -> features -> relational export (the reference's smoke expectations:
n communes x 2 years rows, abstention within [0, 100], family shares ~ 100)."""

import glob
import random
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import domain
from tessera.operators import territory as TT
from tessera.operators.codes import merge_history_map
from tests.test_rollup import elections

N = 20


@pytest.fixture(scope="module")
def staging(spark):
    rnd = random.Random(42)
    codes = [f"{10000 + i:05d}" for i in range(N)]
    general, candidates = elections(spark, N)
    mvt = spark.createDataFrame([(32, "2019-01-01", "COM", "COM", "99001", codes[0])],
                                "MOD int, DATE_EFF string, TYPECOM_AV string, TYPECOM_AP string, COM_AV string, COM_AP string")
    census_rows = []
    for c in codes:
        pop22, pop16 = rnd.randint(2500, 9000), rnd.randint(2500, 9000)
        census_rows.append((c, str(pop22), str(pop16), str(pop22 // 2), str(pop16 // 2), str(pop22 // 20),
                            str(pop16 // 20), "s" if c == codes[1] else "21500,50", str(pop22 // 3), str(pop16 // 3),
                            str(rnd.randint(5, 50)), str(rnd.randint(5, 50))))
    census = spark.createDataFrame(census_rows, "CODGEO string, P22_POP string, P16_POP string, P22_ACT1564 string, "
                                                "P16_ACT1564 string, P22_CHOM1564 string, P16_CHOM1564 string, "
                                                "MED21 string, P22_POP1564 string, P16_POP1564 string, "
                                                "NB_BPE_A string, NB_BPE_B string")
    comm = spark.createDataFrame([(c, y, ind, 5.0 + i, "diff" if i % 3 else "ndiff")
                                  for i, c in enumerate(codes) for y in (2016, 2017, 2021, 2022)
                                  for ind in ("Vols de véhicules", "Usage de stupéfiants")],
                                 "CODGEO_2025 string, annee int, indicateur string, taux_pour_mille double, est_diffuse string")
    dep = spark.createDataFrame([("75", y, ind, "3,5") for y in (2016, 2017, 2021, 2022)
                                 for ind in ("Vols de véhicules", "Usage de stupéfiants", "Violences sexuelles")],
                                "Code_departement string, annee int, indicateur string, taux_pour_mille string")
    img = spark.createDataFrame([(c, k, float(rnd.randint(10, 100))) for c in codes for k in (1, 2)],
                                "CODGEO string, IMMI int, NB double")
    rna = spark.createDataFrame([(c + ".0" if i % 2 else c, "2010-01-01", "0001-01-01") for i, c in enumerate(codes)]
                                + [("nan", "2010-01-01", "0001-01-01")],
                                "adrs_codeinsee string, date_creat string, date_disso string")
    ref = spark.createDataFrame([(c, "75" if i < N - 1 else None, "11", f"Commune {i}", "COM") for i, c in enumerate(codes)]
                                + [("99001", "75", "11", "Ancienne", "COM")],
                                "COM string, DEP string, REG string, LIBELLE string, TYPECOM string")
    dens = spark.createDataFrame([(c, "1", "2") for c in codes], "CODGEO string, DENS string, DENS7 string")
    return dict(general=general, candidates=candidates, mvt=mvt, census=census, comm=comm, dep=dep, img=img,
                rna=rna, ref=ref, dens=dens)


def test_end_to_end(spark, staging):
    s = staging
    cmap = merge_history_map(s["mvt"])
    el = TT.aggregate_elections(s["general"], s["candidates"], cmap)
    crimes = TT.aggregate_crimes(s["comm"], s["dep"], cmap, s["ref"])
    imm = TT.aggregate_immigration(s["img"], cmap)
    assoc = TT.aggregate_associations(TT.clean_registry(s["rna"]), cmap)
    table = TT.build_analytical_table(el, s["census"], crimes, imm, assoc, s["ref"], s["dens"], cmap)
    feats = TT.compute_features(table).cache()
    rows = feats.collect()
    assert len(rows) == 2 * N
    for col in ["CODGEO", "annee", "DEP", "lib_commune", "taux_abstention", "taux_chomage", "pct_immigres",
                "crim_atteintes_biens", "crim_stupefiants", "densite_associative"] + domain.TARGETS:
        assert col in feats.columns, col
    assert all(0 <= r["taux_abstention"] <= 100 for r in rows)
    totals = sorted(sum(r[t] for t in domain.TARGETS) for r in rows)
    assert abs(totals[len(totals) // 2] - 100) <= 5
    assert {r["annee"] for r in rows} == {"2017", "2022"}
    # suppressed income value became NULL, decimal comma parsed
    med = {r["CODGEO"]: r["MED21"] for r in rows}
    assert med["10001"] is None and med["10002"] == 21500.5
    # crimes: unpublished commune rows fall back to the department mean (3.5)
    assert all(r["crim_violences"] == 3.5 for r in rows if r["DEP"] == "75")
    model = TT.relational_model(feats, spark.createDataFrame([("11", "Ile")], "REG string, LIBELLE string"),
                                spark.createDataFrame([("75", "Paris", "11")], "DEP string, LIBELLE string, REG string"))
    counts = {k: v.count() for k, v in model.items()}
    assert counts["observation"] == 2 * N and counts["resultat"] == 2 * N * 7
    assert counts["candidat"] == len(domain.CANDIDATE_FAMILY) and counts["famille_politique"] == 7
    assert counts["region"] == 1 and counts["departement"] == 1 and counts["commune"] == N
    ids = [r["id"] for r in model["observation"].orderBy("id").collect()]
    assert ids == list(range(1, 2 * N + 1))
    stmts = TT.export_statements(model).collect()
    assert all(r["statement"].startswith("INSERT INTO ") for r in stmts)
    schema = TT.relational_schema()
    assert schema.load_order() == ["region", "departement", "commune", "scrutin", "famille_politique", "candidat", "observation", "resultat"]
    report = {r["constraint_name"]: r["violations"] for r in schema.violations(model).collect()}
    assert {k: n for k, n in report.items() if n} == {"nn_commune_code_departement": 1}  # the commune without a department
    model["commune"] = model["commune"].fillna({"code_departement": "75"})
    # the written script opens with the DDL; a fresh in-memory database takes it in order
    out = f"{tempfile.mkdtemp(prefix='tessera-script-', dir='/tmp')}/script"
    schema.write_script(model, out)
    script = "\n".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(out + "/part-*")))
    assert script.startswith("CREATE TABLE region (") and script.index("BEGIN;") < script.index("INSERT INTO")
    con = duckdb.connect()
    con.execute(script)
    assert {t: con.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in counts} == counts


def test_reference_composites_and_final_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0)],
                               "taux_chomage double, TP6021 double, pct_sans_diplome double, pct_emploi_indus double, "
                               "densite_associative double, NB_BPE_X double, P_POP double")
    names = [s[0] for s in TT.reference_composites(df)]
    assert names == ["indice_precarite", "tension_emploi", "densite_services", "pression_associative_rel"]
    cols = TT.final_columns(spark.createDataFrame([("a", "2017", 1.0, 2.0)], "CODGEO string, annee string, "
                                                  "taux_abstention double, pct_ecologisme double"),
                            ["taux_abstention"])
    assert cols == ["CODGEO", "annee", "pct_ecologisme", "taux_abstention"]
