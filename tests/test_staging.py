"""Stage 1 from raw files: the staged tables, and the analytical table built from them,
against the same rows given directly."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import quality as Q
from tessera.operators import staging as ST
from tessera.operators import territory as TT
from tessera.operators.codes import merge_history_map
from tests.test_territory import staging as synthetic_tables  # noqa: F401


def _csv(df, path, sep=";", header_lines=()):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    rows = [";".join(h.split(";")) for h in header_lines] + [sep.join(df.columns)]
    rows += [sep.join("" if v is None else str(v) for v in r) for r in df.collect()]
    with open(path, "w", encoding="utf8") as f:
        f.write("\n".join(rows) + "\n")


@pytest.fixture(scope="module")
def raw(spark, synthetic_tables):  # noqa: F811
    s, d = synthetic_tables, tempfile.mkdtemp(prefix="tessera-raw-", dir="/tmp")
    other = lambda df: df.unionByName(df.withColumn("id_election", F.lit("2022_pres_t2")))
    other(s["general"].withColumn("libelle_commune", F.lit("x"))).write.parquet(f"{d}/elections/general_results.parquet")
    other(s["candidates"].withColumn("nuance", F.lit("n"))).write.parquet(f"{d}/elections/candidats_results.parquet")
    census = s["census"].withColumnsRenamed({"NB_BPE_A": "BPE_A", "NB_BPE_B": "BPE_B"}).withColumn("UNWANTED", F.lit("1"))
    _csv(census, f"{d}/recensement/dossier_complet/dossier_complet.csv")
    comm = s["comm"].withColumn("nombre", F.lit(1))
    comm.withColumn("taux_pour_mille", F.lit(99.0)).write.parquet(f"{d}/criminalite/donnee-comm-2023.parquet")
    comm.unionByName(comm.withColumn("annee", F.lit(2019))).write.parquet(f"{d}/criminalite/donnee-comm-2024.parquet")
    _csv(s["dep"], f"{d}/criminalite/donnee-dep-2024.csv")
    _csv(s["img"], f"{d}/recensement/TD_IMG1A_2022_csv/TD_IMG1A_2022.csv")
    _csv(s["img"].withColumnRenamed("IMMI", "INATC"), f"{d}/recensement/TD_NAT1_2022_csv/TD_NAT1_2022.csv")
    _csv(s["rna"].limit(3), f"{d}/associations/rna_waldec_20230101/a.csv")
    rna = s["rna"].withColumn("titre", F.lit("t"))
    _csv(rna.where("adrs_codeinsee < '10010'"), f"{d}/associations/rna_waldec_20240101/a.csv")
    _csv(rna.where("not adrs_codeinsee < '10010'").select("titre", "date_disso", "date_creat", "adrs_codeinsee"), f"{d}/associations/rna_waldec_20240101/b.csv")
    ref = f"{d}/referentiels"
    _csv(s["ref"], f"{ref}/v_commune_2025.csv", ",")
    _csv(spark.createDataFrame([("75", "11", "Paris")], "DEP string, REG string, LIBELLE string"), f"{ref}/v_departement_2025.csv", ",")
    _csv(spark.createDataFrame([("01", "Vieille")], "REG string, LIBELLE string"), f"{ref}/v_region_2024.csv", ",")
    _csv(spark.createDataFrame([("01", "Ile")], "REG string, LIBELLE string"), f"{ref}/v_region_2025.csv", ",")
    _csv(s["mvt"], f"{ref}/v_mvt_commune_2025.csv", ",")
    _csv(s["dens"], f"{ref}/fichier_diffusion_2025.csv", header_lines=["Title;;", "Source;;", ";;", "Note;;"])
    return d


@pytest.fixture(scope="module")
def staged(spark, raw):
    out = tempfile.mkdtemp(prefix="tessera-staged-", dir="/tmp")
    summary = ST.write_staging(spark, raw, out).first()
    assert summary["n_files"] >= 13
    return {n.removesuffix(".parquet"): spark.read.parquet(f"{out}/{n}") for n in os.listdir(out)}


def test_staged_tables(staged, synthetic_tables):  # noqa: F811
    s = synthetic_tables
    assert len(staged) == 13
    assert staged["elections_general_pres_t1"].count() == s["general"].count()
    assert {r[0] for r in staged["elections_candidats_pres_t1"].select("id_election").distinct().collect()} == {"2017_pres_t1", "2022_pres_t1"}
    census = staged["dossier_complet_extract"].columns
    assert census == ["CODGEO", "P22_POP", "P22_POP1564", "P22_ACT1564", "P22_CHOM1564", "MED21", "BPE_A", "BPE_B", "P16_POP", "P16_POP1564", "P16_ACT1564", "P16_CHOM1564"]
    assert staged["criminalite"].count() == s["comm"].count() and staged["criminalite"].where("taux_pour_mille = 99").count() == 0
    assert sorted(r[0] for r in staged["rna"].select("adrs_codeinsee").collect()) == sorted(r[0].zfill(5) for r in s["rna"].select("adrs_codeinsee").collect())
    assert [tuple(r) for r in staged["ref_regions"].collect()] == [("01", "Ile")]
    assert staged["ref_densite"].columns == ["CODGEO", "DENS", "DENS7"] and staged["ref_densite"].count() == s["dens"].count()
    assert dict(staged["immigres"].dtypes) == {"CODGEO": "string", "IMMI": "int", "NB": "double"}


def test_census_reports_missing_columns(spark, raw):
    df, missing = ST.stage_census(spark, f"{raw}/recensement/dossier_complet/dossier_complet.csv")
    assert "P22_LOG" in missing and "P22_POP" not in missing and "CODGEO" not in missing


def test_missing_raw_files(spark):
    d = tempfile.mkdtemp(prefix="tessera-noraw-", dir="/tmp")
    assert ST.stage_crimes(spark, d) == {} and ST.stage_registry(spark, d) == {}
    with pytest.raises(FileNotFoundError):
        ST.stage_references(spark, d)


def _features(general, candidates, census, comm, dep, img, rna, ref, dens, mvt):
    cmap = merge_history_map(mvt)
    parts = (TT.aggregate_elections(general, candidates, cmap), census, TT.aggregate_crimes(comm, dep, cmap, ref), TT.aggregate_immigration(img, cmap),
             TT.aggregate_associations(TT.clean_registry(rna), cmap))
    return TT.compute_features(TT.build_analytical_table(*parts, ref, dens, cmap))


def test_analytical_table_from_raw_files(staged, synthetic_tables):  # noqa: F811
    s, t = synthetic_tables, staged
    got = _features(t["elections_general_pres_t1"], t["elections_candidats_pres_t1"], t["dossier_complet_extract"], t["criminalite"], t["criminalite_dep"],
                    t["immigres"], t["rna"], t["ref_communes"], t["ref_densite"], t["ref_mvt_communes"])
    census = s["census"].withColumnsRenamed({"NB_BPE_A": "BPE_A", "NB_BPE_B": "BPE_B"})
    want = _features(s["general"], s["candidates"], census, s["comm"], s["dep"], s["img"], s["rna"], s["ref"], s["dens"], s["mvt"])
    columns = sorted(set(want.columns) - {"REG"})
    assert set(want.columns) == set(got.columns)
    rows = lambda df: sorted((tuple(map(str, r)) for r in df.select(*columns).collect()))
    assert rows(got) == rows(want)


def test_constraint_checks_on_broken_tables(spark):
    """The combined checks against the single ones, with repeated, missing and orphan keys."""
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int")
    child = spark.createDataFrame([(1, "a", 0.5), (1, None, 2.0), (3, "b", None), (3, "a", -1.0), (None, "z", 0.0), (None, "z", 0.0)], "p long, q string, v double")
    named = spark.createDataFrame([("a",)], "n string")
    out = {r[0]: r[1] for r in Q.constraint_report([
        Q.table_checks(parent, "pk", "id"), Q.table_checks(child, "pk2", ["p", "q"], {"v01": ~F.col("v").between(0, 1), "nn": F.col("q").isNull()}),
        Q.fk_checks(child, {"fk_p": ("p", parent, "id"), "fk_q": ("q", named, "n")}), Q.fk_checks(child.where("false"), {"fk_none": ("p", parent, "id")}),
        Q.table_checks(parent.where("false"), "pk_none", "id", {"none": F.col("id") > 0})]).collect()}
    assert out == {"pk": 2, "pk2": 4, "v01": 2, "nn": 1, "fk_p": 2, "fk_q": 3, "fk_none": 0, "pk_none": 0, "none": 0}
    single = {r[0]: r[1] for r in Q.constraint_report([
        Q.pk_violations("pk", parent, "id"), Q.pk_violations("pk2", child, ["p", "q"]), Q.fk_violations("fk_p", child, "p", parent, "id"),
        Q.fk_violations("fk_q", child, "q", named, "n"), Q.check_violations("v01", child, F.col("v").between(0, 1)), Q.not_null_violations("nn", child, "q")]).collect()}
    assert single == {k: out[k] for k in single}
