"""Stage 1 as one composition: raw files -> the staging tables that ``territory`` reads.

Each table is a lazy scan that reads only its columns.  Which snapshot is read is
decided from file names, so other snapshots are never scanned.  Delimited files are
read as strings, so codes keep their leading zeros; the few columns that later steps
compare or sum as numbers are cast here, and codes are padded where the source pads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import domain
from tessera.functions.codes import zfill
from tessera.operators.quality import missing_columns
from tessera.operators.reshape import ordered_unique
from tessera.sources import files as S
from tessera.sources.manifest import stage_summary
from tessera.sources.sinks import write_parquet


def first_round(df: DataFrame, marker: str = domain.ELECTION_ROUND) -> DataFrame:
    """rows whose election id contains the marker (pushed down to the scan)."""
    return df.where(F.col("id_election").contains(marker))


def census_columns(have) -> list:
    """Wanted columns of the recent census, every service column, then the former census; absent ones are left out."""
    services = [c for c in have if c.startswith(domain.CENSUS_SERVICE_PREFIX)]
    return ordered_unique(c for c in [*domain.CENSUS_RECENT_COLS, *services, *domain.CENSUS_FORMER_COLS] if c in have)


def stage_census(spark: SparkSession, path: str) -> tuple[DataFrame, list]:
    """(table, wanted recent columns that the file lacks)."""
    df = S.read_delimited(spark, path)
    return df.select(*census_columns(df.columns)), missing_columns(df, domain.CENSUS_RECENT_COLS[1:])


def stage_crimes(spark: SparkSession, raw: str) -> dict:
    """The last municipal file for the years of the elections, and the first departmental file; {} without a municipal file."""
    last, dep = S.latest_file(spark, f"{raw}/criminalite/donnee-comm-*.parquet"), S.latest_file(spark, f"{raw}/criminalite/donnee-dep-*.csv", first=True)
    if not last:
        return {}
    out = {"criminalite": S.read_parquet(spark, last, domain.CRIME_COLS).where(F.col("annee").isin(domain.CRIME_SOURCE_YEARS))}
    if dep:
        out["criminalite_dep"] = S.read_delimited(spark, dep).withColumn("annee", F.col("annee").cast("int"))
    return out


def stage_registry(spark: SparkSession, raw: str) -> dict:
    """All files of the last registry snapshot, municipality codes padded to five; {} without a snapshot."""
    files = S.latest_folder(spark, f"{raw}/associations/rna_waldec_*/*.csv")
    if not files:
        return {}
    rna = S.read_delimited(spark, files, cols=["adrs_codeinsee", "date_creat", "date_disso"])
    return {"rna": rna.withColumn("adrs_codeinsee", zfill("adrs_codeinsee", 5))}


def _counts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return S.read_delimited(spark, path, cols=["CODGEO", kind, "NB"]).withColumns({kind: F.col(kind).cast("int"), "NB": F.col("NB").cast("double")})


def stage_references(spark: SparkSession, raw: str) -> dict:
    """Municipalities, departments, regions, municipality changes and the density grid."""
    ref = f"{raw}/referentiels"

    def read(pattern, cols=None):
        path = S.latest_file(spark, f"{ref}/{pattern}")
        if path is None:
            raise FileNotFoundError(f"{ref}/{pattern}")
        return S.read_delimited(spark, path, sep=",", cols=cols)

    return {"ref_communes": read("v_commune_2025.csv", ["COM", "DEP", "REG", "LIBELLE", "TYPECOM"]),
            "ref_departements": read("v_departement_*.csv", ["DEP", "REG", "LIBELLE"]),
            "ref_regions": read("v_region_*.csv", ["REG", "LIBELLE"]),
            "ref_mvt_communes": read("v_mvt_commune_*.csv").withColumn("MOD", F.col("MOD").cast("int")),
            "ref_densite": S.read_sheet_export(spark, f"{ref}/fichier_diffusion_2025.csv", "CODGEO").select("CODGEO", "DENS", "DENS7")}


def staging_tables(spark: SparkSession, raw: str) -> dict:
    """All staging tables by name, lazily.  Crime and registry tables are left out where
    their files are missing, as in the source; any other missing file is an error."""
    raw = raw.rstrip("/")
    census = f"{raw}/recensement"
    return {"elections_general_pres_t1": first_round(S.read_parquet(spark, f"{raw}/elections/general_results.parquet", domain.GENERAL_COLS)),
            "elections_candidats_pres_t1": first_round(S.read_parquet(spark, f"{raw}/elections/candidats_results.parquet", domain.CANDIDATE_COLS)),
            "dossier_complet_extract": stage_census(spark, f"{census}/dossier_complet/dossier_complet.csv")[0],
            **stage_crimes(spark, raw),
            "immigres": _counts(spark, f"{census}/TD_IMG1A_2022_csv/TD_IMG1A_2022.csv", "IMMI"),
            "etrangers": _counts(spark, f"{census}/TD_NAT1_2022_csv/TD_NAT1_2022.csv", "INATC"),
            **stage_registry(spark, raw),
            **stage_references(spark, raw)}


def write_staging(spark: SparkSession, raw: str, out: str) -> DataFrame:
    """Writes every staging table below ``out`` and returns the stage's summary (files, MB)."""
    for name, df in staging_tables(spark, raw).items():
        write_parquet(df, f"{out.rstrip('/')}/{name}.parquet")
    return stage_summary(spark, out)
