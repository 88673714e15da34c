"""Reference-shaped compositions on the staging schemas.

These wire the generic operators to the column names of the election /
census / crime / immigration / association / geography staging tables.
Every step is a DataFrame transformation; lookups are literal tables,
pivots use fixed value lists, and the code history is the closed merge map.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import domain
from tessera.functions.codes import has_no_prefix_keep_null, strip_float_suffix, valid_code, zfill
from tessera.functions.numeric import clean_suppressed, safe_ratio, strict_number
from tessera.functions.text import underscore_label
from tessera.operators import export as E
from tessera.operators import rollup as R
from tessera.operators.codes import first_per_key, harmonize
from tessera.operators.features import ByPeriod, Custom, PartsOrTotal, Ratio, ratio_features
from tessera.operators.reshape import ordered_unique, vintage_stack
from tessera.operators.schema import Field, Schema, Table


# ----------------------------------------------------------------------------- cleaning

def clean_numeric_columns(df: DataFrame, key: str = "CODGEO") -> DataFrame:
    """D3: every string column except the key: 's' -> NULL, ',' -> '.', coerce (one select)."""
    cols = []
    for f in df.schema.fields:
        if f.name != key and isinstance(f.dataType, T.StringType):
            cols.append(clean_suppressed(f.name).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def clean_registry(rna: DataFrame, code_col: str = "adrs_codeinsee", created: str = "date_creat",
                   dedupe="full_row") -> DataFrame:
    """D4: '.0' artefact removed, zero-padded to 5, invalid codes and dates
    dropped, duplicates removed (the whole row by default, as the source)."""
    r = rna.withColumn(code_col, zfill(strip_float_suffix(code_col), 5))
    r = r.where(valid_code(code_col, 5, domain.INVALID_CODES))
    r = r.where((F.col(created) != domain.OPEN_SENTINEL) & (F.col(created) <= domain.MAX_VALID_DATE))
    return r.distinct() if dedupe == "full_row" else r.dropDuplicates(list(dedupe))


# ----------------------------------------------------------------------------- aggregations

def families_table(spark, mapping=None) -> DataFrame:
    return R.lookup_table(spark, mapping or domain.CANDIDATE_FAMILY, ["nom_norm", "prenom_norm"], "famille")


def aggregate_elections(general: DataFrame, candidates: DataFrame, code_map: DataFrame | None,
                        families: DataFrame | None = None) -> DataFrame:
    """Polling stations -> CODGEO x annee with the six counts and votes per family."""
    g = harmonize(general, "code_commune", code_map)
    c = harmonize(candidates, "code_commune", code_map)
    fam = families if families is not None else families_table(general.sparkSession)
    out = R.family_rollup(g, c, fam, place_col="code_commune", election_col="id_election",
                          count_cols=["inscrits", "abstentions", "votants", "blancs", "nuls", "exprimes"],
                          vote_col="voix", surname_col="nom", firstname_col="prenom",
                          family_values=domain.FAMILIES, positive_col="inscrits", clip_cols=["nuls"])
    return out.withColumnRenamed("code_commune", "CODGEO")


def aggregate_immigration(img: DataFrame, code_map: DataFrame | None) -> DataFrame:
    """pct_immigres = share of NB where IMMI = 1, per commune with a positive total."""
    h = harmonize(img, "CODGEO", code_map)
    return R.conditional_share(h, ["CODGEO"], "NB", F.col("IMMI") == 1, out_col="pct_immigres")


def aggregate_associations(rna: DataFrame, code_map: DataFrame | None, dates=None) -> DataFrame:
    """Associations active at each election date, per commune."""
    h = harmonize(rna, "adrs_codeinsee", code_map).withColumnRenamed("adrs_codeinsee", "CODGEO")
    return R.active_at_dates(h, "CODGEO", "date_creat", "date_disso", dates or domain.ACTIVE_DATES,
                             out_col="nb_associations")


def aggregate_crimes(comm: DataFrame, dep: DataFrame, code_map: DataFrame | None, ref_communes: DataFrame,
                     categories=None, periods=None) -> DataFrame:
    """Mean rate per category over the period's years, published commune
    values overlaid on the department values, for every commune of the
    reference list; columns crim_<category>."""
    spark = comm.sparkSession
    periods = periods or domain.CRIME_YEARS
    cat = R.lookup_table(spark, categories or domain.CRIME_CATEGORY, "indicateur", "categorie")
    c = harmonize(comm, "CODGEO_2025", code_map).withColumnRenamed("CODGEO_2025", "CODGEO")
    c = R.lookup_with_default(c, cat, "indicateur", "categorie", default=None)
    c = R.attach_period(c, "annee", periods, "scrutin")
    ent = R.pivot_sum(c.where(F.col("est_diffuse") == "diff"), ["CODGEO", "scrutin"], "categorie",
                      domain.CRIME_CATEGORIES, "taux_pour_mille", zero_fill=[], agg="avg")
    d = R.lookup_with_default(dep, cat, "indicateur", "categorie", default=None)
    d = d.withColumn("taux_pour_mille", strict_number("taux_pour_mille"))      # C6: strict parse
    d = R.attach_period(d, "annee", periods, "scrutin")
    par = R.pivot_sum(d, ["Code_departement", "scrutin"], "categorie", domain.CRIME_CATEGORIES,
                      "taux_pour_mille", zero_fill=[], agg="avg").withColumnRenamed("Code_departement", "DEP")
    base = ref_communes.where(F.col("TYPECOM") == "COM").select(F.col("COM").alias("CODGEO"), "DEP")
    out = R.fallback_overlay(base, "CODGEO", "DEP", ent, par, domain.CRIME_CATEGORIES, periods=list(periods),
                             period_col="scrutin", prefix="crim_")
    return out.drop("DEP").withColumnRenamed("scrutin", "annee")


# ----------------------------------------------------------------------------- analytical table

def commune_info(ref_communes: DataFrame, code_map: DataFrame | None) -> DataFrame:
    """First row per harmonised code: the surviving commune's own row first."""
    info = (ref_communes.where(F.col("TYPECOM") == "COM")
            .select(F.col("COM").alias("CODGEO"), F.col("COM").alias("_orig"), "DEP", "REG",
                    F.col("LIBELLE").alias("lib_commune")))
    info = harmonize(info, "CODGEO", code_map).withColumn("_renamed", F.col("_orig") != F.col("CODGEO"))
    return first_per_key(info, "CODGEO", ["_renamed", "_orig"]).drop("_orig", "_renamed")


def build_analytical_table(elections: DataFrame, census: DataFrame, crimes: DataFrame, immigration: DataFrame,
                           associations: DataFrame, ref_communes: DataFrame, ref_density: DataFrame,
                           code_map: DataFrame | None, years=("2017", "2022"),
                           vintages=None, min_population: float = domain.MIN_POPULATION) -> DataFrame:
    """Elections (base grain) <- census (vintage-stacked) <- crimes <- immigration
    <- associations <- density <- commune info; then the population and
    overseas filters (a NULL department is kept)."""
    vintages = vintages or {"2022": ("P22_", "C22_"), "2017": ("P16_", "C16_")}
    e = elections.where(F.col("annee").isin(list(years)))
    dc = clean_numeric_columns(harmonize(census, "CODGEO", code_map))
    stacked = vintage_stack(dc, vintages, {"2017": domain.VINTAGE_SYNONYMS})
    t = (e.join(stacked, ["CODGEO", "annee"], "left")
          .join(crimes, ["CODGEO", "annee"], "left")
          .join(immigration, "CODGEO", "left")
          .join(associations, ["CODGEO", "annee"], "left")
          .join(harmonize(ref_density, "CODGEO", code_map), "CODGEO", "left")
          .join(commune_info(ref_communes, code_map), "CODGEO", "left"))
    t = t.where(F.col("P_POP").isNotNull() & (F.col("P_POP") >= min_population))
    return t.where(has_no_prefix_keep_null(F.col("DEP").cast("string"), ["97"]))


def _blank_null_share(df: DataFrame):
    if not {"blancs", "nuls", "votants"} <= set(df.columns):
        return None
    return safe_ratio(F.coalesce(F.col("blancs"), F.lit(0)) + F.col("nuls"), "votants")


REFERENCE_FEATURES = [
    Ratio("taux_abstention", "abstentions", "inscrits"),
    Custom("taux_blancs_nuls", _blank_null_share),
    *[Ratio(f"pct_{f}", f, "exprimes") for f in domain.FAMILIES],
    Ratio("taux_chomage", "P_CHOM1564", "P_ACT1564"),
    Ratio("taux_activite", "P_ACT1564", "P_POP1564"),
    PartsOrTotal("pct_diplome_sup", ["P_NSCOL15P_SUP2", "P_NSCOL15P_SUP34", "P_NSCOL15P_SUP5"], "P_NSCOL15P_SUP",
                 "P_NSCOL15P"),
    Ratio("pct_sans_diplome", "P_NSCOL15P_DIPLMIN", "P_NSCOL15P"),
    Ratio("pct_cadres", "C_ACTOCC1564_STAT_GSEC13", "P_ACTOCC1564"),
    Ratio("pct_ouvriers", "C_ACTOCC1564_STAT_GSEC16", "P_ACTOCC1564"),
    Ratio("taux_logements_vacants", "P_LOGVAC", "P_LOG"),
    Ratio("pct_proprietaires", "P_RP_PROP", "P_RP"),
    Ratio("pct_hlm", "P_RP_LOCHLMV", "P_RP"),
    Ratio("pct_menages_seuls", "C_MENPSEUL", "C_MEN"),
    Ratio("pct_familles_mono", "C_MENFAMMONO", "C_MEN"),
    Ratio("densite_associative", "nb_associations", "P_POP", 1000.0, fill_num=True),
    ByPeriod("solde_naturel", "annee", {"2017": ("NAISD17", "DECESD17"), "2022": ("NAISD22", "DECESD22")},
             den="P_POP", scale=1000.0),
    Ratio("pct_emploi_agri", "C_EMPLT_AGRI", "P_EMPLT"),
    Ratio("pct_emploi_indus", "C_EMPLT_INDUS", "P_EMPLT"),
    Ratio("pct_emploi_const", "C_EMPLT_CONST", "P_EMPLT"),
    Ratio("pct_emploi_services", "C_EMPLT_CTS", "P_EMPLT"),
    Ratio("pct_emploi_public", "C_EMPLT_APESAS", "P_EMPLT"),
]


def compute_features(table: DataFrame) -> DataFrame:
    """All reference ratio features whose inputs exist, in one projection."""
    return ratio_features(table, REFERENCE_FEATURES)


# ----------------------------------------------------------------------------- selection helpers

def service_columns(df: DataFrame) -> list:
    """Facility-count columns ('BPE' anywhere, or an 'NB_' prefix)."""
    return [c for c in df.columns if "BPE" in c.upper() or c.startswith("NB_")]


def reference_composites(df: DataFrame) -> list:
    """M7 composite specs (kind names as in :func:`tessera.operators.select.composite_columns`)."""
    specs = [("indice_precarite", "minmax_mean", ["taux_chomage", "TP6021", "pct_sans_diplome"]),
             ("tension_emploi", "product", ["taux_chomage", "pct_emploi_indus"])]
    bpe = service_columns(df)
    if bpe and "P_POP" in df.columns:
        specs.append(("densite_services", "density", bpe, "P_POP"))
    specs.append(("pression_associative_rel", "shifted_ratio", ["densite_associative", "taux_chomage"]))
    have = set(df.columns)
    return [s for s in specs if all(c in have for c in s[2])]


def final_columns(df: DataFrame, selected, targets=tuple(domain.TARGETS)) -> list:
    """Identifiers, targets, selected features, auxiliary rates; de-duplicated in order."""
    have = set(df.columns)
    cols = ([c for c in domain.IDENTIFIERS if c in have] + [c for c in targets if c in have] + list(selected)
            + [c for c in domain.AUXILIARY if c in have and c not in selected])
    return ordered_unique(cols)


# ----------------------------------------------------------------------------- relational export

def relational_model(table: DataFrame, regions: DataFrame, departements: DataFrame) -> dict:
    """The eight tables of the relational model as DataFrames."""
    spark = table.sparkSession
    region = E.used_dimension(regions, table, "REG", "REG", "LIBELLE")
    departement = (E.used_dimension(departements, table, "DEP", "DEP", "LIBELLE", "REG", numeric_code=False)
                   .withColumnRenamed("code_parent", "code_region"))
    commune = (E.entity_dimension(table, "CODGEO", "annee", "lib_commune", "DEP", "P_POP")
               .withColumnRenamed("code_parent", "code_departement"))
    scrutin = spark.createDataFrame(domain.ELECTIONS, "id int, type string, tour int, date string")
    famille = spark.createDataFrame([(k, v) for k, v in domain.FAMILY_CLEAVAGE.items()],
                                    "code string, clivage_dominant string").select(
        "code", underscore_label("code").alias("nom"), "clivage_dominant")
    candidat = E.constant_dimension(spark, [(n, p, f) for (n, p), f in domain.CANDIDATE_FAMILY.items()],
                                    "nom string, prenom string, code_famille string", ["nom", "prenom"], "id")
    ids = F.create_map(*[x for k, v in domain.ELECTION_IDS.items() for x in (F.lit(k), F.lit(v))])
    t = table.withColumn("id_scrutin", ids[F.col("annee")]).where(F.col("id_scrutin").isNotNull())
    t = E.surrogate_ids(t, ["annee", "CODGEO"], "id")
    indicators = {c: c for c in domain.SOCIO_EXPORT_COLS}
    indicators.update(domain.INCOME_EXPORT_NAMES)
    have = set(t.columns)
    observation = t.select(
        "id", F.col("CODGEO").alias("code_commune"), F.col("id_scrutin").cast("int"),
        *[E.finite_or_null(c).cast("long").alias(c) if c in have else F.lit(None).cast("long").alias(c)
          for c in domain.ELECTION_COUNT_COLS],
        *[(E.finite_or_null(s) if s in have else F.lit(None).cast("double")).alias(d) for s, d in indicators.items()])
    fam_t = t.select("id", "exprimes", *[F.col(f) if f in have else F.lit(None).cast("long").alias(f)
                                         for f in domain.FAMILIES])
    resultat = E.result_fact(fam_t, domain.FAMILIES, "exprimes")
    return {"region": region.select("code", "nom"), "departement": departement, "commune": commune,
            "scrutin": scrutin, "famille_politique": famille, "candidat": candidat.select("id", "nom", "prenom", "code_famille"),
            "observation": observation, "resultat": resultat}


def relational_schema() -> Schema:
    """V7/K3: the schema of ``relational_model``'s tables."""
    def must(name, type, references=None, default=None):
        return Field(name, type, False, default, references)

    indicators = [*domain.SOCIO_EXPORT_COLS, *domain.INCOME_EXPORT_NAMES.values()]
    return Schema([
        Table("region", (must("code", "VARCHAR(3)"), must("nom", "VARCHAR(100)")), ("code",)),
        Table("departement", (must("code", "VARCHAR(3)"), must("nom", "VARCHAR(100)"), must("code_region", "VARCHAR(3)", ("region", "code"))), ("code",)),
        Table("commune", (must("code", "VARCHAR(5)"), must("nom", "VARCHAR(150)"), Field("population", "INTEGER"),
                          must("code_departement", "VARCHAR(3)", ("departement", "code"))), ("code",)),
        Table("scrutin", (must("id", "INTEGER"), must("type", "VARCHAR(50)"), must("tour", "INTEGER"), must("date", "DATE")), ("id",)),
        Table("famille_politique", (must("code", "VARCHAR(30)"), must("nom", "VARCHAR(60)"), must("clivage_dominant", "VARCHAR(200)")), ("code",)),
        Table("candidat", (must("id", "INTEGER"), must("nom", "VARCHAR(100)"), must("prenom", "VARCHAR(100)"),
                           must("code_famille", "VARCHAR(30)", ("famille_politique", "code"))), ("id",)),
        Table("observation", (must("id", "INTEGER"), must("code_commune", "VARCHAR(5)", ("commune", "code")), must("id_scrutin", "INTEGER", ("scrutin", "id")),
                              *[Field(c, "INTEGER") for c in domain.ELECTION_COUNT_COLS],
                              *[Field(c, domain.INDICATOR_TYPES.get(c, "DECIMAL(6,2)")) for c in indicators]), ("id",), (("code_commune", "id_scrutin"),)),
        Table("resultat", (must("id_observation", "INTEGER", ("observation", "id")), must("code_famille", "VARCHAR(30)", ("famille_politique", "code")),
                           must("voix", "INTEGER", default="0"), Field("pourcentage", "DECIMAL(6,2)")), ("id_observation", "code_famille")),
    ])


def export_statements(model: dict) -> DataFrame:
    """K3: INSERT batches of every table of the model, tables in load order."""
    return relational_schema().statements(model)


# ----------------------------------------------------------------------------- feature analysis and models

def numeric_candidates(df: DataFrame, exclude=tuple(domain.NON_CANDIDATES), targets=tuple(domain.TARGETS),
                       families=tuple(domain.FAMILIES)) -> list:
    """Numeric columns that are neither identifiers, counts, targets nor family votes (sorted)."""
    skip = set(exclude) | set(targets) | set(families)
    return sorted(f.name for f in df.schema.fields
                  if f.name not in skip and isinstance(f.dataType, T.NumericType))


def feature_analysis(table: DataFrame, targets=tuple(domain.TARGETS), group_cols=("DEP", "annee"),
                     period_col: str = "annee", periods=("2017", "2022"), forced=tuple(domain.FORCED_FEATURES),
                     mi_threshold: float = domain.MI_MIN) -> dict:
    """Audit -> drop unusable -> correlations -> collinearity pruning ->
    imputation (group medians, chained equations on incomes) -> composites ->
    log transforms -> final selection.  Returns the DataFrames of every stage
    ('audit', 'correlations', 'clusters', 'composites', 'log_gate', 'mi',
    'selection', 'final') and the final feature list under 'features'."""
    from tessera.operators import impute as I
    from tessera.operators import profile as P
    from tessera.operators import select as S
    from tessera.session import cut_lineage

    targets = [t for t in targets if t in table.columns]
    df = cut_lineage(table)
    feats = numeric_candidates(df)
    audit = cut_lineage(P.column_profile(df, feats, period_col, periods))
    unusable = {r["feature"] for r in audit.where(F.col("statut") == "inutilisable").select("feature").collect()}
    feats = [f for f in feats if f not in unusable]
    corr = P.correlations(df, feats, targets)
    clusters = P.prune_collinear(P.average_linkage_clusters(P.correlations(df, feats), feats))
    kept = {r["feature"] for r in clusters.where("kept").select("feature").collect()}
    feats = [f for f in feats if f in kept]
    # imputation sees the un-pruned table, as the source does
    med_cols = [c for c in ("TP6021", "crim_stupefiants") if c in df.columns]
    if med_cols and all(g in df.columns for g in group_cols):
        df = I.group_median_impute(df, med_cols, list(group_cols))
    income = [c for c in domain.INCOME_FEATURES if c in df.columns]
    if income:
        df = I.chained_impute(df, income)
    df = cut_lineage(df)
    specs = reference_composites(df)
    comps = S.composite_columns(df, specs)
    gate = S.composite_gate(df, comps, targets, components={s[0]: s[2] for s in specs}) if specs else None
    if gate is not None:
        keep = [r["composite"] for r in gate.where("kept").collect()]
        df = df.withColumns({k: comps[k] for k in keep})
        feats += keep
    log = S.log_gate(df, audit, feats)
    rows = log.collect()
    df = S.apply_log_gate(df, rows)
    feats = [f"log1p_{f}" if any(r["feature"] == f and r["transformed"] for r in rows) else f for f in feats]
    df = cut_lineage(df)
    # selection view: features NULL -> 0, targets NULL -> their median (as the source)
    sel_view = I.fill_with_medians(df.fillna(0.0, subset=feats), targets)
    mi = S.binned_mutual_info(sel_view, feats, targets)
    sel = S.select_features(mi, [f for f in forced if f in feats], mi_threshold)
    chosen = [r["feature"] for r in sel.where("selected").collect()]
    chosen = [f for f in feats if f in chosen]
    final = df.select(*final_columns(df, chosen, targets))
    return {"audit": audit, "correlations": corr, "clusters": clusters, "composites": gate, "log_gate": log,
            "mi": mi, "selection": sel, "final": final, "features": chosen}


def model_and_projection(final: DataFrame, features, targets=tuple(domain.TARGETS), key_cols=("CODGEO", "annee"),
                         early: str = "2017", late: str = "2022", years=tuple(domain.PROJECTION_YEARS),
                         families=None) -> dict:
    """Compare the model families, refit the best on all rows, test
    predictions, permutation importance, and model-based projections of the
    targets for the next years.  Returns DataFrames: 'comparison', 'summary',
    'predictions', 'importance', 'projections' and the best family name."""
    from tessera.operators import model as MD
    from tessera.operators.project import trend_projection
    from tessera.session import cut_lineage

    targets, features = list(targets), list(features)
    comp, best, fitted, train, test = MD.compare_models(final, list(key_cols), features, targets,
                                                        families=tuple(families or MD.FAMILIES))
    ids = [c for c in ("CODGEO", "annee", "DEP", "lib_commune") if c in test.columns]
    predictions = MD.test_predictions(fitted[best], test, ids, targets)
    importance = MD.permutation_importance(fitted[best], test, list(key_cols), features, targets)
    full = cut_lineage(MD.prepare(final, features, targets))
    refit = MD.fit_models(full, features, targets, [best], key_cols)[best]
    meta = [c for c in ("DEP", "lib_commune") if c in final.columns]
    proj = trend_projection(final, key_cols[0], key_cols[1], early, late, features, years, meta_cols=meta, digits=None)
    pred = MD.predict(refit, proj)
    projections = pred.select(key_cols[0], "annee_projetee",
                              *[MD.round_half_even(f"p_{t}", 4).alias(t.replace("pct_", "pct_pred_")) for t in targets],
                              *meta)
    return {"comparison": comp, "summary": MD.summary(comp), "best": best, "predictions": predictions,
            "importance": importance, "projections": projections, "models": refit}
