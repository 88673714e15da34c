"""Domain constants, kept as data.

The values below are FIXED VALUES that must equal the source pipeline's so
that lookups and rules give the same results.  They are stated plainly in
their natural order.  Operators take them as default parameters; nothing in
the library hard-codes them elsewhere.
"""

from __future__ import annotations

# --- fixed values: candidate (normalised surname, normalised first name) -> political family
CANDIDATE_FAMILY = {
    ("BESANCENOT", "OLIVIER"): "gauche_radicale",
    ("LAGUILLER", "ARLETTE"): "gauche_radicale",
    ("GLUCKSTEIN", "DANIEL"): "gauche_radicale",
    ("HUE", "ROBERT"): "gauche_radicale",
    ("BUFFET", "MARIE-GEORGE"): "gauche_radicale",
    ("BOVE", "JOSE"): "gauche_radicale",
    ("SCHIVARDI", "GERARD"): "gauche_radicale",
    ("MELENCHON", "JEAN-LUC"): "gauche_radicale",
    ("ARTHAUD", "NATHALIE"): "gauche_radicale",
    ("POUTOU", "PHILIPPE"): "gauche_radicale",
    ("ROUSSEL", "FABIEN"): "gauche_radicale",
    ("JOSPIN", "LIONEL"): "social_democratie",
    ("TAUBIRA", "CHRISTIANE"): "social_democratie",
    ("CHEVENEMENT", "JEAN-PIERRE"): "social_democratie",
    ("ROYAL", "SEGOLENE"): "social_democratie",
    ("HOLLANDE", "FRANCOIS"): "social_democratie",
    ("HAMON", "BENOIT"): "social_democratie",
    ("HIDALGO", "ANNE"): "social_democratie",
    ("MAMERE", "NOEL"): "ecologisme",
    ("VOYNET", "DOMINIQUE"): "ecologisme",
    ("JOLY", "EVA"): "ecologisme",
    ("JADOT", "YANNICK"): "ecologisme",
    ("BAYROU", "FRANCOIS"): "liberalisme_centre",
    ("MACRON", "EMMANUEL"): "liberalisme_centre",
    ("CHIRAC", "JACQUES"): "droite_conservatrice",
    ("MADELIN", "ALAIN"): "droite_conservatrice",
    ("BOUTIN", "CHRISTINE"): "droite_conservatrice",
    ("SARKOZY", "NICOLAS"): "droite_conservatrice",
    ("FILLON", "FRANCOIS"): "droite_conservatrice",
    ("PECRESSE", "VALERIE"): "droite_conservatrice",
    ("SAINT-JOSSE", "JEAN"): "souverainisme",
    ("LEPAGE", "CORINNE"): "souverainisme",
    ("DE VILLIERS", "PHILIPPE"): "souverainisme",
    ("NIHOUS", "FREDERIC"): "souverainisme",
    ("DUPONT-AIGNAN", "NICOLAS"): "souverainisme",
    ("ASSELINEAU", "FRANCOIS"): "souverainisme",
    ("LASSALLE", "JEAN"): "souverainisme",
    ("CHEMINADE", "JACQUES"): "souverainisme",
    ("LE PEN", "JEAN-MARIE"): "droite_nationale",
    ("MEGRET", "BRUNO"): "droite_nationale",
    ("LE PEN", "MARINE"): "droite_nationale",
    ("ZEMMOUR", "ERIC"): "droite_nationale",
}

# --- fixed values: the seven families, in their declared order
FAMILIES = [
    "gauche_radicale",
    "social_democratie",
    "ecologisme",
    "liberalisme_centre",
    "droite_conservatrice",
    "souverainisme",
    "droite_nationale",
]
UNKNOWN_FAMILY = "INCONNU"
TARGETS = [f"pct_{f}" for f in FAMILIES]

# --- fixed values: crime indicator -> category
CRIME_CATEGORY = {
    "Coups et blessures volontaires": "violences",
    "Coups et blessures volontaires intrafamiliaux": "violences",
    "Autres coups et blessures volontaires": "violences",
    "Violences sexuelles": "violences",
    "Vols avec armes": "atteintes_biens",
    "Vols violents sans arme": "atteintes_biens",
    "Vols sans violence contre des personnes": "atteintes_biens",
    "Vols dans les véhicules": "atteintes_biens",
    "Vols d'accessoires sur véhicules": "atteintes_biens",
    "Vols de véhicules": "atteintes_biens",
    "Cambriolages de logement": "atteintes_biens",
    "Destructions et dégradations volontaires": "atteintes_biens",
    "Escroqueries": "atteintes_biens",
    "Trafic de stupéfiants": "stupefiants",
    "Usage de stupéfiants": "stupefiants",
    "Usage de stupéfiants (AFD)": "stupefiants",
}
CRIME_CATEGORIES = ["violences", "atteintes_biens", "stupefiants"]

# --- fixed values: election year -> crime years averaged for it
CRIME_YEARS = {"2017": [2016, 2017], "2022": [2021, 2022]}

# --- fixed values: snapshot dates at which active associations are counted
ACTIVE_DATES = {"2017": "2017-04-23", "2022": "2022-04-10"}
OPEN_SENTINEL = "0001-01-01"
MAX_VALID_DATE = "2025-12-31"

# --- fixed values: merge movements kept for the code history
MERGE_MODS = [31, 32, 33, 34]
MERGE_MIN_DATE = "2016-01-01"

# --- fixed values: code prefixes excluded by harmonisation (consulates, overseas)
EXCLUDED_PREFIXES = ["ZZ", "97"]
INVALID_CODES = ["00nan", "00NaN", "nan00"]

# --- fixed values: vintage synonyms (older vintage name -> newer name)
VINTAGE_SYNONYMS = [("_NONMARIEE", "_CELIBATAIRE")] + [
    (f"_ACTOCC1564_CS{i}", f"_ACTOCC1564_STAT_GSEC1{i}") for i in range(1, 7)
]

# --- fixed values: feature priority by name prefix (lower = more interpretable)
PRIORITY_PREFIXES = [
    (1, ["taux_", "pct_", "solde_"]),
    (2, ["log1p_"]),
    (3, ["MED", "TP60", "D12", "D92", "RD2", "PACT", "PPEN", "PPSOC", "PIMP", "crim_", "densite_"]),
]
DEFAULT_PRIORITY = 4

# --- fixed values: income columns imputed by chained equations
INCOME_FEATURES = ["D121", "D921", "RD21", "PACT21", "PPEN21", "PPSOC21", "PIMP21", "MED21", "TP6021"]

# --- fixed values: features forced into the final selection
FORCED_FEATURES = [
    "taux_chomage", "MED21", "pct_sans_diplome", "pct_diplome_sup",
    "pct_immigres", "pct_cadres", "pct_ouvriers", "taux_abstention",
    "TP6021", "crim_violences", "crim_atteintes_biens", "densite_associative",
    "pct_emploi_indus", "pct_proprietaires", "pct_hlm",
]

# --- fixed values: thresholds
COMPLETENESS_MAX_NULL_PCT = 50.0
SKEW_LIMIT = 2.0
COLLINEARITY_CUT = 0.15
LOG_GAIN_FACTOR = 0.7
COMPOSITE_MIN_GAIN = 0.05
COMPOSITE_MIN_ROWS = 100
MI_MIN = 0.01
TEST_FRACTION = 0.2
SEED = 42
PROJECTION_YEARS = [2023, 2024, 2025]
TREND_SPAN_YEARS = 5
SQL_BATCH_ROWS = 500

# --- fixed values: export mislabels kept by default (source column -> exported name)
INCOME_EXPORT_NAMES = {
    "MED21": "revenu_median",
    "TP6021": "taux_pauvrete",
    "D121": "d1_revenu",
    "D921": "d9_revenu",
    "RD21": "rapport_interdecile",
    "PIMP21": "part_revenus_activite",
    "PACT21": "part_revenus_chomage",
    "PPEN21": "part_revenus_retraite",
    "PPSOC21": "part_prestations_sociales",
}

# --- fixed values: data-file extensions recognised by the link harvester
LINK_FILE_EXTENSIONS = [".csv", ".xlsx", ".xls", ".zip", ".gz", ".parquet", ".txt"]
LINK_TEXT_MARKER = "télécharg"
LINK_HREF_MARKER = "télécharge"

# --- fixed values: resource catalogue extensions and declared formats
CATALOGUE_EXTENSIONS = [".csv", ".parquet", ".xlsx", ".xls", ".zip", ".txt", ".gz", ".7z"]
CATALOGUE_FORMATS = ["csv", "parquet", "xlsx", "xls", "zip", "txt"]

# --- fixed values: family -> dominant cleavage label (export dimension)
FAMILY_CLEAVAGE = {
    "gauche_radicale": "clivage de classe (travailleurs), anti-système",
    "social_democratie": "clivage de classe (réformisme)",
    "ecologisme": "post-matérialisme, transition écologique",
    "liberalisme_centre": "synthèse libérale, pro-européen",
    "droite_conservatrice": "clivage de classe (possédants), ordre, tradition",
    "souverainisme": "centre/périphérie, euroscepticisme",
    "droite_nationale": "identitaire, immigration, sécurité",
}

# --- fixed values: elections (export dimension) and year -> election id
ELECTIONS = [
    (1, "presidentielle", 1, "2017-04-23"),
    (2, "presidentielle", 1, "2022-04-10"),
]
ELECTION_IDS = {"2017": 1, "2022": 2}

# --- fixed values: socio-economic indicators exported with each observation
SOCIO_EXPORT_COLS = [
    "taux_abstention", "taux_blancs_nuls", "taux_chomage", "taux_activite", "pct_diplome_sup",
    "pct_sans_diplome", "pct_cadres", "pct_ouvriers", "taux_logements_vacants", "pct_proprietaires",
    "pct_hlm", "pct_menages_seuls", "pct_familles_mono", "densite_associative", "solde_naturel",
    "pct_emploi_agri", "pct_emploi_indus", "pct_emploi_const", "pct_emploi_services", "pct_emploi_public",
    "pct_immigres", "crim_violences", "crim_atteintes_biens", "crim_stupefiants",
]
ELECTION_COUNT_COLS = ["inscrits", "votants", "abstentions", "blancs", "nuls", "exprimes"]

# --- fixed values: columns never used as features / identifiers kept in the final table
NON_FEATURES = ["CODGEO", "annee", "lib_commune", "DEP", "REG", "taux_abstention", "taux_blancs_nuls",
                "inscrits", "abstentions", "votants", "blancs", "nuls", "exprimes", "nb_associations",
                "INCONNU", "NAISD17", "DECESD17", "NAISD22", "DECESD22"]
IDENTIFIERS = ["CODGEO", "annee", "lib_commune", "DEP", "REG"]
# --- fixed values: columns that are no candidates of the feature analysis (rates may be)
NON_CANDIDATES = ["CODGEO", "annee", "lib_commune", "DEP", "REG", "inscrits", "abstentions", "votants", "blancs", "nuls",
                  "exprimes", "nb_associations", "INCONNU", "NAISD17", "DECESD17", "NAISD22", "DECESD22"]
AUXILIARY = ["taux_abstention", "taux_blancs_nuls"]
MIN_POPULATION = 2000

# --- fixed values: columns of the staged raw tables
ELECTION_ROUND = "pres_t1"
GENERAL_COLS = ["id_election", "code_commune", "libelle_commune", "code_bv", "inscrits", "abstentions", "votants", "blancs", "nuls", "exprimes"]
CANDIDATE_COLS = ["id_election", "code_commune", "code_bv", "voix", "nom", "prenom", "nuance"]
CENSUS_RECENT_COLS = [
    "CODGEO",
    "P22_POP", "P22_POP0014", "P22_POP1529", "P22_POP3044", "P22_POP4559", "P22_POP6074", "P22_POP7589", "P22_POP90P",
    "P22_NSCOL15P", "P22_NSCOL15P_DIPLMIN", "P22_NSCOL15P_BEPC", "P22_NSCOL15P_CAPBEP", "P22_NSCOL15P_BAC",
    "P22_NSCOL15P_SUP2", "P22_NSCOL15P_SUP34", "P22_NSCOL15P_SUP5",
    "P22_POP1564", "P22_ACT1564", "P22_ACTOCC1564", "P22_CHOM1564", "P22_INACT1564", "P22_RETR1564", "P22_ETUD1564", "P22_EMPLT",
    "C22_ACTOCC1564_STAT_GSEC11", "C22_ACTOCC1564_STAT_GSEC12", "C22_ACTOCC1564_STAT_GSEC13",
    "C22_ACTOCC1564_STAT_GSEC14", "C22_ACTOCC1564_STAT_GSEC15", "C22_ACTOCC1564_STAT_GSEC16",
    "C22_EMPLT_AGRI", "C22_EMPLT_INDUS", "C22_EMPLT_CONST", "C22_EMPLT_CTS", "C22_EMPLT_APESAS",
    "P22_ACTOCC15P_VOITURE", "P22_ACTOCC15P_COMMUN",
    "P22_LOG", "P22_RP", "P22_LOGVAC", "P22_RSECOCC", "P22_MAISON", "P22_APPART", "P22_RP_PROP", "P22_RP_LOC", "P22_RP_LOCHLMV", "P22_RP_VOIT1P",
    "C22_MEN", "C22_MENPSEUL", "C22_MENCOUPSENF", "C22_MENCOUPAENF", "C22_MENFAMMONO", "P22_POP15P_MARIEE", "P22_POP15P_CELIBATAIRE",
    "NBMENFISC21", "MED21", "PIMP21", "TP6021", "D121", "D921", "RD21", "PACT21", "PPEN21", "PPSOC21",
    "SNEMM_23",
    "NAISD17", "DECESD17", "NAISD22", "DECESD22",
    "ETTOT24", "ETPOQ24", "ETPPRESPUB24", "ETPNPRESPUB24",
]
CENSUS_SERVICE_PREFIX = "BPE_"
CENSUS_FORMER_COLS = [
    "P16_POP", "P16_POP0014", "P16_POP1529", "P16_POP3044", "P16_POP4559", "P16_POP6074", "P16_POP7589", "P16_POP90P",
    "P16_NSCOL15P", "P16_NSCOL15P_DIPLMIN", "P16_NSCOL15P_CAPBEP", "P16_NSCOL15P_BAC", "P16_NSCOL15P_SUP",
    "P16_POP1564", "P16_ACT1564", "P16_ACTOCC1564", "P16_CHOM1564", "P16_INACT1564", "P16_RETR1564", "P16_ETUD1564", "P16_EMPLT",
    "C16_ACTOCC1564_CS1", "C16_ACTOCC1564_CS2", "C16_ACTOCC1564_CS3", "C16_ACTOCC1564_CS4", "C16_ACTOCC1564_CS5", "C16_ACTOCC1564_CS6",
    "C16_EMPLT_AGRI", "C16_EMPLT_INDUS", "C16_EMPLT_CONST", "C16_EMPLT_CTS", "C16_EMPLT_APESAS",
    "P16_ACTOCC15P_VOITURE", "P16_ACTOCC15P_COMMUN",
    "P16_LOG", "P16_RP", "P16_LOGVAC", "P16_RSECOCC", "P16_MAISON", "P16_APPART", "P16_RP_PROP", "P16_RP_LOC", "P16_RP_LOCHLMV", "P16_RP_VOIT1P",
    "C16_MEN", "C16_MENPSEUL", "C16_MENCOUPSENF", "C16_MENCOUPAENF", "C16_MENFAMMONO", "P16_POP15P_MARIEE", "P16_POP15P_NONMARIEE",
]
CRIME_COLS = ["CODGEO_2025", "annee", "indicateur", "nombre", "taux_pour_mille", "est_diffuse"]
CRIME_SOURCE_YEARS = [2016, 2017, 2021, 2022]

# --- fixed values: types of the exported indicators (the others are DECIMAL(6,2))
INDICATOR_TYPES = {
    "densite_associative": "DECIMAL(8,2)", "solde_naturel": "DECIMAL(8,2)",
    "crim_violences": "DECIMAL(8,4)", "crim_atteintes_biens": "DECIMAL(8,4)", "crim_stupefiants": "DECIMAL(8,4)",
    "revenu_median": "DECIMAL(10,2)", "d1_revenu": "DECIMAL(10,2)", "d9_revenu": "DECIMAL(10,2)",
}
