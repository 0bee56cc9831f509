"""Drinking-water domain: column contract, classification rules, codes, suites.

Everything domain-specific lives here as data; the layer functions in
``strata.plans.layers`` read it through a ``Domain`` value.
"""

from __future__ import annotations

from dataclasses import dataclass

from strata.operators.quality import Suite, between, in_set, matches, not_null

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results).
#
# Parameter categories: ordered (first match wins), applied to the lower-cased
# parameter label; "." stands for one accented character. Default: chimie.
# ---------------------------------------------------------------------------
CATEGORY_RULES: tuple[tuple[str, str], ...] = (
    (
        "microbiologie",
        r"bact|coli|entero|ent.rocoques|coliforme|streptoc|l.gionel"
        r"|pseudo|campylo|crypto|giardia|virus|phage",
    ),
    (
        "radioactivite",
        r"activit.|tritium|dose total|radioactiv|alpha global|beta global|uranium",
    ),
    (
        "organoleptique",
        r"temp.rature|aspect|saveur|couleur|coloration|odeur"
        r"|turbidit.|opacit.|duret.",
    ),
)
DEFAULT_CATEGORY = "chimie"
CATEGORIES = ("microbiologie", "radioactivite", "organoleptique", "chimie")
# Conformity codes: C conforming, N non-conforming, D derogation, S (other);
# only N is penalised.
CONFORMITY_CODES = ("C", "N", "D", "S")
FAILING_CODE = "N"
SOURCE_LABEL = "data.gouv.fr/controle-sanitaire-eau"
#
# Raw fact columns (landed API records).
ENTITY = "code_prelevement"
PARAMETER_CODE = "code_parametre"
AREA = "code_commune"
RAW_DATE = "date_prelevement"
LABEL = "libelle_parametre"
RAW_RESULT = "resultat_numerique"
UNIT = "unite_mesure"
RAW_LIMIT = "limite_qualite_parametre"
RAW_REFERENCE = "reference_qualite_parametre"
BACT_CODE = "conformite_limites_bact_prelevement"
PC_CODE = "conformite_limites_pc_prelevement"
BACT_REFERENCE_CODE = "conformite_references_bact_prelevement"
PC_REFERENCE_CODE = "conformite_references_pc_prelevement"
CONFORMITY_COLUMNS = (BACT_CODE, PC_CODE, BACT_REFERENCE_CODE, PC_REFERENCE_CODE)
MERGE_KEYS = (ENTITY, PARAMETER_CODE)

# Silver contract (24 columns, in order).
SILVER_COLUMNS = (
    "code_prelevement",
    "code_commune",
    "libelle_commune",
    "code_departement",
    "libelle_departement",
    "code_region",
    "libelle_region",
    "date_prelevement",
    "annee_prelevement",
    "libelle_parametre",
    "categorie_parametre",
    "resultat_numerique",
    "unite_mesure",
    "limite_qualite",
    "reference_qualite",
    "depasse_limite_qualite",
    "depasse_reference_qualite",
    "conformite_bact_limites",
    "est_conforme_bact_limites",
    "conformite_pc_limites",
    "est_conforme_pc_limites",
    "est_conforme_global",
    "_ingested_at",
    "_source",
)
BRONZE_PARTITIONS = ("annee_prelevement",)
SILVER_PARTITIONS = ("annee_prelevement", "code_departement")

# Expectation suites. The strict silver suite is the one as shipped (T13: its
# département pattern rejects Corsica's 2A/2B and a left-joined column cannot be
# fully non-null); SILVER_SUITE below is the one the gate runs.
SILVER_SUITE_STRICT = Suite(
    "silver_controles_sanitaires_strict",
    (
        not_null("code_commune"),
        not_null("date_prelevement"),
        not_null("libelle_parametre"),
        not_null("est_conforme_global"),
        not_null("code_departement"),
        in_set("categorie_parametre", CATEGORIES),
        in_set("conformite_bact_limites", CONFORMITY_CODES + (None,)),
        in_set("conformite_pc_limites", CONFORMITY_CODES + (None,)),
        between("resultat_numerique", min_value=0, mostly=0.95),
        matches("code_commune", r"^\d{5}$", mostly=0.90),
        matches("code_departement", r"^\d{2,3}$"),
    ),
)
GOLD_AREA_SUITE = Suite(
    "gold_conformite_par_commune",
    (
        not_null("taux_global_pct"),
        between("taux_global_pct", min_value=0, max_value=100),
        between("taux_bact_pct", min_value=0, max_value=100),
        between("taux_pc_pct", min_value=0, max_value=100),
        between("nb_prelevements", min_value=1),
    ),
)
# ---------------------------------------------------------------------------

# The suite the domain gate runs: NULL verdicts are legal, coverage is a share.
SILVER_SUITE = Suite(
    "silver_controles_sanitaires",
    (
        not_null("code_commune"),
        not_null("date_prelevement"),
        not_null("libelle_parametre"),
        not_null("code_departement", mostly=0.95),
        in_set("categorie_parametre", CATEGORIES),
        in_set("conformite_bact_limites", CONFORMITY_CODES + (None,)),
        in_set("conformite_pc_limites", CONFORMITY_CODES + (None,)),
        between("resultat_numerique", min_value=0, mostly=0.95),
        matches("code_commune", r"^(\d{5}|2[AB]\d{3})$", mostly=0.90),
        matches("code_departement", r"^(\d{2,3}|2[AB])$"),
    ),
)


@dataclass(frozen=True)
class Domain:
    """What the layers need to know about a domain."""

    source_label: str = SOURCE_LABEL
    category_rules: tuple[tuple[str, str], ...] = CATEGORY_RULES
    default_category: str = DEFAULT_CATEGORY
    categories: tuple[str, ...] = CATEGORIES
    failing_code: str = FAILING_CODE
    silver_suite: Suite = SILVER_SUITE
    gold_suite: Suite = GOLD_AREA_SUITE


WATER = Domain()
