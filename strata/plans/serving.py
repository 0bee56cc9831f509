"""Serving queries over gold tables.

Each returns a DataFrame; filters are Column expressions on grouping keys
(no SQL text interpolation), applied to the gold table so that a table
partitioned by those keys is pruned. Callers bound what they collect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.filters import apply_filters, validate_choice, validate_code
from strata.plans.water import CATEGORIES

AREA_COLUMNS = (
    "code_commune",
    "libelle_commune",
    "code_departement",
    "libelle_departement",
    "annee_prelevement",
    "nb_prelevements",
    "taux_bact_pct",
    "taux_pc_pct",
    "taux_global_pct",
)
REGION_COLUMNS = (
    "code_departement",
    "libelle_departement",
    "code_region",
    "libelle_region",
    "annee_prelevement",
    "nb_prelevements",
    "nb_conformes",
    "taux_conformite_pct",
)
EVOLUTION_COLUMNS = (
    "annee_prelevement",
    "mois_prelevement",
    "libelle_parametre",
    "categorie_parametre",
    "nb_prelevements",
    "moyenne",
    "minimum",
    "maximum",
    "unite_mesure",
    "taux_depassement_limite_pct",
)


def conformite_communes(gold_area: DataFrame, annee=None, code_departement=None) -> DataFrame:
    """V1: commune conformity, lowest global rate first."""
    validate_code(code_departement, name="code_departement")
    df = apply_filters(gold_area, {"annee_prelevement": annee, "code_departement": code_departement})
    return df.select(*AREA_COLUMNS).orderBy(
        F.col("taux_global_pct").asc_nulls_last(), "code_commune", "annee_prelevement"
    )


def qualite_departements(gold_region: DataFrame, annee=None, code_region=None) -> DataFrame:
    """V2: département conformity, lowest rate first."""
    validate_code(code_region, name="code_region")
    df = apply_filters(gold_region, {"annee_prelevement": annee, "code_region": code_region})
    return df.select(*REGION_COLUMNS).orderBy(
        F.col("taux_conformite_pct").asc_nulls_last(), "code_departement", "annee_prelevement"
    )


def evolution_parametres(
    gold_evolution: DataFrame, annee=None, categorie=None, categories=CATEGORIES
) -> DataFrame:
    """V3: monthly parameter trend, chronological."""
    validate_choice(categorie, categories, name="categorie")
    df = apply_filters(gold_evolution, {"annee_prelevement": annee, "categorie_parametre": categorie})
    return df.select(*EVOLUTION_COLUMNS).orderBy(
        "annee_prelevement", "mois_prelevement", "libelle_parametre", "categorie_parametre"
    )


def non_conformites(gold_nonconformity: DataFrame, annee=None, code_departement=None) -> DataFrame:
    """V4: non-conformity ranking per year (O1: year asc, count desc)."""
    validate_code(code_departement, name="code_departement")
    df = apply_filters(
        gold_nonconformity, {"annee_prelevement": annee, "code_departement": code_departement}
    )
    return df.orderBy(
        F.col("annee_prelevement").asc(),
        F.col("nb_non_conformes_global").desc(),
        F.col("code_departement").asc_nulls_last(),
    )


def top_k(df: DataFrame, k: int, order_by, tie_keys) -> DataFrame:
    """O2: first ``k`` rows of a total order (metric, then keys)."""
    return df.orderBy(*order_by, *[F.col(c).asc_nulls_last() for c in tie_keys]).limit(k)
