"""Bronze -> silver -> gold as plain DataFrame functions.

Column names follow the domain contract in ``strata.plans.water``; rules,
codes and suites come from a ``Domain`` value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strata.functions import (
    classify,
    conforming,
    exceeds,
    extract_number,
    globally_conforming,
    month_of,
    parse_date,
    pct,
    to_double,
    true_as_int,
    year_of,
)
from strata.operators.aggregates import entity_rates
from strata.operators.bitmaps import EVERY, bitmap_partials, merged_counts, number_entities
from strata.operators.dedupe import dedupe_by_key
from strata.operators.joins import Lookup, enrich_left
from strata.operators.quality import expect_or_drop
from strata.operators.buckets import every_salt, join_bucketed, spread, write_bucketed
from strata.plans import water as W
from strata.plans.water import WATER, Domain

# ---------------------------------------------------------------- bronze ----


def bronze(raw: DataFrame, domain: Domain = WATER, ingested_at: Column | None = None) -> DataFrame:
    """Raw records + ingestion metadata (P1, P2) + partition year."""
    return raw.withColumns(
        {
            "_ingested_at": ingested_at if ingested_at is not None else F.current_timestamp(),
            "_source": F.lit(domain.source_label),
            "annee_prelevement": year_of(parse_date(W.RAW_DATE)),
        }
    )


# ---------------------------------------------------------------- silver ----


@dataclass(frozen=True)
class Geography:
    """Area dimensions: communes(com, libelle, dep, reg), departements(dep,
    libelle), regions(reg, libelle). Keys may repeat in the raw files."""

    communes: DataFrame
    departements: DataFrame
    regions: DataFrame

    def deduplicated(self) -> Geography:
        """One row per key (T2): rows with parent codes win over those
        without, then labelled ones over unlabelled, then the smallest tuple —
        so joins never multiply facts and never lose a known label."""
        return Geography(
            communes=dedupe_by_key(
                self.communes.select("com", "libelle", "dep", "reg"),
                ["com"],
                order_by=["dep", "reg", "libelle"],
                prefer_non_null=["dep", "reg", "libelle"],
            ),
            departements=dedupe_by_key(
                self.departements.select("dep", "libelle"), ["dep"], order_by=["libelle"], prefer_non_null=["libelle"]
            ),
            regions=dedupe_by_key(
                self.regions.select("reg", "libelle"), ["reg"], order_by=["libelle"], prefer_non_null=["libelle"]
            ),
        )


def dated_facts(bronze_df: DataFrame) -> DataFrame:
    """The date alone is parsed (P3): what decides whether a fact is kept."""
    return bronze_df.withColumn("date_prelevement", parse_date(W.RAW_DATE))


def measured_facts(dated: DataFrame) -> DataFrame:
    """The numbers in the texts (P6-P8), which are smaller than those."""
    return dated.withColumns(
        {
            "limite_qualite": extract_number(W.RAW_LIMIT),
            "reference_qualite": extract_number(W.RAW_REFERENCE),
            "resultat_numerique": to_double(W.RAW_RESULT),
        }
    )


def to_move(facts: DataFrame) -> DataFrame:
    """Columns in the order in which rows compress best when they are shuffled: fixed
    width first, texts whose length varies from row to row last."""
    texts = [f.name for f in facts.schema.fields if isinstance(f.dataType, StringType)]
    fixed = [c for c in facts.columns if c not in texts]
    return facts.select(*fixed, *sorted(texts, key=("libelle_commune", W.UNIT, W.LABEL).__contains__))


def typed_facts(bronze_df: DataFrame, domain: Domain = WATER) -> DataFrame:
    """Tolerant typing, classification and row-level flags (P3-P15), all in
    one projection over the scan."""
    return judged_facts(measured_facts(dated_facts(bronze_df)), domain)


def judged_facts(measured: DataFrame, domain: Domain) -> DataFrame:
    """What follows from a fact's other columns: category, flags, year."""
    typed = measured.withColumns(
        {
            "categorie_parametre": classify(W.LABEL, domain.category_rules, domain.default_category),
            "conformite_bact_limites": F.col(W.BACT_CODE),
            "conformite_pc_limites": F.col(W.PC_CODE),
        }
    )
    return typed.withColumns(
        {
            "annee_prelevement": year_of("date_prelevement"),
            "depasse_limite_qualite": exceeds("resultat_numerique", "limite_qualite"),
            "depasse_reference_qualite": exceeds("resultat_numerique", "reference_qualite"),
            "est_conforme_bact_limites": conforming(W.BACT_CODE, domain.failing_code),
            "est_conforme_pc_limites": conforming(W.PC_CODE, domain.failing_code),
            "est_conforme_global": globally_conforming([W.BACT_CODE, W.PC_CODE], domain.failing_code),
        }
    )


def silver_drop_rules() -> dict[str, Column]:
    """Q1: rows dropped from silver (evaluated on the *parsed* date, T5)."""
    return {
        "code_commune non nul": F.col(W.AREA).isNotNull(),
        "date valide": F.col("date_prelevement").isNotNull(),
    }


# label column -> (dimension, its key, the code column it is found by)
_LABELS = {
    "libelle_commune": ("communes", "com", W.AREA),
    "libelle_departement": ("departements", "dep", "code_departement"),
    "libelle_region": ("regions", "reg", "code_region"),
}


def with_labels(df: DataFrame, dims: Geography, labels: tuple[str, ...] = tuple(_LABELS)) -> DataFrame:
    """Adds the labels of the codes in ``df`` (J1-J3) from de-duplicated
    ``dims``; unknown codes have a NULL label."""
    lookups = []
    for label in labels:
        dim, key, code = _LABELS[label]
        lookups.append(Lookup(getattr(dims, dim), code, key, {"libelle": label}))
    return enrich_left(df, lookups)


def silver_codes(
    bronze_df: DataFrame,
    dims: Geography,
    domain: Domain = WATER,
    observation: Observation | None = None,
    commune_columns: tuple[str, ...] = (),
    together: Sequence[str] = (),
) -> DataFrame:
    """Typed, flagged facts with their geography codes, without labels: what
    the aggregates group by. ``dims`` are de-duplicated. Rows without an area
    code or a valid date are dropped (counted on ``observation``). Rows are moved
    to their communes, and then rebalanced by the columns ``together``, before
    they are judged: as few and as short columns as there can be."""
    kept = expect_or_drop(dated_facts(bronze_df), silver_drop_rules(), observation)
    columns = {"dep": "code_departement", "reg": "code_region"} | {c: "libelle_commune" for c in commune_columns}
    facts = enrich_left(to_move(measured_facts(kept)), [Lookup(dims.communes, W.AREA, "com", columns)])
    if together:
        facts = facts.withColumn("annee_prelevement", year_of("date_prelevement"))
        facts = to_move(facts).hint("rebalance", *together)
    return judged_facts(facts, domain)


def silver(
    bronze_df: DataFrame,
    geography: Geography,
    domain: Domain = WATER,
    observation: Observation | None = None,
    together: Sequence[str] = (),
) -> DataFrame:
    """Typed, flagged, geography-enriched facts; 24-column contract.

    Three LEFT joins add commune, département and région codes and labels; the
    planner's size checks choose between broadcast and shuffle for each. Rows are
    rebalanced by the columns ``together`` before they are typed and labelled.
    """
    dims = geography.deduplicated()
    facts = silver_codes(bronze_df, dims, domain, observation, commune_columns=("libelle",), together=together)
    return with_labels(facts, dims, ("libelle_departement", "libelle_region")).select(*W.SILVER_COLUMNS)


def bucketed_silver(
    bronze_df: DataFrame, geography: Geography, path: str, name: str, buckets: int, salts: int = 8, domain: Domain = WATER
) -> DataFrame:
    """Silver whose facts are stored by commune (``name``_faits) and meet the
    stored communes (``name``_communes) bucket by bucket, for commune tables
    beyond broadcast size: further joins of the stored facts exchange nothing."""
    spark, dims = bronze_df.sparkSession, geography.deduplicated()
    kept = expect_or_drop(typed_facts(bronze_df, domain), silver_drop_rules())
    communes = dims.communes.select(
        F.col("com").alias(W.AREA),
        F.col("libelle").alias("libelle_commune"),
        F.col("dep").alias("code_departement"),
        F.col("reg").alias("code_region"),
    )
    write_bucketed(kept, f"{name}_faits", f"{path}/faits", W.AREA, buckets, spread(W.ENTITY, salts))
    write_bucketed(communes, f"{name}_communes", f"{path}/communes", W.AREA, buckets, every_salt(salts))
    facts = join_bucketed(spark.table(f"{name}_faits"), spark.table(f"{name}_communes"), W.AREA)
    return with_labels(facts, dims, ("libelle_departement", "libelle_region")).select(*W.SILVER_COLUMNS)


# ------------------------------------------------------------------ gold ----
#
# The aggregates group by codes, which labels depend on. With ``dims``
# (de-duplicated) the labels are joined to the few result rows; without, they
# are columns of ``silver_df`` and part of the group.

AREA_KEYS = ("code_commune", "libelle_commune", "code_departement", "libelle_departement", "annee_prelevement")
EVOLUTION_KEYS = ("annee_prelevement", "mois_prelevement", "libelle_parametre", "categorie_parametre")
REGION_KEYS = ("code_departement", "libelle_departement", "code_region", "libelle_region", "annee_prelevement")
NONCONFORMITY_KEYS = ("annee_prelevement", "code_departement", "libelle_departement")


def _labelled_rates(
    silver_df: DataFrame,
    dims: Geography | None,
    keys: tuple[str, ...],
    conditions: dict[str, Column],
    rates: dict[str, str],
) -> DataFrame:
    labels = tuple(k for k in keys if k in _LABELS)
    group = keys if dims is None else [k for k in keys if k not in labels]
    counted = entity_rates(silver_df, group, W.ENTITY, conditions, rates, total_name="nb_prelevements")
    if dims is not None:
        counted = with_labels(counted, dims, labels)
    return counted.select(*keys, "nb_prelevements", *conditions, *rates)


def gold_area_rates(silver_df: DataFrame, dims: Geography | None = None) -> DataFrame:
    """G1 conformite_par_commune: yearly sample conformity per commune."""
    return _labelled_rates(
        silver_df,
        dims,
        AREA_KEYS,
        {
            "nb_conformes_bact": F.col("est_conforme_bact_limites"),
            "nb_conformes_pc": F.col("est_conforme_pc_limites"),
            "nb_conformes_global": F.col("est_conforme_global"),
        },
        {
            "taux_bact_pct": "nb_conformes_bact",
            "taux_pc_pct": "nb_conformes_pc",
            "taux_global_pct": "nb_conformes_global",
        },
    )


def gold_parameter_evolution(silver_df: DataFrame, dims: Geography | None = None) -> DataFrame:
    """G2 evolution_temporelle_parametres: monthly measure trend per parameter.

    Measures are row-level on purpose (every analysed value counts); only the
    sample count is distinct. The unit is ``min`` — a deterministic stand-in
    for an order-dependent ``first`` (T7). The facts are read and moved once, to
    where their (group, sample) is, and sorted there: one aggregate per (group,
    sample) and a first one per group follow in place, without further state. A
    group is spread by its samples; one row a group and task moves again.
    """
    flag = F.col("depasse_limite_qualite")
    measure = F.col("resultat_numerique")
    facts = silver_df.withColumn("mois_prelevement", month_of("date_prelevement"))
    partial = (
        facts.select(*EVOLUTION_KEYS[:2], measure, flag, W.ENTITY, W.UNIT, *reversed(EVOLUTION_KEYS[2:]))
        .repartition(*EVOLUTION_KEYS, W.ENTITY)
        .groupBy(*EVOLUTION_KEYS, W.ENTITY)
        .agg(
            F.sum(measure).alias("__sum"),
            F.count(measure).alias("__n"),
            F.min(measure).alias("__min"),
            F.max(measure).alias("__max"),
            F.min(W.UNIT).alias("__unit"),
            F.count(flag).alias("__flags"),
            F.sum(true_as_int(flag)).alias("__true"),
        )
    )
    merged = partial.groupBy(*EVOLUTION_KEYS).agg(
        F.count(W.ENTITY).alias("nb_prelevements"),  # each once
        F.round(F.sum("__sum") / F.nullif(F.sum("__n"), F.lit(0)), 4).alias("moyenne"),
        F.round(F.min("__min"), 4).alias("minimum"),
        F.round(F.max("__max"), 4).alias("maximum"),
        F.min("__unit").alias("unite_mesure"),
        F.sum("__flags").alias("nb_mesures_avec_limite"),
        F.sum("__true").alias("nb_depassements_limite"),
    )
    return merged.withColumn(
        "taux_depassement_limite_pct", pct("nb_depassements_limite", "nb_mesures_avec_limite")
    )


def gold_region_quality(silver_df: DataFrame, dims: Geography | None = None) -> DataFrame:
    """G3 qualite_par_departement: global conformity per département."""
    return _labelled_rates(
        silver_df,
        dims,
        REGION_KEYS,
        {"nb_conformes": F.col("est_conforme_global")},
        {"taux_conformite_pct": "nb_conformes"},
    )


def gold_nonconformity(silver_df: DataFrame, dims: Geography | None = None) -> DataFrame:
    """G4 non_conformites_par_departement: non-conforming samples (negated
    flags; a NULL verdict counts on neither side, T1)."""
    return _labelled_rates(
        silver_df,
        dims,
        NONCONFORMITY_KEYS,
        {
            "nb_non_conformes_bact": ~F.col("est_conforme_bact_limites"),
            "nb_non_conformes_pc": ~F.col("est_conforme_pc_limites"),
            "nb_non_conformes_global": ~F.col("est_conforme_global"),
        },
        {"taux_non_conformite_pct": "nb_non_conformes_global"},
    )


# What G1, G3 and G4 count, from one stored pre-aggregate (operators.bitmaps).
PARTIAL_KEYS = ("annee_prelevement", "code_commune", "code_departement", "code_region")


def gold_partials(codes: DataFrame) -> DataFrame:
    """Bit maps of the samples of a commune and year: all, and those with a
    TRUE and a FALSE verdict of each kind (a NULL verdict is on neither side)."""
    verdicts = {
        "bact": F.col("est_conforme_bact_limites"),
        "pc": F.col("est_conforme_pc_limites"),
        "global": F.col("est_conforme_global"),
    }
    conditions = {f"conforme_{k}": v for k, v in verdicts.items()} | {f"non_conforme_{k}": ~v for k, v in verdicts.items()}
    numbers = number_entities(codes, W.ENTITY, PARTIAL_KEYS)
    return bitmap_partials(codes, PARTIAL_KEYS, W.ENTITY, numbers, conditions)


def _merged_rates(
    partials: DataFrame, dims: Geography, keys: tuple[str, ...], counts: dict[str, str], rates: dict[str, str]
) -> DataFrame:
    labels = tuple(k for k in keys if k in _LABELS)
    merged = merged_counts(partials, [k for k in keys if k not in labels], {EVERY: "nb_prelevements", **counts})
    merged = merged.withColumns({rate: pct(F.col(n), F.col("nb_prelevements")) for rate, n in rates.items()})
    return with_labels(merged, dims, labels).select(*keys, "nb_prelevements", *counts.values(), *rates)


def merged_area_rates(partials: DataFrame, dims: Geography) -> DataFrame:
    """G1 from ``gold_partials``."""
    kinds = ("bact", "pc", "global")
    return _merged_rates(
        partials,
        dims,
        AREA_KEYS,
        {f"conforme_{k}": f"nb_conformes_{k}" for k in kinds},
        {f"taux_{k}_pct": f"nb_conformes_{k}" for k in kinds},
    )


def merged_region_quality(partials: DataFrame, dims: Geography) -> DataFrame:
    """G3 from ``gold_partials``."""
    return _merged_rates(
        partials, dims, REGION_KEYS, {"conforme_global": "nb_conformes"}, {"taux_conformite_pct": "nb_conformes"}
    )


def merged_nonconformity(partials: DataFrame, dims: Geography) -> DataFrame:
    """G4 from ``gold_partials``."""
    return _merged_rates(
        partials,
        dims,
        NONCONFORMITY_KEYS,
        {f"non_conforme_{k}": f"nb_non_conformes_{k}" for k in ("bact", "pc", "global")},
        {"taux_non_conformite_pct": "nb_non_conformes_global"},
    )


GOLD_TABLES = {
    "conformite_par_commune": gold_area_rates,
    "evolution_temporelle_parametres": gold_parameter_evolution,
    "qualite_par_departement": gold_region_quality,
    "non_conformites_par_departement": gold_nonconformity,
}
GOLD_PARTITIONS = ("annee_prelevement",)


def gold_order(name: str) -> tuple[Column, ...]:
    """The order in which a gold table is stored inside its years: G4 by rate,
    the worst first."""
    if name != "non_conformites_par_departement":
        return ()
    return (F.col("taux_non_conformite_pct").desc_nulls_last(), F.col("code_departement").asc())
