"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator group of the survey, bound to the driver's test tables
(``strata.plans.bindings``). Every query reads whole tables.

Queries that land files (pages, CSV, partitioned tables, keyed tables,
stream checkpoints) write under a fresh directory below the session's shared
checkpoint root and return a DataFrame over what they read back.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import extract_number, month_of, parse_date, to_double, year_of
from strata.functions.classify import classify
from strata.functions.flags import conforming, globally_conforming
from strata.operators.aggregates import rollup_of_counts
from strata.operators.dedupe import dedupe_by_key, upsert
from strata.operators.filters import drop_null_keys
from strata.operators.joins import fanout_left, join_coverage
from strata.operators.profile import (
    distinct_rows,
    null_profile,
    top_counts,
    value_distribution,
    value_distributions,
)
from strata.operators.quality import evaluate_all, expect_or_drop, violation_counts
from strata.plans import bindings as B
from strata.plans import layers as L
from strata.plans import serving as V
from strata.plans import water as W
from strata.plans.runner import (
    GATED,
    LayerConfig,
    RunResult,
    facts_table,
    ingest_facts,
    refresh_medallion,
    run_medallion,
)
from strata.session import scratch_dir, settings
from strata.sources.csv import read_csv_dimension, write_csv
from strata.sources.keyed import KeyedTable
from strata.sources.pages import DAY_COLUMN, chain_problems, read_links, read_pages, verify_chain, write_pages
from strata.sources.sinks import (
    LEAN,
    bucket_count,
    discard,
    materialize,
    materialize_buckets,
    read_stored,
    replace_load,
    write_table,
)
from strata.sources.tables import schema_inventory
from strata.sources.tolerant import accept_csv
from strata.streaming.upsert import stream_upsert

Query = Callable[[SparkSession, str], DataFrame]

# Fixed parameters of the serving / top-k / split queries.
SERVE_AREA = {"annee": 1997, "code_departement": "07"}
SERVE_REGION = {"annee": [1997, 1998], "code_region": "02"}
SERVE_EVOLUTION = {"annee": 1999, "categorie": "microbiologie"}
UPSERT_SPLIT_TS = "2024-01-16 00:00:00"
PAGE_SIZE = 500
PAGES_SINCE = dt.date(2024, 1, 10)
CHAIN_PAGE_SIZE, LOST_DAY, REPEATED_DAY = 10, "2024-01-12", "2024-01-20"
# Two deliveries of facts: all up to the second date, then all from the first
# on; where they overlap the first delivery's results are provisional.
SECOND_DELIVERY_FROM = "1998-01-01"
FIRST_DELIVERY_UNTIL = "1999-01-01"
LINES_PER_SAMPLE, SAMPLES_PER_PAGE, PAGES_PER_LOT = 256, 128, 32
RUN_VERSION = (W.RAW_REFERENCE, W.RAW_RESULT)
EVENT_KEYS = ("user_id", "event_type")
EVENT_VERSION = ("ts", "event_id")
# "nom_commune" is a column of the domain that the bound facts lack
NULL_PROFILE_COLUMNS = (
    *W.CONFORMITY_COLUMNS,
    W.AREA,
    "nom_commune",
    W.RAW_DATE,
    W.LABEL,
    W.RAW_LIMIT,
    W.RAW_REFERENCE,
)


# ------------------------------------------------------------- helpers ----


def bronze_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.bronze(B.raw_facts(spark, sf_dir), B.BINDING)


def bound_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.silver(bronze_of(spark, sf_dir), B.geography(spark, sf_dir), B.BINDING)


def bound_codes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, L.Geography]:
    """Silver without labels, and the dimensions to label aggregates of it."""
    dims = B.geography(spark, sf_dir).deduplicated()
    return L.silver_codes(bronze_of(spark, sf_dir), dims, B.BINDING), dims


def _without_ingest_time(df: DataFrame) -> DataFrame:
    return df.drop("_ingested_at")


def dated_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample dates as delivered (see ``bindings.delivered_date``), and text
    that is no date at all for some urgent samples."""
    text = F.when(
        (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O"), F.lit("non renseignee")
    ).otherwise(B.delivered_date())
    o = B.table(spark, sf_dir, "orders")
    return o.select(B.sample_code("o_orderkey").alias("code_prelevement"), text.alias("date_brute"))


# ------------------------------------------------------------- columns ----


def bronze_metadata(spark, sf_dir):
    """bronze = raw records + lineage + partition year."""
    return _without_ingest_time(bronze_of(spark, sf_dir))


def date_parts(spark, sf_dir):
    """Tolerant date parsing, year/month, rows without a date dropped."""
    parsed = dated_samples(spark, sf_dir).withColumn("date_prelevement", parse_date("date_brute"))
    kept = drop_null_keys(parsed, ["code_prelevement", "date_prelevement"])
    return kept.select(
        "code_prelevement",
        "date_brute",
        "date_prelevement",
        year_of("date_prelevement").alias("annee_prelevement"),
        month_of("date_prelevement").alias("mois_prelevement"),
    )


def extract_threshold(spark, sf_dir):
    """Thresholds out of text ("17,5 mg/L" -> 17.5), tolerant casts."""
    part = B.table(spark, sf_dir, "part")
    limit_text = F.when(part.p_size > 40, F.lit(None).cast("string")).otherwise(
        F.concat(part.p_size.cast("string"), F.lit(",5 mg/L"))
    )
    return part.select(
        "p_partkey",
        limit_text.alias("limite_qualite_parametre"),
        extract_number(limit_text).alias("limite_qualite"),
        to_double(part.p_size.cast("string")).alias("taille_num"),
        to_double("p_name").alias("nom_num"),
    )


def extract_props(spark, sf_dir):
    """P7 on event payloads: first number of ``{"k": n}``."""
    ev = B.table(spark, sf_dir, "events")
    return ev.select("event_id", "props", extract_number("props").alias("k"))


def classify_labels(spark, sf_dir):
    """Ordered first-match classification (binding rules and the
    domain's own rules), counted per class."""
    part = B.table(spark, sf_dir, "part")
    return (
        part.select(
            classify("p_name", B.BINDING_CATEGORY_RULES, W.DEFAULT_CATEGORY).alias("categorie_parametre"),
            classify("p_name", W.CATEGORY_RULES, W.DEFAULT_CATEGORY).alias("categorie_eau"),
        )
        .groupBy("categorie_parametre", "categorie_eau")
        .agg(F.count(F.lit(1)).alias("nb"))
    )


def exceedance_flags(spark, sf_dir):
    """NULL-propagating exceedance flags, counted per flag pair."""
    typed = L.typed_facts(bronze_of(spark, sf_dir), B.BINDING)
    return typed.groupBy("depasse_limite_qualite", "depasse_reference_qualite").agg(
        F.count(F.lit(1)).alias("nb")
    )


def conformity_flags(spark, sf_dir):
    """Three-valued conformity per sample, for the limit codes and
    the reference codes."""
    smp = B.samples(spark, sf_dir)
    return smp.select(
        "code_prelevement",
        F.col(W.BACT_CODE).alias("conformite_bact_limites"),
        F.col(W.PC_CODE).alias("conformite_pc_limites"),
        conforming(W.BACT_CODE).alias("est_conforme_bact_limites"),
        conforming(W.PC_CODE).alias("est_conforme_pc_limites"),
        globally_conforming([W.BACT_CODE, W.PC_CODE]).alias("est_conforme_global"),
        F.col(W.BACT_REFERENCE_CODE).alias("conformite_bact_references"),
        F.col(W.PC_REFERENCE_CODE).alias("conformite_pc_references"),
        conforming(W.BACT_REFERENCE_CODE).alias("est_conforme_bact_references"),
        conforming(W.PC_REFERENCE_CODE).alias("est_conforme_pc_references"),
        globally_conforming([W.BACT_REFERENCE_CODE, W.PC_REFERENCE_CODE]).alias("est_conforme_references"),
    )


# ----------------------------------------------------------------- joins ----


def silver_enriched(spark, sf_dir):
    """The silver layer (24-column contract)."""
    return _without_ingest_time(bound_silver(spark, sf_dir))


def bucketed_silver(spark, sf_dir):
    """J1-J3 with facts and communes stored in buckets of the commune code: the
    silver layer without an exchange of the facts at the join."""
    path = scratch_dir(spark, "bucketed")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = L.bucketed_silver(
        bronze_of(spark, sf_dir), B.geography(spark, sf_dir), path, f"b_{path[-12:]}", buckets, domain=B.BINDING
    )
    return _without_ingest_time(out)


def _networks(spark, sf_dir) -> DataFrame:
    """Bridge sample -> network: the distinct suppliers of an order's lines."""
    links = (
        B.table(spark, sf_dir, "lineitem")
        .select("l_orderkey", F.col("l_suppkey").alias("code_reseau"))
        .distinct()
    )
    supplier = B.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("code_reseau"), F.col("s_name").alias("nom_reseau")
    )
    bridge = links.join(supplier, "code_reseau", "left")
    return bridge.select(B.sample_code("l_orderkey").alias("code_prelevement"), "code_reseau", "nom_reseau")


def bridge_fanout(spark, sf_dir):
    """Samples x sample->network bridge; bounded fan-out, every sample kept."""
    smp = B.samples(spark, sf_dir).select(
        "code_prelevement",
        "code_commune",
        globally_conforming([W.BACT_CODE, W.PC_CODE]).alias("est_conforme_global"),
    )
    return fanout_left(smp, _networks(spark, sf_dir), "code_prelevement")


def bridge_area(spark, sf_dir):
    """J4 at fact grain on the area code: facts x the networks of their area,
    one of its département and one of its kind; facts without a known area are
    kept."""
    facts = B.raw_facts(spark, sf_dir).select("code_prelevement", "code_parametre", W.AREA, W.RAW_RESULT)
    area, customer = B.area_code("c_custkey").alias(W.AREA), B.table(spark, sf_dir, "customer")
    by_department = customer.select(
        area,
        F.concat(F.lit("D"), B.padded("c_nationkey", 2)).alias("code_reseau"),
        F.col("c_name").alias("nom_reseau"),
    )
    by_kind = customer.select(
        area, F.concat(F.lit("K"), F.substring("c_mktsegment", 1, 2)).alias("code_reseau"), F.col("c_mktsegment").alias("nom_reseau")
    )
    return fanout_left(facts, by_department.unionByName(by_kind), W.AREA)


def dedupe_dimension(spark, sf_dir):
    """One commune row per code; the raw dimension repeats keys, some
    without parents or without a label."""
    return B.geography(spark, sf_dir).deduplicated().communes


def join_coverage_query(spark, sf_dir):
    """How many facts find their commune."""
    raw = B.raw_facts(spark, sf_dir)
    communes = B.geography(spark, sf_dir).communes
    cov = join_coverage(raw, communes, W.AREA, "com")
    return cov.select(
        F.col("total"), F.col("matched").alias("avec_cog"), F.col("pct_matched").alias("pct_match_cog")
    )


# ---------------------------------------------------------------- gold ----


def gold_area_rates(spark, sf_dir):
    return L.gold_area_rates(*bound_codes(spark, sf_dir))


def gold_parameter_evolution(spark, sf_dir):
    return L.gold_parameter_evolution(*bound_codes(spark, sf_dir))


def gold_region_quality(spark, sf_dir):
    return L.gold_region_quality(*bound_codes(spark, sf_dir))


def gold_nonconformity(spark, sf_dir):
    return L.gold_nonconformity(*bound_codes(spark, sf_dir))


def _merged(spark, sf_dir, build) -> DataFrame:
    """A gold table from the stored bit-map partials; silver is stored for the
    numbering and the partials, with the columns that they read."""
    codes, dims = bound_codes(spark, sf_dir)
    verdicts = ("est_conforme_bact_limites", "est_conforme_pc_limites", "est_conforme_global")
    codes = materialize(codes.select(W.ENTITY, *L.PARTIAL_KEYS, *verdicts), "codes")
    partials = materialize(L.gold_partials(codes), "partials", L.GOLD_PARTITIONS)
    return build(partials, dims)


def merged_area_rates(spark, sf_dir):
    """A3: G1 from mergeable exact distinct counts."""
    return _merged(spark, sf_dir, L.merged_area_rates)


def merged_region_quality(spark, sf_dir):
    """A3: G3 from the same pre-aggregate."""
    return _merged(spark, sf_dir, L.merged_region_quality)


def merged_nonconformity(spark, sf_dir):
    """A3: G4 from the same pre-aggregate."""
    return _merged(spark, sf_dir, L.merged_nonconformity)


def nested_aggregate(spark, sf_dir):
    """MIN / SUM / count of per-(commune, year) sample counts."""
    codes, _ = bound_codes(spark, sf_dir)
    return rollup_of_counts(codes, ["code_commune", "annee_prelevement"], W.ENTITY, "nb")


def distinct_categories(spark, sf_dir):
    """Distinct (parameter, category) pairs."""
    codes, _ = bound_codes(spark, sf_dir)
    return distinct_rows(codes, ["libelle_parametre", "categorie_parametre"])


# ------------------------------------------------------------- serving ----


def stored_gold(gold: DataFrame, name: str) -> DataFrame:
    """A gold table as the run leaves it: written, partitioned by year."""
    return materialize(gold, name, L.GOLD_PARTITIONS)


def serve_area(spark, sf_dir):
    return V.conformite_communes(stored_gold(gold_area_rates(spark, sf_dir), "gold-area"), **SERVE_AREA)


def serve_region(spark, sf_dir):
    return V.qualite_departements(stored_gold(gold_region_quality(spark, sf_dir), "gold-region"), **SERVE_REGION)


def serve_evolution(spark, sf_dir):
    gold = stored_gold(gold_parameter_evolution(spark, sf_dir), "gold-evolution")
    return V.evolution_parametres(gold, **SERVE_EVOLUTION)


def serve_nonconformity(spark, sf_dir):
    return V.non_conformites(stored_gold(gold_nonconformity(spark, sf_dir), "gold-nonconformity"))


def top_lowest_rates(spark, sf_dir):
    """O2: the 10 commune-years with the lowest global conformity."""
    g = gold_area_rates(spark, sf_dir).select(
        "code_commune",
        "libelle_commune",
        "code_departement",
        "annee_prelevement",
        "nb_prelevements",
        "taux_bact_pct",
        "taux_pc_pct",
        "taux_global_pct",
    )
    return V.top_k(g, 10, [F.col("taux_global_pct").asc_nulls_last()], ["code_commune", "annee_prelevement"])


def top_worst_departments(spark, sf_dir):
    """O2: the 15 département-years with the highest non-conformity rate."""
    g = gold_nonconformity(spark, sf_dir)
    return V.top_k(
        g, 15, [F.col("taux_non_conformite_pct").desc_nulls_last()], ["annee_prelevement", "code_departement"]
    )


# ----------------------------------------------------------- profiling ----


def value_distribution_query(spark, sf_dir):
    """Share of each event type."""
    return value_distribution(B.table(spark, sf_dir, "events"), "event_type")


def code_distribution(spark, sf_dir):
    """X1 on the four conformity codes in one scan (NULL is its own value)."""
    return value_distributions(B.raw_facts(spark, sf_dir), W.CONFORMITY_COLUMNS)


def null_profile_query(spark, sf_dir):
    """Null rate of the key raw columns that exist, from a single scan."""
    return null_profile(B.raw_facts(spark, sf_dir), NULL_PROFILE_COLUMNS)


def top_nonconforming(spark, sf_dir):
    """Most frequent parameters in non-conforming samples."""
    raw = B.raw_facts(spark, sf_dir).select(
        W.LABEL, F.col(W.BACT_CODE).alias("bact"), F.col(W.PC_CODE).alias("pc")
    )
    return top_counts(
        raw, [W.LABEL, "bact", "pc"], 20, where=(F.col("bact") == "N") | (F.col("pc") == "N")
    )


# ------------------------------------------------------------- quality ----


def expect_or_drop_query(spark, sf_dir):
    """F2/Q1: rows kept by the drop rules (violators counted on the side)."""
    parsed = dated_samples(spark, sf_dir).withColumn("date_prelevement", parse_date("date_brute"))
    kept = expect_or_drop(parsed, _drop_rules())
    return kept.select("code_prelevement", "date_prelevement")


def _drop_rules():
    return {
        "code non nul": F.col("code_prelevement").isNotNull(),
        "date valide": F.col("date_prelevement").isNotNull(),
    }


def drop_report(spark, sf_dir):
    """F2/Q1: violators per drop rule, as rows."""
    parsed = dated_samples(spark, sf_dir).withColumn("date_prelevement", parse_date("date_brute"))
    return violation_counts(parsed, _drop_rules())


def expectation_report(spark, sf_dir):
    """Q2-Q6: silver suites and the gold suite on stored silver and the gold
    table built from it, one pass per table (all silver suites share one
    aggregate)."""
    silver_df = materialize(_without_ingest_time(bound_silver(spark, sf_dir)), "silver")
    gold = L.gold_area_rates(silver_df)
    return evaluate_all(
        [
            (silver_df, B.BINDING.silver_suite),
            (silver_df, W.SILVER_SUITE_STRICT),
            (gold, W.GOLD_AREA_SUITE),
        ]
    )


def layer_invariants(spark, sf_dir):
    """Q9: relational invariants between silver and gold, as rows
    (invariant, value, ok). Silver feeds four aggregates here, so it is
    materialised once (parquet in the shared checkpoint folder) and each
    invariant reads back only the columns it needs."""
    needed = sorted(
        set(L.AREA_KEYS)
        | set(L.NONCONFORMITY_KEYS)
        | {W.ENTITY, "est_conforme_bact_limites", "est_conforme_pc_limites", "est_conforme_global"}
    )
    # only the columns the invariants read are computed and written
    silver_df = materialize(bound_silver(spark, sf_dir).select(*needed))
    g1 = L.gold_area_rates(silver_df)
    g4 = L.gold_nonconformity(silver_df)
    join_rate = silver_df.agg(
        F.round(F.lit(100.0) * F.count("code_departement") / F.count(F.lit(1)), 1).alias("valeur")
    ).select(F.lit("taux_jointure_departement_pct").alias("invariant"), "valeur", (F.col("valeur") > 95).alias("ok"))
    out_of_range = g1.agg(
        F.count_if(
            (F.col("taux_bact_pct") < 0) | (F.col("taux_bact_pct") > 100)
            | (F.col("taux_pc_pct") < 0) | (F.col("taux_pc_pct") > 100)
            | (F.col("taux_global_pct") < 0) | (F.col("taux_global_pct") > 100)
        ).cast("double").alias("valeur")
    ).select(F.lit("taux_hors_plage").alias("invariant"), "valeur", (F.col("valeur") == 0).alias("ok"))
    silver_rows = silver_df.select(F.count(F.lit(1))).scalar()
    dedup = g1.agg(F.sum("nb_prelevements").cast("double").alias("valeur")).select(
        F.lit("somme_prelevements_gold").alias("invariant"), "valeur", (F.col("valeur") < silver_rows).alias("ok")
    )
    expected = F.round(F.lit(100.0) * F.col("nb_non_conformes_global") / F.col("nb_prelevements"), 2)
    incoherent = g4.agg(
        F.count_if(F.abs(F.col("taux_non_conformite_pct") - expected) > 0.01).cast("double").alias("valeur")
    ).select(F.lit("taux_incoherents").alias("invariant"), "valeur", (F.col("valeur") == 0).alias("ok"))
    return join_rate.unionByName(out_of_range).unionByName(dedup).unionByName(incoherent)


# -------------------------------------------------------------- upserts ----


def upsert_latest(spark, sf_dir):
    """K1: merge a later batch of events into an earlier one by
    (user_id, event_type); the latest (ts, event_id) wins."""
    ev = B.table(spark, sf_dir, "events")
    split = F.col("ts") < F.lit(UPSERT_SPLIT_TS).cast("timestamp_ntz")
    return upsert(ev.filter(split), ev.filter(~split), EVENT_KEYS, EVENT_VERSION)


def stream_upsert_query(spark, sf_dir):
    """Events landed as several files, the late half of the month before
    the early one, drained by a streaming query in micro-batches; each batch's
    changed keys are merged into a table partitioned by day. Late rows of the
    later files must not roll a key back."""
    ev = B.table(spark, sf_dir, "events")
    work = scratch_dir(spark, "stream-upsert")
    landing = f"{work}/landing"
    split = F.col("ts") < F.lit(UPSERT_SPLIT_TS).cast("timestamp_ntz")
    ev.filter(~split).repartitionByRange(4, "event_id").write.parquet(landing)
    ev.filter(split).repartitionByRange(4, "event_id").write.mode("append").parquet(landing)
    day = F.date_format("ts", "yyyy-MM-dd")
    table = KeyedTable(spark, f"{work}/table", ev.schema, EVENT_KEYS, "jour", day)
    q = stream_upsert(
        spark, landing, table, EVENT_VERSION, f"{work}/checkpoint", exclusive=True, max_files_per_trigger=3
    )
    q.awaitTermination()
    return table.read()


# ------------------------------------------------------ sources / sinks ----


def paged_json_source(spark, sf_dir):
    """Events landed as API page envelopes, read back in parallel from
    the directories of the days asked for."""
    ev = B.table(spark, sf_dir, "events")
    path = scratch_dir(spark, "pages")
    write_pages(ev, path, PAGE_SIZE, "event_id", F.col("ts"))
    return read_pages(spark, path, ev.schema, since=PAGES_SINCE)


def page_chain(spark, sf_dir):
    """The chain of a delivery of events that lost one day's pages on the
    way and got another day's twice: gaps and repeated pages."""
    path, damaged = scratch_dir(spark, "pages"), scratch_dir(spark, "damaged-pages")
    write_pages(B.table(spark, sf_dir, "events"), path, CHAIN_PAGE_SIZE, "event_id", F.col("ts"))
    landed = spark.read.text(path)
    day = F.col(DAY_COLUMN).cast("string")
    arrived = landed.where(day.isNull() | (day != LOST_DAY)).unionByName(landed.where(day == REPEATED_DAY))
    arrived.write.partitionBy(DAY_COLUMN).text(damaged)
    return chain_problems(read_links(spark, damaged))


def csv_dimension(spark, sf_dir):
    """A dimension published as CSV with upper-case headers, read back as
    all-string columns with lower-case names."""
    cust = B.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    path = scratch_dir(spark, "csv")
    write_csv(cust, path, upper_headers=True)
    return read_csv_dimension(spark, path)


CUSTOMER_COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


def _broken_dimension(spark, sf_dir):
    """Customers as CSV lines; those of the lowest balances are cut off before
    their last field, those of the highest have one field too many."""
    customer = B.table(spark, sf_dir, "customer")
    whole = F.concat_ws(",", *[F.col(c).cast("string") for c in CUSTOMER_COLUMNS])
    short = F.concat_ws(",", *[F.col(c).cast("string") for c in CUSTOMER_COLUMNS[:-1]])
    balance = F.col("c_acctbal")
    line = F.when(balance < -800, short).when(balance > 9800, F.concat(whole, F.lit(",?"))).otherwise(whole)
    path, stored = scratch_dir(spark, "broken-csv"), scratch_dir(spark, "accepted-csv")
    customer.select(line.alias("value")).write.text(path)
    return accept_csv(spark, path, stored, CUSTOMER_COLUMNS, header=False)


def accepted_dimension(spark, sf_dir):
    """The rows of a dimension with broken lines that fit."""
    return _broken_dimension(spark, sf_dir).rows


def rejected_lines(spark, sf_dir):
    """The lines of the same dimension that were set apart."""
    return _broken_dimension(spark, sf_dir).rejects.select("ligne")


def schema_inventory_query(spark, sf_dir):
    """Rows and columns per table, as the files have them."""
    return schema_inventory({t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in B.TABLES})


def partitioned_write(spark, sf_dir):
    """Silver written partitioned by (year, département) and read back."""
    silver_df = _without_ingest_time(bound_silver(spark, sf_dir))
    path = scratch_dir(spark, "silver")
    write_table(silver_df, path, W.SILVER_PARTITIONS)
    return read_stored(silver_df, path)


def replaced_dimension(spark, sf_dir):
    """K2: a dimension loaded raw, then replaced by its cleaned version."""
    path = scratch_dir(spark, "communes")
    geography = B.geography(spark, sf_dir)
    replace_load(geography.communes, path)
    clean = geography.deduplicated().communes
    replace_load(clean, path)
    return read_stored(clean, path)


# ------------------------------------------------------------------ run ----


def _deliveries(spark, sf_dir) -> list[DataFrame]:
    """Two overlapping deliveries of facts, landed as pages and read back."""
    raw = B.raw_facts(spark, sf_dir)
    by_line = Window.partitionBy(B.LOT, "o_orderkey").orderBy(W.PARAMETER_CODE, *RUN_VERSION)
    # however many lines a sample has, its page is that of its key, so that no page lies in two lots
    line = F.least(F.row_number().over(by_line), F.lit(LINES_PER_SAMPLE)) - 1
    placed = B.in_lots(bucket_count(spark), PAGES_PER_LOT * SAMPLES_PER_PAGE)
    facts = B.raw_facts(spark, sf_dir, ("o_orderkey", "o_orderdate", B.LOT), placed)
    numbered = facts.withColumn("numero", F.col("o_orderkey") * LINES_PER_SAMPLE + line)
    # read six times below; both deliveries are grouped into pages as they are stored
    with settings(spark, LEAN | B.CO_PARTITIONED):
        numbered = materialize_buckets(numbered.drop("o_orderkey"), B.LOT, "numbered", placed=True)
    overlap = F.col("o_orderdate") >= F.lit(SECOND_DELIVERY_FROM).cast("timestamp_ntz")
    first = numbered.where(F.col("o_orderdate") < F.lit(FIRST_DELIVERY_UNTIL).cast("timestamp_ntz")).withColumn(
        W.RAW_RESULT, F.when(overlap, F.lit("0")).otherwise(F.col(W.RAW_RESULT))
    )
    out = []
    for n, batch in enumerate((first, numbered.where(overlap))):
        path = scratch_dir(spark, f"delivery-{n}")
        landed = batch.select(*raw.columns, "numero", "o_orderdate", B.LOT)
        size, year = SAMPLES_PER_PAGE * LINES_PER_SAMPLE, F.trunc("o_orderdate", "year")
        with settings(spark, LEAN):
            write_pages(landed, path, size, "numero", year, compression="gzip", stored_by=B.LOT)
        verify_chain(read_links(spark, path))  # a delivery that lacks a page is refused
        out.append(read_pages(spark, path, landed.drop(B.LOT).schema).select(*raw.columns))
    discard(numbered)
    return out


def _config(spark) -> LayerConfig:
    root = scratch_dir(spark, "run")
    return LayerConfig(root=root, prefix=f"run_{root[-12:]}_")


def run_of(spark, sf_dir, *tables: str) -> RunResult:
    """A run over both deliveries into fresh storage, with a passing gate, that
    builds the gold ``tables``."""
    geography, batches = B.geography(spark, sf_dir), _deliveries(spark, sf_dir)
    return run_medallion(
        spark, batches, geography, _config(spark), B.BINDING, version_by=RUN_VERSION, tables=tables, clustered=True
    )


def medallion_facts(spark, sf_dir):
    """The landed facts after both deliveries were merged."""
    batches = _deliveries(spark, sf_dir)
    table = facts_table(spark, _config(spark), batches[0].schema)
    ingest_facts(table, batches, RUN_VERSION, clustered=True)
    return table.read()


def medallion_run(spark, sf_dir):
    """The run's stored gold table G1."""
    return run_of(spark, sf_dir).gold[GATED]


def _refreshed(spark, sf_dir, name: str) -> DataFrame:
    first, second = _deliveries(spark, sf_dir)
    geography, config = B.geography(spark, sf_dir), _config(spark)
    how = {"domain": B.BINDING, "version_by": RUN_VERSION, "tables": [name], "clustered": True}
    run_medallion(spark, [first], geography, config, **how)
    return refresh_medallion(spark, [second], geography, config, **how).gold[name]


def refreshed_area_rates(spark, sf_dir):
    """G1 after a run over the first delivery and a refresh by the second, which
    works out its years only."""
    return _refreshed(spark, sf_dir, GATED)


def refreshed_evolution(spark, sf_dir):
    """G2, refreshed likewise."""
    return _refreshed(spark, sf_dir, "evolution_temporelle_parametres")


def medallion_evolution(spark, sf_dir):
    name = "evolution_temporelle_parametres"
    return run_of(spark, sf_dir, name).gold[name]


def medallion_region(spark, sf_dir):
    name = "qualite_par_departement"
    return run_of(spark, sf_dir, name).gold[name]


def medallion_nonconformity(spark, sf_dir):
    name = "non_conformites_par_departement"
    return run_of(spark, sf_dir, name).gold[name]


def medallion_report(spark, sf_dir):
    """Q6: the run's stored expectation report."""
    return run_of(spark, sf_dir).report


def medallion_loads(spark, sf_dir):
    """K8: the run's load report, rows written per table."""
    loads = run_of(spark, sf_dir, *L.GOLD_TABLES).loads
    rows = [(name, load["rows_written"]) for name, load in sorted(loads.items())]
    return spark.createDataFrame(rows, "nom_table string, lignes_ecrites bigint")


def queries() -> dict[str, Query]:
    return {
        "bronze_metadata": bronze_metadata,
        "date_parts": date_parts,
        "extract_threshold": extract_threshold,
        "extract_props": extract_props,
        "classify_labels": classify_labels,
        "exceedance_flags": exceedance_flags,
        "conformity_flags": conformity_flags,
        "silver_enriched": silver_enriched,
        "bucketed_silver": bucketed_silver,
        "bridge_fanout": bridge_fanout,
        "bridge_area": bridge_area,
        "dedupe_dimension": dedupe_dimension,
        "join_coverage": join_coverage_query,
        "gold_area_rates": gold_area_rates,
        "gold_parameter_evolution": gold_parameter_evolution,
        "gold_region_quality": gold_region_quality,
        "gold_nonconformity": gold_nonconformity,
        "merged_area_rates": merged_area_rates,
        "merged_region_quality": merged_region_quality,
        "merged_nonconformity": merged_nonconformity,
        "nested_aggregate": nested_aggregate,
        "distinct_categories": distinct_categories,
        "serve_area": serve_area,
        "serve_region": serve_region,
        "serve_evolution": serve_evolution,
        "serve_nonconformity": serve_nonconformity,
        "top_lowest_rates": top_lowest_rates,
        "top_worst_departments": top_worst_departments,
        "value_distribution": value_distribution_query,
        "code_distribution": code_distribution,
        "null_profile": null_profile_query,
        "top_nonconforming": top_nonconforming,
        "expect_or_drop": expect_or_drop_query,
        "drop_report": drop_report,
        "expectation_report": expectation_report,
        "layer_invariants": layer_invariants,
        "upsert_latest": upsert_latest,
        "stream_upsert": stream_upsert_query,
        "paged_json_source": paged_json_source,
        "page_chain": page_chain,
        "csv_dimension": csv_dimension,
        "accepted_dimension": accepted_dimension,
        "rejected_lines": rejected_lines,
        "schema_inventory": schema_inventory_query,
        "partitioned_write": partitioned_write,
        "replaced_dimension": replaced_dimension,
        "medallion_facts": medallion_facts,
        "medallion_run": medallion_run,
        "refreshed_area_rates": refreshed_area_rates,
        "refreshed_evolution": refreshed_evolution,
        "medallion_evolution": medallion_evolution,
        "medallion_region": medallion_region,
        "medallion_nonconformity": medallion_nonconformity,
        "medallion_report": medallion_report,
        "medallion_loads": medallion_loads,
    }
