"""Binding of the domain contract onto the driver's star-schema test tables.

The driver tables are normalised; the domain's raw facts arrive denormalised
(one record per analysed parameter carrying sample-level codes). This module
derives that record stream from the tables with Spark joins, so every
registered query does work that grows with the tables:

* sample (entity)        = order          ``code_prelevement`` = padded ``o_orderkey``
* analysed parameter     = line item/part ``libelle_parametre = p_name``
* area (commune)         = customer       ``code_commune`` = padded ``o_custkey``,
  missing for orders of less than ``LEAST_PRICE``
* département / région   = nation / region (through the customer)
* sample date            = ``o_orderdate`` as text: plain, as ISO date-time
  (finished orders), and for partial orders also year only, year-month, or with
  a garbage tail, which no parser may take for a date
* measure                = ``l_quantity`` as text (typed back in silver)
* limit text             = ``"<p_size>,5 mg/L"`` (decimal comma), none for the
  largest parts (``p_size > 40``)
* reference text         = ``">=<l_linenumber> et <=9"`` (a range: first number)
* limit codes            = bact N / C / D from ``o_orderstatus`` F / O / other;
  pc N / NULL / C from ``o_orderpriority`` 5-LOW / 4-NOT SPECIFIED / other
* reference codes        = bact N / S / C from the priorities 2-HIGH / 1-URGENT /
  other; pc NULL for partial orders, N for 3-MEDIUM, else C

All codes are strings with leading zeros. The dimensions repeat keys and miss
some: customers with a balance below ``LEAST_BALANCE`` are no communes; every
supplier is also listed as a commune without parents, and the customers of one
segment a second time without label and region; département and région codes
also come without a label from the region and nation tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.quality import Suite, between, in_set, matches, not_null
from strata.plans.layers import Geography
from strata.plans.water import CATEGORIES, CONFORMITY_CODES, Domain
from strata.sources.tables import read_declared

LEAST_PRICE = 15000
LOT = "lot"
#: A join may use partitions by some of its keys.
CO_PARTITIONED = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}
LEAST_BALANCE = -800
REPEATED_SEGMENT = "BUILDING"

# Binding rules for the part names of the test tables (overlapping on purpose:
# "red ring" matches the first two rules, order decides). Labels reuse the
# domain's category vocabulary so the serving enum applies unchanged.
BINDING_CATEGORY_RULES: tuple[tuple[str, str], ...] = (
    ("microbiologie", r"r.ng|hot"),
    ("radioactivite", r"plate|red"),
    ("organoleptique", r"gizmo|widget"),
)

# The domain suite with code shapes of the test tables.
BINDING_SILVER_SUITE = Suite(
    "silver_driver_tables",
    (
        not_null("code_commune"),
        not_null("date_prelevement"),
        not_null("libelle_parametre"),
        not_null("code_departement", mostly=0.95),
        in_set("categorie_parametre", CATEGORIES),
        in_set("conformite_bact_limites", CONFORMITY_CODES + (None,)),
        in_set("conformite_pc_limites", CONFORMITY_CODES + (None,)),
        between("resultat_numerique", min_value=0, mostly=0.95),
        matches("code_commune", r"^\d{8}$", mostly=0.90),
        matches("code_departement", r"^\d{2}$"),
    ),
)

BINDING = Domain(
    source_label="driver-tables",
    category_rules=BINDING_CATEGORY_RULES,
    silver_suite=BINDING_SILVER_SUITE,
)

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# Declared schemas of the driver tables; a file that drifted from them is
# rejected when it is first read.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_declared(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", SCHEMAS[name])


def padded(key: str, width: int) -> Column:
    return F.lpad(F.col(key).cast("string"), width, "0")


def sample_code(key: str) -> Column:
    return padded(key, 10)


def area_code(key: str) -> Column:
    return padded(key, 8)


def delivered_date() -> Column:
    """The sample date as an inconsistent source delivers it."""
    day = F.col("o_orderdate").cast("date").cast("string")
    partial = F.col("o_orderstatus") == "P"
    priority = F.col("o_orderpriority")
    return (
        F.when(partial & (priority == "1-URGENT"), F.substring(day, 1, 4))
        .when(partial & (priority == "4-NOT SPECIFIED"), F.substring(day, 1, 7))
        .when(partial & (priority == "3-MEDIUM"), F.concat(day, F.lit("Tmidi")))
        .when(F.col("o_orderstatus") == "F", F.concat(day, F.lit("T08:30:00Z")))
        .otherwise(day)
    )


def samples(spark: SparkSession, sf_dir: str, placed: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """One row per sample (order) with its sample-level attributes, the
    order's key, under which the line items are found, and its true date;
    ``placed`` as in ``raw_facts``."""
    o = table(spark, sf_dir, "orders")
    if placed is not None:
        o = placed(o, "o_orderkey")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.select(
        "o_orderkey",
        "o_orderdate",
        *([] if placed is None else [LOT]),
        sample_code("o_orderkey").alias("code_prelevement"),
        F.when(F.col("o_totalprice") >= LEAST_PRICE, area_code("o_custkey")).alias("code_commune"),
        delivered_date().alias("date_prelevement"),
        F.when(status == "F", "N").when(status == "O", "C").otherwise("D").alias("conformite_limites_bact_prelevement"),
        F.when(priority == "5-LOW", "N")
        .when(priority == "4-NOT SPECIFIED", F.lit(None))
        .otherwise("C")
        .alias("conformite_limites_pc_prelevement"),
        F.when(priority == "2-HIGH", "N")
        .when(priority == "1-URGENT", "S")
        .otherwise("C")
        .alias("conformite_references_bact_prelevement"),
        F.when(status == "P", F.lit(None))
        .when(priority == "3-MEDIUM", "N")
        .otherwise("C")
        .alias("conformite_references_pc_prelevement"),
    )


def in_lots(buckets: int, orders: int) -> Callable[[DataFrame, str], DataFrame]:
    """Rows with an order's key, in ``buckets`` partitions by the ``LOT`` of so many
    successive keys."""
    return lambda df, key: df.withColumn(LOT, F.floor(F.col(key) / orders)).repartition(buckets, LOT)


def raw_facts(
    spark: SparkSession,
    sf_dir: str,
    keep: tuple[str, ...] = (),
    placed: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """Landed-record shape of the domain: all measure / threshold / date
    fields as text, codes as delivered; ``keep`` names columns of the tables
    to keep besides. With ``placed`` (see ``in_lots``) lines and orders meet in
    partitions of whole lots, where ``CO_PARTITIONED`` holds, and the facts are in
    them: only columns of the tables are moved, their texts are made in place."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    # the lines meet the parts while they are narrow; by order, they are then in place for what works by order
    lines, orders = li.join(part, F.col("l_partkey") == F.col("p_partkey")), samples(spark, sf_dir, placed)
    same = F.col("l_orderkey") == F.col("o_orderkey")
    if placed is not None:
        lines = placed(lines, "l_orderkey").withColumnRenamed(LOT, "line_lot")
        same = (F.col("line_lot") == F.col(LOT)) & same
    joined = lines.join(orders, same)
    limit_text = F.when(F.col("p_size") > 40, F.lit(None).cast("string")).otherwise(
        F.concat(F.col("p_size").cast("string"), F.lit(",5 mg/L"))
    )
    return joined.select(
        "code_prelevement",
        padded("l_partkey", 8).alias("code_parametre"),
        "code_commune",
        "date_prelevement",
        F.col("p_name").alias("libelle_parametre"),
        F.col("l_quantity").cast("string").alias("resultat_numerique"),
        F.col("p_brand").alias("unite_mesure"),
        limit_text.alias("limite_qualite_parametre"),
        F.concat(F.lit(">="), F.col("l_linenumber").cast("string"), F.lit(" et <=9")).alias(
            "reference_qualite_parametre"
        ),
        "conformite_limites_bact_prelevement",
        "conformite_limites_pc_prelevement",
        "conformite_references_bact_prelevement",
        "conformite_references_pc_prelevement",
        *keep,
    )


def geography(spark: SparkSession, sf_dir: str) -> Geography:
    """communes = customers (with their nation's region), départements =
    nations, régions = regions; raw, with repeated and incomplete rows."""
    customer = table(spark, sf_dir, "customer").where(F.col("c_acctbal") >= LEAST_BALANCE)
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    none = F.lit(None).cast("string")
    listed = customer.join(
        nation.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
    ).select(
        area_code("c_custkey").alias("com"),
        F.col("c_name").alias("libelle"),
        padded("c_nationkey", 2).alias("dep"),
        padded("n_regionkey", 2).alias("reg"),
    )
    unlabelled = customer.where(F.col("c_mktsegment") == REPEATED_SEGMENT).select(
        area_code("c_custkey").alias("com"), none.alias("libelle"), padded("c_nationkey", 2).alias("dep"), none.alias("reg")
    )
    parentless = table(spark, sf_dir, "supplier").select(
        area_code("s_suppkey").alias("com"), F.col("s_name").alias("libelle"), none.alias("dep"), none.alias("reg")
    )
    departements = nation.select(padded("n_nationkey", 2).alias("dep"), F.col("n_name").alias("libelle"))
    regions = region.select(padded("r_regionkey", 2).alias("reg"), F.col("r_name").alias("libelle"))
    return Geography(
        communes=listed.unionByName(unlabelled).unionByName(parentless),
        departements=departements.unionByName(
            region.select(padded("r_regionkey", 2).alias("dep"), none.alias("libelle"))
        ),
        regions=regions.unionByName(nation.select(padded("n_regionkey", 2).alias("reg"), none.alias("libelle"))),
    )
