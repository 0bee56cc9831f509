"""Deliveries with broken lines.

A strict read fails on the first broken line. Here a line that does not fit the
schema costs that line alone: one pass over the files stores the rows that fit and,
apart from them, the raw text of those that do not, and counts both for the load
report. A share of rejected lines beyond ``max_share`` fails the load, after what
was found has been stored.

Of paged JSON a line is an envelope, so a broken one loses its page; the chain
check (``pages.chain_problems``) names it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strata.sources.pages import envelope_schema

RAW, REJECTED = "_raw_line", "_rejected"


class RejectedLinesError(RuntimeError):
    pass


@dataclass(frozen=True)
class Accepted:
    """``rows`` fit the schema; ``rejects`` (fichier, ligne) are the others."""

    rows: DataFrame
    rejects: DataFrame
    report: dict


def _accept(lines: DataFrame, schema: StructType, path: str, max_share: float) -> Accepted:
    counts = Observation("accepted_lines")
    bad = F.col(RAW).isNotNull()
    marked = lines.withColumns({REJECTED: bad, "_file": F.when(bad, F.input_file_name())})
    marked = marked.observe(counts, F.count(F.lit(1)).alias("lignes"), F.count_if(bad).alias("rejetees"))
    marked.write.partitionBy(REJECTED).parquet(path)
    stored = lines.sparkSession.read.schema(f"{marked.schema.toDDL()}").parquet(path)
    report = dict(counts.get)
    if report["rejetees"] > max_share * report["lignes"]:
        raise RejectedLinesError(f"{report['rejetees']} of {report['lignes']} lines do not fit; see {path}")
    return Accepted(
        stored.where(~F.col(REJECTED)).select(*schema.fieldNames()),
        stored.where(REJECTED).select(F.col("_file").alias("fichier"), F.col(RAW).alias("ligne")),
        report,
    )


def accept_csv(
    spark: SparkSession,
    source: str,
    path: str,
    columns: Sequence[str],
    header: bool = True,
    sep: str = ",",
    max_share: float = 1.0,
) -> Accepted:
    """A dimension with one string column per name, stored at ``path``; a line
    with fewer or more fields is rejected."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    lines = (
        spark.read.schema(StructType([*schema.fields]).add(RAW, StringType()))
        .option("header", header)
        .option("sep", sep)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", RAW)
        .csv(source)
    )
    return _accept(lines, schema, path, max_share)


def accept_pages(
    spark: SparkSession, source: str, path: str, record_schema: StructType, max_share: float = 1.0
) -> Accepted:
    """The envelopes (page, data, next) of landed pages, stored at ``path``; a
    line that is no JSON, or a value of another type, rejects its envelope."""
    schema = envelope_schema(record_schema)
    lines = (
        spark.read.schema(StructType([*schema.fields]).add(RAW, StringType()))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", RAW)
        .json(source)
    )
    return _accept(lines, schema, path, max_share)


def records_of(envelopes: DataFrame) -> DataFrame:
    """The records of accepted envelopes."""
    return envelopes.select(F.explode("data").alias("r")).select("r.*")
