"""Declared table reads, views and schema inspection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class SchemaDriftError(RuntimeError):
    pass


#: Files whose schema was compared, by (application, path); one footer each.
_checked: set[tuple[str, str]] = set()


def read_declared(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Scan a parquet table with its declared schema.

    A declared column that the files lack would read as NULL and one of another
    type might fail late; so the schema in the file footers is compared first,
    once per path and application. Further columns in the files are ignored."""
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    seen = (spark.conf.get("spark.app.id", ""), path)
    if seen not in _checked:
        stored = {f.name: f.dataType for f in spark.read.parquet(path).schema.fields}
        drift = [
            f"{f.name}: {f.dataType.simpleString()} declared, {stored[f.name].simpleString() if f.name in stored else 'absent'}"
            for f in declared.fields
            if stored.get(f.name) != f.dataType
        ]
        if drift:
            raise SchemaDriftError(f"{path}: {'; '.join(drift)}")
        _checked.add(seen)
    return spark.read.schema(declared).parquet(path)


def register_views(frames: Mapping[str, DataFrame]) -> None:
    """Expose frames to SQL as temporary views."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def schema_inventory(frames: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows, columns) per frame — one count job per table,
    answered from parquet footers for plain scans. Pass frames read without a
    declared schema to see the columns that the files have."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("nb_lignes")).select(
            F.lit(name).alias("nom_table"),
            F.col("nb_lignes"),
            F.lit(len(df.columns)).alias("nb_colonnes"),
        )
        for name, df in frames.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def describe(spark: SparkSession, df: DataFrame) -> DataFrame:
    """S9 ``DESCRIBE``: (column, type) rows built from the schema (metadata only)."""
    return spark.createDataFrame(
        [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields],
        "column_name string, column_type string, nullable boolean",
    )


def find_columns(df: DataFrame, needle: str) -> list[str]:
    """Column names containing ``needle`` (case-insensitive)."""
    return [c for c in df.columns if needle.lower() in c.lower()]


def has_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """S9 presence check: the subset of ``names`` that exist, in order."""
    present = set(df.columns)
    return [n for n in names if n in present]
