"""CSV dimension files (S5): UTF-8, header row, every field a string.

No schema inference (codes keep their leading zeros: ``01`` stays ``01``);
header names are lower-cased. With ``columns`` given the schema is fixed up
front and no job is spent reading the header to name columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType


def read_csv_dimension(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    sep: str = ",",
    encoding: str = "UTF-8",
    lower: bool = True,
) -> DataFrame:
    reader = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("mode", "FAILFAST")
    )
    if columns is not None:
        schema = StructType([StructField(c.lower() if lower else c, StringType(), True) for c in columns])
        return reader.schema(schema).csv(path)
    df = reader.csv(path)
    return df.toDF(*[c.lower() for c in df.columns]) if lower else df


def write_csv(df: DataFrame, path: str, upper_headers: bool = False) -> None:
    """Write a dimension as headed CSV (as published by statistics offices)."""
    out = df.toDF(*[c.upper() for c in df.columns]) if upper_headers else df
    out.write.mode("overwrite").option("header", True).csv(path)
