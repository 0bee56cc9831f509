"""Joins of tables stored in the same buckets (J1-J3 beyond broadcast size).

Facts are written once in buckets of their key; a dimension in the same buckets
joins them without an exchange, as often as the stored facts are read. So that a
key that holds a third of all rows is not one bucket, the bucket is that of (key,
salt): a fact's salt is a hash of another column, and a dimension row is stored
once per salt. Facts without a key are spread alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "salt__"


def spread(column: str, salts: int) -> Column:
    """The salt of a fact, from a column with many values."""
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def every_salt(salts: int) -> Column:
    """All salts, for a dimension."""
    return F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int, salt: Column) -> None:
    """Store ``df`` at ``path`` as the catalog table ``name``, a file a bucket,
    sorted by (key, salt)."""
    (
        df.withColumn(SALT, salt)
        .repartition(buckets, key, SALT)
        .write.format("parquet")
        .bucketBy(buckets, key, SALT)
        .sortBy(key, SALT)
        .option("path", path)
        .saveAsTable(name)
    )


def join_bucketed(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """LEFT join of two tables of ``write_bucketed``; the small buckets of the
    dimension are hashed, so the facts are not sorted again."""
    return facts.join(dimension.hint("shuffle_hash"), [key, SALT], "left").drop(SALT)
