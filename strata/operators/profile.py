"""Profiling operators.

Each profile is one distributed aggregate; only its small grouped result is
ever ordered. Shares of a total use a scalar subquery (``DataFrame.scalar()``)
instead of a global window, so no step funnels rows into a single partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.sources.tables import has_columns


def value_distribution(
    df: DataFrame,
    column: str,
    value_name: str = "valeur",
    count_name: str = "nb",
    pct_name: str = "pct",
    scale: int = 1,
) -> DataFrame:
    """value, count, share of all rows (X1 = A1 + W1 + P20), most frequent first.

    The total is the sum of the (small) grouped counts, taken as a scalar
    subquery over the same aggregate, whose shuffle Spark reuses: one scan of
    ``df``, and no ``sum() over ()`` window funnelling rows into one partition.
    """
    grouped = df.groupBy(F.col(column).alias(value_name)).agg(F.count(F.lit(1)).alias(count_name))
    total = grouped.select(F.sum(count_name)).scalar()
    return grouped.withColumn(
        pct_name, F.round(F.lit(100.0) * F.col(count_name) / total, scale)
    ).orderBy(F.col(count_name).desc(), F.col(value_name).asc_nulls_first())


def value_distributions(
    df: DataFrame,
    columns: Sequence[str],
    column_name: str = "colonne",
    value_name: str = "valeur",
    count_name: str = "nb",
    pct_name: str = "pct",
    scale: int = 1,
) -> DataFrame:
    """``value_distribution`` of several columns from one scan: (column, value,
    count, share of all rows). Values are read as text; absent columns are
    left out."""
    present = has_columns(df, columns)
    if not present:
        return df.sparkSession.createDataFrame(
            [], f"{column_name} string, {value_name} string, {count_name} bigint, {pct_name} double"
        )
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in present])
    grouped = (
        df.select(F.explode(pairs).alias("p"))
        .groupBy(F.col("p.c").alias(column_name), F.col("p.v").alias(value_name))
        .agg(F.count(F.lit(1)).alias(count_name))
    )
    # every column counts every row once
    total = grouped.select(F.sum(count_name) / F.lit(len(present))).scalar()
    return grouped.withColumn(pct_name, F.round(F.lit(100.0) * F.col(count_name) / total, scale)).orderBy(
        column_name, F.col(count_name).desc(), F.col(value_name).asc_nulls_first()
    )


def null_profile(
    df: DataFrame,
    columns: Sequence[str],
    name_col: str = "colonne",
    pct_col: str = "pct_null",
    scale: int = 1,
) -> DataFrame:
    """Null rate per column (X2/U1): one scan, then unpivot with ``stack``.

    Replaces N ``SELECT ... UNION ALL`` scans with a single aggregate. Columns
    that ``df`` does not have are left out of the profile.
    """
    columns = has_columns(df, columns)
    if not columns:
        return df.sparkSession.createDataFrame([], f"{name_col} string, {pct_col} double")
    counters = df.agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(F.col(c).isNull()).alias(f"__null{i}") for i, c in enumerate(columns)],
    )
    pairs: list[Column] = []
    for i, c in enumerate(columns):
        pairs += [F.lit(c), F.col(f"__null{i}")]
    long = counters.select(
        F.col("__n"), F.stack(F.lit(len(columns)), *pairs).alias(name_col, "__nulls")
    )
    return long.select(
        F.col(name_col),
        F.round(F.lit(100.0) * F.col("__nulls") / F.nullif(F.col("__n"), F.lit(0)), scale).alias(pct_col),
    ).orderBy(F.col(pct_col).desc(), F.col(name_col))


def top_counts(
    df: DataFrame,
    keys: Sequence[str],
    k: int,
    where: Column | None = None,
    count_name: str = "nb",
) -> DataFrame:
    """Most frequent key combinations (X3/O2): count desc, keys asc, top ``k``.

    The keys complete the order, so the cut at ``k`` is deterministic; Spark
    runs ``orderBy().limit()`` as a per-partition top-k (TakeOrderedAndProject).
    """
    src = df if where is None else df.filter(where)
    grouped = src.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_name))
    order = [F.col(count_name).desc()] + [F.col(k_).asc_nulls_first() for k_ in keys]
    return grouped.orderBy(*order).limit(k)


def distinct_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``SELECT DISTINCT`` (A13) — a hash aggregate, combined map-side."""
    return df.select(*columns).distinct()
