"""Entity-deduplicated aggregates.

Fact rows repeat entity-level attributes (one row per analysed parameter of a
sample), so counts must be of *distinct entities*. ``COUNT(DISTINCT CASE WHEN f
THEN entity END)`` for several flags makes Spark plan an ``Expand`` that copies
every row once per distinct expression. ``entity_counts`` gives the same
numbers with two plain hash aggregations instead:

1. ``groupBy(keys, entity)``: ``bool_or(condition)`` per condition — one row per
   entity and group, combined map-side before the shuffle.
2. ``groupBy(keys)``: ``count(entity)`` and ``count_if(entity IS NOT NULL AND
   any_condition)``.

``bool_or`` ignores NULLs and is NULL when every value is NULL, so an entity
whose flag is NULL everywhere counts on neither side of a condition and its
negation, exactly like the distinct form. Both stages pre-aggregate before
their exchange, so neither a hot group nor a hot entity lands whole on one
task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.rates import pct


def entity_counts(
    df: DataFrame,
    keys: Sequence[str],
    entity: str,
    conditions: Mapping[str, Column],
    total_name: str,
) -> DataFrame:
    """Per group: distinct entities, and distinct entities with >= 1 row where
    each condition is TRUE."""
    keys = list(keys)
    names = list(conditions)
    per_entity = df.groupBy(*keys, entity).agg(
        *[F.bool_or(conditions[n]).alias(f"__any{i}") for i, n in enumerate(names)]
    )
    present = F.col(entity).isNotNull()
    return per_entity.groupBy(*keys).agg(
        F.count(entity).alias(total_name),
        *[F.count_if(present & F.col(f"__any{i}")).alias(n) for i, n in enumerate(names)],
    )


def entity_rates(
    df: DataFrame,
    keys: Sequence[str],
    entity: str,
    conditions: Mapping[str, Column],
    rates: Mapping[str, str],
    total_name: str,
    scale: int = 2,
) -> DataFrame:
    """``entity_counts`` plus ``rates[name] = pct(count_name, total)`` columns."""
    counts = entity_counts(df, keys, entity, conditions, total_name)
    return counts.withColumns(
        {rate: pct(F.col(count), F.col(total_name), scale) for rate, count in rates.items()}
    )


def count_distinct_reference(
    df: DataFrame,
    keys: Sequence[str],
    entity: str,
    conditions: Mapping[str, Column],
    total_name: str,
) -> DataFrame:
    """The textbook ``count(DISTINCT CASE WHEN ...)`` form, kept for equivalence tests."""
    return df.groupBy(*keys).agg(
        F.count_distinct(entity).alias(total_name),
        *[F.count_distinct(F.when(c, F.col(entity))).alias(n) for n, c in conditions.items()],
    )


def rollup_of_counts(
    df: DataFrame,
    keys: Sequence[str],
    entity: str,
    count_name: str = "nb",
) -> DataFrame:
    """Aggregate over an aggregate (A12): MIN / SUM / number of groups of the
    per-group distinct-entity count. One row out."""
    per_group = df.groupBy(*keys).agg(F.count_distinct(entity).alias(count_name))
    return per_group.agg(
        F.min(count_name).alias(f"min_{count_name}"),
        F.sum(count_name).alias(f"sum_{count_name}"),
        F.count(F.lit(1)).alias("nb_groupes"),
    )
