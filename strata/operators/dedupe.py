"""Keep one row per key.

Both operators are *aggregations*, not ``row_number()`` windows: the winner is
``min_by``/``max_by`` of the payload under the ordering, which alone decides
(rows equal in it are interchangeable). An
aggregation is combined map-side before the shuffle, so a key holding a third
of all rows reaches its reducer as one partial row per map task instead of
being sorted whole inside a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions._cols import as_col


def _winner(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    pick_max: bool,
) -> DataFrame:
    keys = list(keys)
    payload = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)])
    pick = F.max_by if pick_max else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*payload), ordering).alias("__w")).select(
        *keys, *[F.col(f"__w.{c}").alias(c) for c in payload]
    )


def dedupe_by_key(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str | Column],
    prefer_non_null: Sequence[str] = (),
) -> DataFrame:
    """One row per key: rows whose ``prefer_non_null`` columns are set win,
    then the smallest ``order_by`` tuple (ascending, NULLs first).

    ``order_by`` should make the choice total (e.g. end with a unique column)
    so reruns pick the same row.
    """
    order = [F.col(c).isNull() for c in prefer_non_null] + [as_col(c) for c in order_by]
    return _winner(df, keys, order, pick_max=False)


def latest_by_key(
    df: DataFrame,
    keys: Sequence[str],
    version_by: Sequence[str | Column],
) -> DataFrame:
    """One row per key: the largest ``version_by`` tuple (descending)."""
    return _winner(df, keys, [as_col(c) for c in version_by], pick_max=True)


def upsert(
    existing: DataFrame | None,
    updates: DataFrame,
    keys: Sequence[str],
    version_by: Sequence[str | Column],
    updates_win: bool = True,
) -> DataFrame:
    """Merge ``updates`` into ``existing`` by primary key (K1).

    With ``updates_win`` an incoming row replaces the stored one for its key
    whatever its version (merge semantics); inside one side the highest
    ``version_by`` wins. Without it the highest version wins across both.
    """
    cols = updates.columns
    if existing is None:
        return latest_by_key(updates, keys, version_by)
    both = existing.select(*cols).withColumn("__batch", F.lit(0)).unionByName(
        updates.withColumn("__batch", F.lit(1))
    )
    order = ([F.col("__batch")] if updates_win else []) + [as_col(c) for c in version_by]
    return _winner(both, keys, order, pick_max=True).select(*cols)
