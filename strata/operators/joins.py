"""Enrichment joins.

Dimensions are joined LEFT so that facts are never lost. The join strategy is
the planner's: a side is broadcast only while Spark's size check allows it
(the static threshold on the estimate, then AQE's on the measured shuffle);
a dimension that grows beyond it is joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _as_list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


@dataclass(frozen=True)
class Lookup:
    """One LEFT equi-join step: ``frame[left_on] == dim[right_on]``.

    ``columns`` maps dimension columns to output names; ``left_on`` may name a
    column produced by an earlier lookup (chained snowflake joins).
    """

    dim: DataFrame
    left_on: str | Sequence[str]
    right_on: str | Sequence[str]
    columns: Mapping[str, str] = field(default_factory=dict)


def enrich_left(fact: DataFrame, lookups: Sequence[Lookup]) -> DataFrame:
    """Chain LEFT joins; right-side keys are dropped, unmatched rows get NULLs."""
    out = fact
    for n, lk in enumerate(lookups):
        left = _as_list(lk.left_on)
        right = _as_list(lk.right_on)
        keys = [f"__lk{n}_{i}" for i in range(len(right))]
        dim = lk.dim.select(
            *[F.col(r).alias(k) for r, k in zip(right, keys)],
            *[F.col(src).alias(dst) for src, dst in lk.columns.items()],
        )
        cond = [F.col(lc) == F.col(k) for lc, k in zip(left, keys)]
        out = out.join(dim, cond, "left").drop(*keys)
    return out


def fanout_left(fact: DataFrame, bridge: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Deliberate many-to-many LEFT join onto a bridge table.

    Output rows = fact rows x matching bridge rows (one NULL-extended row
    when none). Both sides are read once; AQE splits hot keys of the fact side.
    """
    return fact.join(bridge, _as_list(on), "left")


def join_coverage(
    fact: DataFrame,
    dim: DataFrame,
    left_on: str,
    right_on: str,
    scale: int = 1,
) -> DataFrame:
    """Match-rate probe of a LEFT join (J5/X4): total, matched, pct matched.

    The dimension is reduced to its distinct keys first so a duplicated key
    cannot inflate the totals; one aggregate row comes out.
    """
    keys = dim.select(F.col(right_on).alias("__key")).distinct()
    joined = fact.select(F.col(left_on).alias("__fk")).join(
        keys, F.col("__fk") == F.col("__key"), "left"
    )
    total = F.count(F.lit(1))
    matched = F.count("__key")
    return joined.agg(
        total.alias("total"),
        matched.alias("matched"),
        F.round(F.lit(100.0) * matched / F.nullif(total, F.lit(0)), scale).alias("pct_matched"),
    )
