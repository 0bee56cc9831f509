"""Rates and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions._cols import as_col


def pct(numerator: str | Column, denominator: str | Column, scale: int = 2) -> Column:
    """``round(100.0 * a / nullif(b, 0), scale)`` as DOUBLE.

    The 100 is a double literal and is applied first, so integer counts never
    go through DECIMAL arithmetic; a zero denominator gives NULL.
    """
    den = F.nullif(as_col(denominator), F.lit(0))
    return F.round(F.lit(100.0) * as_col(numerator) / den, scale)


def true_as_int(c: str | Column) -> Column:
    """Boolean -> 1/0, NULL stays NULL (so ``sum`` of it counts TRUEs)."""
    return as_col(c).cast("int")
