"""Three-valued (Kleene) flags.

NULL inputs stay NULL: a missing code is neither conforming nor
non-conforming, a missing threshold gives no exceedance verdict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions._cols import as_col


def exceeds(value: str | Column, threshold: str | Column) -> Column:
    """``value > threshold``; NULL when either side is NULL."""
    return as_col(value) > as_col(threshold)


def conforming(code: str | Column, failing_code: str = "N") -> Column:
    """``code != 'N'`` — TRUE for C/D/S, FALSE for N, NULL for NULL."""
    return as_col(code) != F.lit(failing_code)


def globally_conforming(codes: Sequence[str | Column], failing_code: str = "N") -> Column:
    """``NOT (c1 = 'N' OR c2 = 'N' ...)`` with SQL three-valued logic.

    FALSE as soon as one code is N; NULL when no code is N but one is NULL.
    """
    any_failing = None
    for c in codes:
        term = as_col(c) == F.lit(failing_code)
        any_failing = term if any_failing is None else (any_failing | term)
    return ~any_failing
