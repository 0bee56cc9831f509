"""Ordered regex classifier.

Rules are data: an ordered list of ``(label, pattern)``. The first pattern
that matches the lower-cased text wins; anything else (NULL included) gets the
default label. Compiles to one ``CASE WHEN ... RLIKE`` chain, evaluated inside
whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions._cols import as_col


def classify(
    c: str | Column,
    rules: Sequence[tuple[str, str]],
    default: str,
    lower: bool = True,
) -> Column:
    if not rules:
        return F.lit(default)
    text = F.lower(as_col(c)) if lower else as_col(c)
    label, pattern = rules[0]
    expr = F.when(text.rlike(pattern), F.lit(label))
    for label, pattern in rules[1:]:
        expr = expr.when(text.rlike(pattern), F.lit(label))
    return expr.otherwise(F.lit(default))
