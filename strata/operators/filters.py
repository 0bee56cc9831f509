"""Optional conjunctive filters and argument validation."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: accepted shape of an area code passed to a serving query.
CODE_PATTERN = r"^[0-9A-Za-z]{1,10}$"


def apply_filters(df: DataFrame, equals: Mapping[str, object]) -> DataFrame:
    """AND of ``col == value`` over the parameters that are not None (F4); a
    list, tuple or set of values means ``col IN (...)`` (F5).

    ``0`` and ``''`` are real values, an empty list keeps no row; only
    ``None`` means "no filter". Filters
    on grouping keys of a gold table are pushed by Catalyst below the
    aggregate and into the scan (partition pruning on partitioned tables).
    """
    for col, value in equals.items():
        if isinstance(value, (list, tuple, set, frozenset)):
            df = df.filter(F.col(col).isin(*value) if value else F.lit(False))
        elif value is not None:
            df = df.filter(F.col(col) == F.lit(value))
    return df


def drop_null_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows whose key columns are all set."""
    cond = None
    for c in columns:
        term = F.col(c).isNotNull()
        cond = term if cond is None else cond & term
    return df if cond is None else df.filter(cond)


def validate_code(value, pattern: str = CODE_PATTERN, name: str = "code") -> None:
    """reject malformed codes before any plan is built."""
    if value is None:
        return
    if not re.fullmatch(pattern, str(value)):
        raise ValueError(f"invalid {name}: {value!r}")


def validate_choice(value, allowed: Iterable, name: str = "value") -> None:
    """enum parameter check."""
    if value is not None and value not in set(allowed):
        raise ValueError(f"invalid {name}: {value!r}")
