"""Column-level building blocks (return ``Column``; never touch data)."""

from strata.functions.classify import classify
from strata.functions.flags import conforming, exceeds, globally_conforming
from strata.functions.parsing import (
    extract_number,
    month_of,
    parse_date,
    replace_literal,
    to_double,
    year_of,
)
from strata.functions.rates import pct, true_as_int

__all__ = [
    "classify",
    "conforming",
    "exceeds",
    "extract_number",
    "globally_conforming",
    "month_of",
    "parse_date",
    "pct",
    "replace_literal",
    "to_double",
    "true_as_int",
    "year_of",
]
