"""Tolerant typing of raw string columns.

Raw landed data keeps every field as text. Spark 4 runs with ANSI mode, where a
plain ``cast`` of ``''`` or free text raises, so every conversion here is a
``try_cast``: unparseable input becomes NULL and is handled by expectations
downstream instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions._cols import as_col

# Fixed value: the number pattern used to pull a threshold out of text such as
# "50 mg/L" or "0,5 µg/L" (after the decimal comma became a dot). Only the first
# number is taken, so "1 000" gives 1 and ">=6.5 et <=9" gives 6.5.
NUMBER_PATTERN = r"(\d+\.?\d*)"


# A full date, alone or followed by a time of day. Spark's own cast would also
# take "2023", "2023-05" and a date followed by any text after "T".
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def parse_date(c: str | Column) -> Column:
    """String -> DATE. Accepts ``yyyy-MM-dd`` and ISO date-times; partial
    dates, dates with anything else behind them and junk -> NULL."""
    text = as_col(c).cast("string")
    return F.when(text.rlike(DATE_PATTERN), F.substring(text, 1, 10).try_cast("date"))


def year_of(c: str | Column) -> Column:
    return F.year(as_col(c))


def month_of(c: str | Column) -> Column:
    return F.month(as_col(c))


def to_double(c: str | Column) -> Column:
    """String or number -> DOUBLE; unparseable text -> NULL."""
    return as_col(c).try_cast("double")


def replace_literal(c: str | Column, search: str, replacement: str) -> Column:
    """Literal (non-regex) replacement of every occurrence."""
    return F.replace(as_col(c), F.lit(search), F.lit(replacement))


def extract_number(c: str | Column, decimal_comma: bool = True) -> Column:
    """First number found in a text threshold, as DOUBLE (NULL when none).

    ``"50 mg/L" -> 50.0``, ``"0,5 µg/L" -> 0.5``, ``"aucune" -> NULL``.
    """
    text = replace_literal(c, ",", ".") if decimal_comma else as_col(c)
    return F.regexp_extract(text, NUMBER_PATTERN, 1).try_cast("double")
