"""Relational operators over DataFrames (joins, dedupe, aggregates, profiles, quality)."""

from strata.operators.aggregates import entity_counts, entity_rates, rollup_of_counts
from strata.operators.dedupe import dedupe_by_key, latest_by_key, upsert
from strata.operators.filters import apply_filters, drop_null_keys, validate_choice, validate_code
from strata.operators.joins import Lookup, enrich_left, fanout_left, join_coverage
from strata.operators.profile import distinct_rows, null_profile, top_counts, value_distribution
from strata.operators.quality import (
    Expectation,
    QualityGateError,
    Suite,
    between,
    evaluate,
    evaluate_all,
    expect_or_drop,
    gate,
    in_set,
    matches,
    not_null,
    summarize,
    violation_counts,
)

__all__ = [
    "Expectation",
    "Lookup",
    "QualityGateError",
    "Suite",
    "apply_filters",
    "between",
    "dedupe_by_key",
    "distinct_rows",
    "drop_null_keys",
    "enrich_left",
    "entity_counts",
    "entity_rates",
    "evaluate",
    "evaluate_all",
    "expect_or_drop",
    "fanout_left",
    "gate",
    "in_set",
    "join_coverage",
    "latest_by_key",
    "matches",
    "not_null",
    "null_profile",
    "rollup_of_counts",
    "summarize",
    "top_counts",
    "upsert",
    "validate_choice",
    "validate_code",
    "value_distribution",
    "violation_counts",
]
