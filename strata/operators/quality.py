"""Data-quality expectations (F2, Q1-Q8).

A suite compiles to ONE distributed aggregate with two counters per
expectation (rows evaluated, rows violating); the single counter row is
unpivoted into a report DataFrame. Nothing but that report — one row per
expectation — ever reaches the driver, where ``gate`` raises on failure.

Evaluation follows the usual expectation-library conventions: ``not_null``
evaluates every row; the other rules skip NULLs; ``mostly`` is the minimal
share of evaluated rows that must pass (vacuously true with nothing to
evaluate).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Expectation:
    column: str
    rule: str
    values: tuple = ()
    min_value: float | None = None
    max_value: float | None = None
    pattern: str | None = None
    mostly: float = 1.0

    def counters(self) -> tuple[Column, Column]:
        c = F.col(self.column)
        if self.rule == "not_null":
            return F.count(F.lit(1)), F.count_if(c.isNull())
        if self.rule == "in_set":
            allowed = [v for v in self.values if v is not None]
            return F.count(c), F.count_if(c.isNotNull() & ~c.isin(*allowed))
        if self.rule == "between":
            bad = F.lit(False)
            if self.min_value is not None:
                bad = bad | (c < F.lit(self.min_value))
            if self.max_value is not None:
                bad = bad | (c > F.lit(self.max_value))
            return F.count(c), F.count_if(c.isNotNull() & bad)
        if self.rule == "regex":
            return F.count(c), F.count_if(c.isNotNull() & ~c.cast("string").rlike(self.pattern))
        raise ValueError(f"unknown rule {self.rule!r}")


def not_null(column: str, mostly: float = 1.0) -> Expectation:
    return Expectation(column, "not_null", mostly=mostly)


def in_set(column: str, values: Sequence, mostly: float = 1.0) -> Expectation:
    return Expectation(column, "in_set", values=tuple(values), mostly=mostly)


def between(column: str, min_value=None, max_value=None, mostly: float = 1.0) -> Expectation:
    return Expectation(column, "between", min_value=min_value, max_value=max_value, mostly=mostly)


def matches(column: str, pattern: str, mostly: float = 1.0) -> Expectation:
    return Expectation(column, "regex", pattern=pattern, mostly=mostly)


@dataclass(frozen=True)
class Suite:
    """A named, saved list of expectations (Q8): plain data in the repo."""

    name: str
    expectations: tuple[Expectation, ...] = field(default_factory=tuple)


def _report(df: DataFrame, suites: Sequence[Suite]) -> DataFrame:
    """One aggregate over ``df`` for every expectation of ``suites``."""
    checks = [(s.name, e) for s in suites for e in s.expectations]
    aggs = []
    for i, (_, e) in enumerate(checks):
        evaluated, violations = e.counters()
        aggs += [evaluated.alias(f"__e{i}"), violations.alias(f"__v{i}")]
    counters = df.agg(*aggs)
    stacked: list[Column] = []
    for i, (suite_name, e) in enumerate(checks):
        stacked += [
            F.lit(suite_name),
            F.lit(e.column),
            F.lit(e.rule),
            F.lit(float(e.mostly)),
            F.col(f"__e{i}"),
            F.col(f"__v{i}"),
        ]
    long = counters.select(
        F.stack(F.lit(len(checks)), *stacked).alias(
            "suite", "colonne", "regle", "mostly", "evaluees", "violations"
        )
    )
    passed = F.col("evaluees") - F.col("violations")
    return long.withColumn("succes", passed >= F.col("mostly") * F.col("evaluees"))


def evaluate(df: DataFrame, suite: Suite) -> DataFrame:
    """One pass over ``df`` -> one report row per expectation (Q2-Q6)."""
    return _report(df, [suite])


def evaluate_all(checks: Sequence[tuple[DataFrame, Suite]]) -> DataFrame:
    """Reports of several suites, unioned. Suites on the same DataFrame are
    evaluated together, so each table is scanned once whatever the number of
    suites run on it. Suites need names of their own: the report, its summary
    and the gate tell them apart by name."""
    names = [suite.name for _, suite in checks]
    if repeated := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"suite names are repeated: {', '.join(repeated)}")
    groups: dict[int, tuple[DataFrame, list[Suite]]] = {}
    for df, suite in checks:
        groups.setdefault(id(df), (df, []))[1].append(suite)
    reports = [_report(df, suites) for df, suites in groups.values()]
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


class QualityGateError(RuntimeError):
    pass


def summarize(report: DataFrame) -> list[dict]:
    """Per-suite summary (Q6): success, evaluated and successful expectations.

    Collects at most one row per suite.
    """
    rows = (
        report.groupBy("suite")
        .agg(
            F.bool_and("succes").alias("succes"),
            F.count(F.lit(1)).alias("evaluees"),
            F.count_if("succes").alias("reussies"),
        )
        .orderBy("suite")
        .collect()
    )
    return [r.asDict() for r in rows]


def gate(report: DataFrame) -> list[dict]:
    """Raise ``QualityGateError`` when any suite failed (Q7); else return the summary."""
    summary = summarize(report)
    failed = [s["suite"] for s in summary if not s["succes"]]
    if failed:
        raise QualityGateError(f"expectation suites failed: {', '.join(failed)}")
    return summary


def expect_or_drop(
    df: DataFrame,
    rules: Mapping[str, Column],
    observation: Observation | None = None,
) -> DataFrame:
    """Keep rows satisfying every rule (F2/Q1); count violators per rule.

    A rule whose predicate is NULL counts as violated. The counts are
    collected by ``observation`` as a side effect of whatever action consumes
    the result — no extra pass over the data.
    """
    held = {name: F.coalesce(pred, F.lit(False)) for name, pred in rules.items()}
    if observation is not None:
        df = df.observe(
            observation,
            F.count(F.lit(1)).alias("rows_in"),
            *[F.count_if(~ok).alias(f"dropped: {name}") for name, ok in held.items()],
        )
    keep = None
    for ok in held.values():
        keep = ok if keep is None else keep & ok
    return df if keep is None else df.filter(keep)


def violation_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows violating each drop rule, as rows (rule, rows, violations)."""
    names = list(rules)
    counters = df.agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(~F.coalesce(rules[n], F.lit(False))).alias(f"__v{i}") for i, n in enumerate(names)],
    )
    pairs: list[Column] = []
    for i, n in enumerate(names):
        pairs += [F.lit(n), F.col(f"__v{i}")]
    return counters.select(
        F.stack(F.lit(len(names)), *pairs).alias("regle", "violations"), F.col("__n").alias("lignes")
    )
