"""strata — a PySpark library of medallion-pipeline operators.

Layers are plain ``DataFrame -> DataFrame`` functions built from Catalyst
expressions (no Python UDFs): tolerant typing, rule-based classification,
three-valued conformity flags, left-join enrichment, entity-deduplicated
rates, single-pass data-quality suites, profiling, serving queries, batch
and streaming key-based upserts, and readers for landed paged JSON / CSV.
"""

__all__ = ["functions", "operators", "sources", "plans", "streaming"]
