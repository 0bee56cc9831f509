"""Mergeable exact distinct counts against the textbook form."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from strata.operators.aggregates import count_distinct_reference
from strata.operators.bitmaps import BLOCK, EVERY, NUMBER, bitmap_partials, merged_counts, number_entities

SCHEMA = "area string, year int, entity string, ok boolean"
NAMES = {EVERY: "n", "yes": "n_yes", "no": "n_no"}


def _conditions():
    return {"yes": F.col("ok"), "no": ~F.col("ok")}


def _rows(n=3000, seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        entity = rng.choice([None, *(f"E{i}" for i in range(400))])
        rows.append((rng.choice(["a", "b", None]), rng.choice([2021, 2022]), entity, rng.choice([True, False, None])))
    return rows


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=str)


def _partials(spark, df, keys=("area", "year")):
    return bitmap_partials(df, keys, "entity", number_entities(df, "entity", ["year", "area"]), _conditions())


def test_any_coarser_key_comes_from_the_same_partials(spark):
    df = spark.createDataFrame(_rows(), SCHEMA).cache()
    partials = _partials(spark, df).cache()
    for keys in (["area", "year"], ["area"], ["year"], []):
        want = count_distinct_reference(df, keys, "entity", {"n_yes": F.col("ok"), "n_no": ~F.col("ok")}, "n")
        assert _sorted(merged_counts(partials, keys, NAMES)) == _sorted(want)


def test_partials_of_deliveries_are_united(spark):
    """The same entities in both halves count once."""
    df = spark.createDataFrame(_rows(seed=2), SCHEMA).cache()
    numbers = number_entities(df, "entity", ["year"])
    halves = [bitmap_partials(df.where(c), ["area"], "entity", numbers, _conditions()) for c in (F.col("year") == 2021, F.col("year") == 2022)]
    want = count_distinct_reference(df, ["area"], "entity", {"n_yes": F.col("ok"), "n_no": ~F.col("ok")}, "n")
    assert _sorted(merged_counts(halves[0].unionByName(halves[1]), ["area"], NAMES)) == _sorted(want)


def test_entities_of_a_key_lie_in_few_blocks_and_a_hot_entity_counts_once(spark):
    rows = spark.range(40_000).select(
        F.concat(F.lit("A"), F.floor(F.col("id") / 20_000)).alias("area"),
        F.lit(2021).alias("year"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("E"), "id")).alias("entity"),
        F.lit(True).alias("ok"),
    )
    numbers = number_entities(rows, "entity", ["area"])
    assert numbers.select(F.count_distinct(NUMBER), F.count_distinct("entity")).first() == (26_667, 26_667)
    partials = bitmap_partials(rows, ["area"], "entity", numbers, _conditions())
    assert partials.groupBy("area").agg(F.count_distinct(BLOCK).alias("n")).agg(F.max("n")).first()[0] <= 10
    assert sorted(r.n for r in merged_counts(partials, ["area"], NAMES).collect()) == [13_334, 13_334]
    assert merged_counts(partials, [], NAMES).first()["n"] == 26_667


def test_no_rows_and_no_entities(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merged_counts(_partials(spark, empty), ["area"], NAMES).collect() == []
    none = spark.createDataFrame([("a", 2021, None, True)], SCHEMA)
    assert _sorted(merged_counts(_partials(spark, none), ["area"], NAMES)) == [("a", 0, 0, 0)]


def test_a_key_with_few_entities_costs_a_word(spark):
    """Many keys of one entity each: no state or row holds the bits of a whole block."""
    rows = spark.range(1000).select(
        F.concat(F.lit("A"), "id").alias("area"), F.lit(2021).alias("year"), F.concat(F.lit("E"), "id").alias("entity"), F.lit(True).alias("ok")
    )
    partials = _partials(spark, rows)
    assert {kind for name, kind in partials.dtypes if name in NAMES} == {"bigint"}
    assert partials.count() == 1000
    assert _sorted(merged_counts(partials, ["year"], NAMES)) == [(2021, 1000, 1000, 0)]
