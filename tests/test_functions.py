"""Column functions: tolerant typing, classification, three-valued flags, rates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from strata.functions import (
    classify,
    conforming,
    exceeds,
    extract_number,
    globally_conforming,
    parse_date,
    pct,
    to_double,
)
from strata.plans.water import CATEGORY_RULES, DEFAULT_CATEGORY


def _one_col(spark, values, ddl, expr):
    df = spark.createDataFrame([(v,) for v in values], ddl)
    return [r[0] for r in df.select(expr).collect()]


def test_parse_date_tolerant(spark):
    got = _one_col(
        spark,
        ["2023-01-10", "2023-01-10T08:30:00Z", "2023-01-10 08:30:00", "pas de date", "", None,
         "2023", "2023-05", "2023-01-10Tgarbage", "2023-01-10x", "2023-02-30", "2023-01-10T08:30:00+02:00"],
        "s string",
        parse_date("s"),
    )
    d = dt.date(2023, 1, 10)
    assert got == [d, d, d, None, None, None, None, None, None, None, None, d]


def test_to_double_tolerant(spark):
    got = _one_col(spark, ["12", "0.5", "", "abc", None, "1e3"], "s string", to_double("s"))
    assert got == [12.0, 0.5, None, None, None, 1000.0]


def test_extract_number_first_number(spark):
    got = _one_col(
        spark,
        ["50 mg/L", "0,5 µg/L", ">=6.5 et <=9", "1 000 UFC", "absence", "", None, "10 µg/L"],
        "s string",
        extract_number("s"),
    )
    assert got == [50.0, 0.5, 6.5, 1.0, None, None, None, 10.0]


def test_classify_reference_labels(spark):
    labels = ["E. coli", "Coliformes", "Nitrates", "Arsenic", "Température", "Tritium",
              "Entérocoques", "Légionelles", "Turbidité", None]
    got = _one_col(spark, labels, "s string", classify("s", CATEGORY_RULES, DEFAULT_CATEGORY))
    assert got == [
        "microbiologie", "microbiologie", "chimie", "chimie", "organoleptique",
        "radioactivite", "microbiologie", "microbiologie", "organoleptique", "chimie",
    ]


def test_classify_first_match_wins(spark):
    rules = [("a", r"r.ng|hot"), ("b", r"plate|red")]
    got = _one_col(spark, ["red ring", "red plate", "cold rod"], "s string", classify("s", rules, "z"))
    assert got == ["a", "b", "z"]


def test_conformity_flags_three_valued(spark):
    df = spark.createDataFrame(
        [("C", "C"), ("N", "C"), ("C", "N"), ("N", "N"), ("D", "C"), (None, "C"), ("S", None), (None, "N")],
        "b string, p string",
    )
    rows = df.select(conforming("b"), conforming("p"), globally_conforming(["b", "p"])).collect()
    assert [tuple(r) for r in rows] == [
        (True, True, True),
        (False, True, False),
        (True, False, False),
        (False, False, False),
        (True, True, True),
        (None, True, None),
        (True, None, None),
        (None, False, False),
    ]


def test_exceeds_null_propagation(spark):
    df = spark.createDataFrame([(15.0, 10.0), (5.0, 100.0), (16.0, None), (None, 1.0)], "v double, l double")
    assert [r[0] for r in df.select(exceeds("v", "l")).collect()] == [True, False, None, None]


def test_pct_guards_zero_and_rounds(spark):
    df = spark.createDataFrame([(5, 8), (3, 8), (0, 0), (1, 3), (2, 3)], "a bigint, b bigint")
    got = [r[0] for r in df.select(pct("a", "b")).collect()]
    assert got == [62.5, 37.5, None, 33.33, 66.67]
    assert df.select(pct("a", "b")).schema[0].dataType.simpleString() == "double"


def test_pct_one_decimal(spark):
    df = spark.createDataFrame([(1, 3)], "a bigint, b bigint")
    assert df.select(pct(F.col("a"), F.col("b"), 1)).first()[0] == 33.3
