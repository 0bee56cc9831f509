"""Hot keys: one key holding a third of all rows must give exact results
through map-side combining / splittable joins, never a single-partition
funnel."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.operators.aggregates import count_distinct_reference, entity_counts
from strata.operators.dedupe import latest_by_key
from strata.operators.joins import fanout_left


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(11)
    rows = []
    for i in range(6000):
        hot = i % 3 == 0
        key = "HOT" if hot else f"k{rng.randrange(300)}"
        entity = "E-HOT" if hot and rng.random() < 0.5 else f"e{rng.randrange(2000)}"
        rows.append((key, entity, rng.choice([True, False, None]), i, rng.random()))
    return spark.createDataFrame(rows, "k string, e string, f boolean, ver int, v double")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_entity_counts_with_hot_key_and_hot_entity(skewed):
    conds = {"pos": F.col("f"), "neg": ~F.col("f")}
    ours = entity_counts(skewed, ["k"], "e", conds, "n")
    ref = count_distinct_reference(skewed, ["k"], "e", conds, "n")
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, ref.select(*ours.columns).collect()))
    plan = _plan(ours)
    assert "SinglePartition" not in plan
    assert plan.count("HashAggregate") >= 4  # partial + final per stage


def test_latest_by_key_hot_key(skewed):
    ours = latest_by_key(skewed, ["k"], ["ver"])
    w = Window.partitionBy("k").orderBy(F.col("ver").desc())
    ref = skewed.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, ref.select(*ours.columns).collect()))
    assert "Window" not in _plan(ours)


def test_fanout_hot_bridge_key(spark, skewed):
    facts = skewed.select("k").distinct().withColumn("tag", F.lit(1))
    bridge = skewed.select("k", F.col("ver").alias("link"))
    facts = facts.union(spark.createDataFrame([("lonely", 2)], facts.schema))
    ours = fanout_left(facts, bridge, "k")
    assert ours.count() == skewed.count() + 1  # the hot key with all its rows
    assert ours.filter("k = 'HOT'").count() == skewed.filter("k = 'HOT'").count()
    assert ours.filter("k = 'lonely'").first().link is None
    # each side is read once
    assert _plan(ours).count("SortMergeJoin") + _plan(ours).count("BroadcastHashJoin") == 1
