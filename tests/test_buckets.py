"""Joins of stored buckets exchange nothing."""

from __future__ import annotations

import glob
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from strata.operators.buckets import SALT, every_salt, join_bucketed, spread, write_bucketed
from strata.plans.layers import bronze, bucketed_silver, silver


@contextmanager
def _without_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _store(spark, tmp_root, name):
    # a hot key, a key that the dimension lacks, rows without a key
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 40))
    facts = spark.range(6000).select(key.alias("k"), F.col("id").alias("v"))
    dim = spark.createDataFrame([("hot", "H"), *((f"k{i}", f"n{i}") for i in range(39))], "k string, n string")
    write_bucketed(facts, f"{name}_f", f"{tmp_root}/f", "k", 8, spread("v", 4))
    write_bucketed(dim, f"{name}_d", f"{tmp_root}/d", "k", 8, every_salt(4))
    return facts, dim


def test_the_join_of_stored_tables_has_no_exchange(spark, tmp_root):
    facts, dim = _store(spark, tmp_root, "bk1")
    with _without_broadcast(spark):
        joined = join_bucketed(spark.table("bk1_f"), spark.table("bk1_d"), "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort " not in plan and "ShuffledHashJoin" in plan
        want = facts.join(dim, "k", "left")
        assert joined.columns == want.columns
        assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_hot_key_is_spread_over_buckets(spark, tmp_root):
    _store(spark, tmp_root, "bk2")
    assert len(glob.glob(f"{tmp_root}/f/part-*")) <= 8  # a file a bucket at most
    hot = spark.table("bk2_f").where("k = 'hot'").groupBy(SALT).count().collect()
    assert len(hot) == 4 and max(r["count"] for r in hot) < 700
    per_file = spark.table("bk2_f").groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert per_file < 3000


@pytest.mark.parametrize("salts", [1, 3])
def test_bucketed_silver_equals_silver(spark, tmp_root, all_raw, geography, salts):
    b = bronze(all_raw).drop("_ingested_at").withColumn("_ingested_at", F.lit(None).cast("timestamp"))
    want = silver(b, geography)
    with _without_broadcast(spark):
        got = bucketed_silver(b, geography, f"{tmp_root}/s", f"bk3_{salts}", 4, salts)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
