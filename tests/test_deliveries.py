"""How facts are dealt out before they are delivered as pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.plans import bindings as B
from strata.session import settings
from strata.sources.sinks import bucket_count, discard, materialize_buckets

ORDERS = [(k, k % 3, "FOP"[k % 3], 10000.0 * (k % 4), f"199{k % 5 + 4}-03-0{k % 9 + 1}", ("5-LOW", "2-HIGH", None)[k % 3]) for k in range(40)]
LINES = [(k % 43, k % 6, k % 7, float(k)) for k in range(150)]  # some orders and parts are not there
PARTS = [(k, f"part {k}", "Brand#1", 10 * k) for k in range(5)]


def _tables(spark, path):
    """Null and repeated keys on every side."""
    odd = ORDERS[3]
    orders = spark.createDataFrame(
        [*ORDERS, odd, (None, *odd[1:])],
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, d string, o_orderpriority string",
    )
    orders = orders.withColumn("o_orderdate", F.col("d").cast("timestamp_ntz")).drop("d")
    lines = spark.createDataFrame(
        [*LINES, LINES[8], (None, 1, 1, 1.0), (4, None, 1, 2.0)], "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double"
    )
    part = spark.createDataFrame([*PARTS, PARTS[2], (None, "none", "b", 1)], "p_partkey bigint, p_name string, p_brand string, p_size int")
    for name, df in {"orders": orders, "lineitem": lines, "part": part}.items():
        names = [c.split()[0] for c in B.SCHEMAS[name].split(", ")]
        types = dict(c.split() for c in B.SCHEMAS[name].split(", "))
        df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in names]).write.parquet(f"{path}/{name}.parquet")
    return path


def test_facts_meet_their_orders_in_lots_and_are_stored_as_they_lie(spark, tmp_root):
    path = _tables(spark, tmp_root)
    plain = B.raw_facts(spark, path, ("o_orderkey", "o_orderdate"))
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", **B.CO_PARTITIONED}):
        facts = B.raw_facts(spark, path, ("o_orderkey", "o_orderdate", B.LOT), B.in_lots(bucket_count(spark), 8))
        by_line = Window.partitionBy(B.LOT, "o_orderkey").orderBy("code_parametre")
        facts = facts.withColumn("n", F.row_number().over(by_line))
        plan = facts._jdf.queryExecution().executedPlan().toString()
        # lines and parts by part, then lines and orders by lot; nothing moves the facts after that
        assert plan.count("Exchange hashpartitioning") == 4
        stored = materialize_buckets(facts, B.LOT, "facts_in_lots", placed=True)
    assert "Exchange" not in stored.groupBy(B.LOT, "o_orderkey").count()._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(map(str, df.select(*plain.columns).collect()))
    assert rows(stored) == rows(plain) and len(rows(plain)) > 100
    assert stored.where(F.col(B.LOT) != F.floor(F.col("o_orderkey") / 8)).count() == 0
    # no value of the session is left changed
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    path = stored.inputFiles()[0].rsplit("/", 1)[0]
    discard(stored)
    assert spark.read.schema(stored.schema).parquet(path).count() == 0
