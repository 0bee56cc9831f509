"""Table writes (K2-K5, K8).

Partitioned writes use a ``rebalance`` hint on the partition columns rather
than ``repartition``: AQE then splits a partition value that holds a large
share of the rows across several tasks (no single-task straggler) and merges
small ones (no small-file flood).
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strata.session import scratch_dir, settings

#: Writes that need little disk: smaller files, and what they shuffled goes when they end.
LEAN = {
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
#: A task writes so many partition values or buckets side by side, as its rows come;
#: only beyond that it sorts the rest by them, which large tasks do on disk.
SIDE_BY_SIDE = {"spark.sql.maxConcurrentOutputFileWriters": "64"}


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
    fmt: str = "parquet",
    order_by: Sequence[str | Column] = (),
    clustered: bool = False,
) -> dict:
    """Write ``df`` and return a load report (K8): rows written, via an
    ``Observation`` collected during the write itself (no second pass).

    ``order_by`` stores the rows in that order (O1, K4): of a partitioned table
    inside each partition value's files, else in files of successive ranges. A
    filter on the leading column then skips row groups by their statistics.

    ``clustered`` says that ``df`` scans files that each hold few values of
    ``partition_by``, as of a table in finer partitions, or is rebalanced by them: its
    rows are written as they come, without a shuffle."""
    obs = Observation("load_report")
    out = df.observe(obs, F.count(F.lit(1)).alias("rows_written"))
    if partition_by and not clustered:
        out = out.hint("rebalance", *partition_by)
    elif order_by and not partition_by:
        out = out.repartitionByRange(*order_by)
    if order_by:
        out = out.sortWithinPartitions(*partition_by, *order_by)
    writer = out.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with settings(df.sparkSession, {} if order_by else SIDE_BY_SIDE):
        writer.save(path)
    report = dict(obs.get)
    report.update({"path": path, "mode": mode, "partitions": list(partition_by)})
    return report


def read_stored(df: DataFrame, path: str) -> DataFrame:
    """What ``write_table(df, path)`` wrote, with the written schema: partition
    values keep their types (a code "01" must not come back as the integer 1)."""
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, purpose: str = "materialized", partition_by: Sequence[str] = ()) -> DataFrame:
    """Compute ``df`` once and cut its lineage, for plans that consume it
    several times: it is written as a parquet table in a fresh directory of
    the shared checkpoint folder and read back. Unlike a local checkpoint the
    files survive the loss of the executors that wrote them, and unlike a row
    checkpoint each consumer reads back only the columns it needs."""
    path = scratch_dir(df.sparkSession, purpose)
    write_table(df, path, partition_by)
    return read_stored(df, path)


def _table_name(path: str) -> str:
    """What the catalog calls a table of ``materialize_buckets``."""
    return path.rsplit("/", 1)[-1].replace("-", "_")


def bucket_count(spark: SparkSession) -> int:
    """How many buckets ``materialize_buckets`` makes: the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialize_buckets(df: DataFrame, key: str, purpose: str = "materialized", placed: bool = False) -> DataFrame:
    """``materialize`` as a catalog table in ``bucket_count`` buckets of ``key``: what
    groups by ``key`` and more reads it without an exchange. ``placed`` says that ``df``
    is in as many partitions by ``key`` already: its rows are not moved."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, purpose)
    name, buckets = _table_name(path), bucket_count(spark)
    rows = df if placed else df.repartition(buckets, key)
    with settings(spark, SIDE_BY_SIDE):
        rows.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return spark.table(name)


def discard(stored: DataFrame) -> None:
    """Empty what ``materialize`` or ``materialize_buckets`` wrote, once nothing reads
    it any more: the files go, as by any overwrite, and the catalog's entry."""
    spark, files = stored.sparkSession, stored.inputFiles()[:1]
    for file in files:
        path = unquote(file).rsplit("/", 1)[0]
        spark.sql(f"DROP TABLE IF EXISTS `{_table_name(path)}`")
        spark.createDataFrame([], stored.schema).write.mode("overwrite").parquet(path)


def replace_load(df: DataFrame, path: str, fmt: str = "parquet") -> dict:
    """K2: full replacement of a table."""
    return write_table(df, path, mode="overwrite", fmt=fmt)


#: Characters that Spark writes as %XX in directory names.
_ESCAPED = {*"\"#%'*/:=?\\\x7f{[]^", *map(chr, range(1, 32))}
_NULL_DIRECTORY = "__HIVE_DEFAULT_PARTITION__"


def partition_directory(path: str, column: str, value: object) -> str:
    """Where Spark's writer puts the rows of a partition value."""
    text = _NULL_DIRECTORY if value is None else "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in str(value))
    return f"{path}/{column}={text}"


#: View properties: the table that a published name shows, and the one before.
_VERSION, _BEFORE = "strata.version", "strata.before"


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "\\'") + "'"


def build_version(
    spark: SparkSession,
    name: str,
    stored: DataFrame,
    path: str,
    partition_by: str | None = None,
    unchanged: Mapping[object, str] | None = None,
) -> str:
    """A catalog table of its own over the complete table that ``write_table``
    left at ``path``; returns its name. Of a partitioned table, ``unchanged`` adds
    partitions (value -> directory) of earlier versions that ``path`` lacks."""
    version = f"{name}__{uuid.uuid4().hex[:12]}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema.fields)
    parts = f"PARTITIONED BY (`{partition_by}`)" if partition_by else ""
    spark.sql(f"CREATE TABLE {version} ({columns}) USING parquet {parts} LOCATION '{path}'")
    if partition_by:
        own = [r[0] for r in stored.select(partition_by).distinct().collect()]  # as many as partitions
        places = {**(unchanged or {}), **{v: partition_directory(path, partition_by, v) for v in own}}
        if places:
            added = " ".join(f"PARTITION (`{partition_by}`={_literal(v)}) LOCATION '{p}'" for v, p in places.items())
            spark.sql(f"ALTER TABLE {version} ADD {added}")
    return version


def _properties(spark: SparkSession, name: str) -> dict[str, str]:
    if not spark.catalog.tableExists(name):
        return {}
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}


def switch_version(spark: SparkSession, name: str, version: str) -> None:
    """Let the view ``name`` show ``version``, in one statement of the catalog.
    The version before stays for readers that began with it; the one before that
    goes from the catalog (its files stay until storage expires them)."""
    now = _properties(spark, name)
    before = now.get(_VERSION, "")
    spark.sql(
        f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('{_VERSION}'='{version}', '{_BEFORE}'='{before}') "
        f"AS SELECT * FROM {version}"
    )
    if now.get(_BEFORE):
        spark.sql(f"DROP TABLE IF EXISTS {now[_BEFORE]}")


def publish_table(
    spark: SparkSession,
    name: str,
    stored: DataFrame,
    path: str,
    partition_by: str | None = None,
    unchanged: Mapping[object, str] | None = None,
) -> None:
    """K5 ``CREATE OR REPLACE TABLE``: ``name`` shows the complete new table from
    one moment to the next. It is built under a name of its own first, so that a
    failure on the way leaves ``name`` as it was."""
    switch_version(spark, name, build_version(spark, name, stored, path, partition_by, unchanged))


def published_partitions(spark: SparkSession, name: str, partition_by: str) -> dict[object, str]:
    """Partition values and directories of what ``name`` shows now."""
    version = _properties(spark, name).get(_VERSION)
    if version is None:
        return {}
    values = [r[0] for r in spark.table(version).select(partition_by).distinct().collect()]
    out = {}
    for value in values:
        detail = spark.sql(f"DESCRIBE EXTENDED {version} PARTITION (`{partition_by}`={_literal(value)})").collect()
        out[value] = next(r["data_type"] for r in detail if r["col_name"] == "Location")
    return out
