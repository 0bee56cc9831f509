"""Session defaults for local runs (tests, bench) and scratch-space lookup.

On a cluster the session comes from the platform; ``build_session`` is for
local runs only. Scratch space (landed pages, keyed tables, streaming
checkpoints) always lives under the cluster's shared checkpoint directory;
a private temporary directory is created only when none is configured, as in
tests.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(
    cores: int | None = None, app: str = "strata", extra_conf: dict | None = None
) -> SparkSession:
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("STRATA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Batch jobs: skip capturing the Python call site on every DataFrame
        # API call (several JVM round trips each; only enriches error text).
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def settings(spark: SparkSession, changed: Mapping[str, str]) -> Iterator[None]:
    """What is planned and run inside has these settings; the session's own are
    put back after. They choose plans and file formats, never results."""
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint directory named by the session.

    Reads ``spark.checkpoint.dir`` (or the SparkContext's checkpoint dir);
    only when neither is set — local runs — a private directory is created
    and registered so later calls agree.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # sessions without a SparkContext (e.g. Spark Connect)
        sc = None
    if not configured and sc is not None:
        configured = sc.getCheckpointDir()
    if not configured:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            # executors on other machines cannot see a driver-local folder
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="strata-ckpt-")
        # private to this process: nothing of it is needed after the process
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        if sc is not None:
            sc.setCheckpointDir(configured)
            configured = sc.getCheckpointDir() or configured
        else:
            spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh, unique directory under the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/strata/{purpose}-{uuid.uuid4().hex[:12]}"
