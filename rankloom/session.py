"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
REMOVAL_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(app: str = "rankloom", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for tables that cut lineage.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a folder of this machine, because executors of a cluster could
    not read it after one of them is lost.
    """
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a shared folder before running on {context.master}")
    return _local_root(context.applicationId)


@cache
def _local_root(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"rankloom-{application}-")


def durable_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark)}/tables/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each action in here go when it ends; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(REMOVAL_KEY, "false")
    spark.conf.set(REMOVAL_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(REMOVAL_KEY, before)


def durable(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Later consumers see one fixed result even if executors are lost, the plan
    behind it is cut, the file sizes give the optimizer real statistics, and the shuffle files behind it are removed.
    """
    spark = df.sparkSession
    path = durable_path(spark, label)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a few input files out to all cores, for CPU-heavy work.

    Input with at least one file per core is left as it is, so large tables are
    never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
