"""SparkSession construction and cluster-shared lineage cutting."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session_conf(master: str | None = None, shuffle_partitions: int | None = None) -> dict[str, str]:
    """Settings of the engine: AQE on (coalesce + skew join), UTC, UI off.

    The number of shuffle partitions and the driver's memory belong to the deployment; they are set here for a
    ``local[...]`` master alone (or where the caller asks for a number of partitions).
    """
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),   # provably small sides only
    }
    if is_local(master):
        conf["spark.driver.memory"] = "16g"
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or os.environ.get("BENCH_CPUS") or 8)
    elif shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return conf


def is_local(master: str | None) -> bool:
    """One JVM on this machine (``local-cluster`` is not)."""
    return master is not None and (master == "local" or master.startswith("local["))


def get_spark(master: str | None = None, app: str = "riskloom",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Session with ``session_conf``. On a cluster ``master`` stays None (spark-submit decides)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (session_conf(master, shuffle_partitions) | (extra or {})).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and is read, never overridden; a session there without it is refused,
    since executors cannot read a folder of the driver's. Only on a ``local[...]`` master (unit tests) a private scratch
    folder stands in.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not is_local(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="riskloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Queries that are built and run in here leave no shuffle files behind (else they stay until the driver's JVM collects garbage).
    For steps whose results are checkpointed; a query that is run again makes its files again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), never ``localCheckpoint``."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
