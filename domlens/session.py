"""SparkSession construction and shared-storage helpers.

Cluster jobs inherit their configuration from ``spark-submit``; ``get_session``
only fills in settings that are unset, so a cluster's own values (shuffle
partitions, checkpoint directory, ...) always win.
"""

from __future__ import annotations

import os
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

# Settings every job wants: adaptive re-planning (partition coalescing, skew-join
# splitting, runtime broadcast demotion), UTC wall clock, Arrow for the rare
# pandas boundary, and no web UI.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # nested domain records count every nested field; keep whole-stage codegen for them
    "spark.sql.codegen.maxFields": "2000",
    # a method beyond 8,000 bytes of code is never compiled by the JVM; such a stage runs faster operator by operator
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "domlens", master: str | None = None, **conf: str) -> SparkSession:
    """Return the active session, or build one with the defaults above.

    ``master`` is only for local runs and tests; on a cluster leave it unset.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        # respect what the cluster set; only pin the wall clock used by date features
        active.conf.set("spark.sql.session.timeZone", "UTC")
        return active
    wanted = dict(_DEFAULTS)
    if master and master.startswith("local"):
        wanted["spark.driver.memory"] = "12g"  # local mode: the driver JVM is the only executor
    wanted.update(conf)
    own = SparkConf(loadDefaults=False)
    for k, v in wanted.items():
        own.set(k, v)
    SparkContext._ensure_initialized(conf=own)  # starts the JVM unless spark-submit has
    given = {k for k, _ in SparkConf().getAll()} - set(conf)  # what spark-submit or the cluster's defaults set
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in wanted.items():
        if k not in given:
            builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and stage snapshots.

    Read from ``spark.checkpoint.dir`` (the cluster names a shared file system
    there).  Only when it is unset and the master is local -- tests -- fall back to a
    fresh folder under ``/tmp``; on a cluster an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = os.path.join("/tmp", f"domlens-ckpt-{uuid.uuid4().hex[:8]}")
        spark.conf.set("spark.checkpoint.dir", root)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder (never localCheckpoint)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=eager)


def ensure_parallelism(df, factor: int = 2):
    """Spread CPU-heavy row-local work over every core when the input has fewer
    partitions than the cluster's default parallelism (small inputs: one Parquet
    file is one split).  A large input already has more partitions than cores, so
    on a cluster this adds no shuffle (Spark cuts a scan into about as many pieces as
    there are cores until they reach ``maxPartitionBytes``).  Apply it to a plain scan:
    counting the partitions of a plan with exchanges would run those stages under AQE."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores * factor)
    return df
