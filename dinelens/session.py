"""Spark session defaults for local runs and tests.

On a cluster the session comes from the launcher; ``configure`` only sets
what is unset (``spark.checkpoint.dir`` in particular is read from the
session and set only when missing).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture for error messages costs several JVM round trips
    # per column function while a plan is being built; off for services
    # that build many plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "dinelens") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("DINELENS_DRIVER_MEMORY", "8g"))
    )
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only when the session names none, ``fallback`` is set (tests, local runs);
    without one this raises instead of using a machine-local folder.
    """
    current = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    path = current or fallback
    if not path:
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a shared folder (HDFS/object store) "
            "so checkpoints survive the loss of an executor"
        )
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder's path that the driver and all executors share.

    Under ``spark.checkpoint.dir``; where that is unset, a local session (one
    machine, one JVM) gets a temporary folder and any other master an error.
    """
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        local = master.startswith("local") and not master.startswith("local-cluster")
        base = checkpoint_dir(spark, "file://" + tempfile.mkdtemp(prefix="dinelens-shared-") if local else None)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
