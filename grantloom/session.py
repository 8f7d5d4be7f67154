"""Session settings the jobs are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "grantloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_ready(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.

    The shared folder named by the cluster in ``spark.checkpoint.dir`` is used.
    A private folder is created only on a local master, where driver and
    executors share one disk.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="grantloom-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share."""
    checkpoint_ready(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(rows: DataFrame) -> DataFrame:
    """Checkpointed rows.

    Writing a checkpoint evaluates the rows once to count and once to write; they are held meanwhile so
    the work is done once.
    """
    checkpoint_ready(rows.sparkSession)
    held = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint()
    finally:
        held.unpersist()
