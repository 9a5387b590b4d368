"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """Session for tests and for measuring on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("snapfold")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can read, named by ``spark.checkpoint.dir``.

    Only a local session, where it is unset, gets a temporary folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="snapfold-"))
    return context.getCheckpointDir().rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new sub-folder name in the shared folder."""
    return f"{shared_folder(spark)}/snapfold-{name}-{uuid.uuid4().hex}"
