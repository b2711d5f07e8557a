"""Session defaults and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

#: Rows of an Arrow batch.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def get_spark(app: str = "lexmill", master: str | None = None, partitions: int = 8, memory: str | None = None) -> SparkSession:
    """A session for local work: UTC, AQE on, few shuffle partitions. ``memory``: of the driver, before its JVM starts."""
    builder = SparkSession.builder.appName(app)
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    if master:
        builder = builder.master(master)
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed on them by other means.

    Texts are long, so Arrow batches of the default number of rows are cut to ``BATCH_ROWS``: buffers on both sides of a worker's
    pipe grow by doubling, and every core has some. A number that the session sets otherwise stays.
    """
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only in local mode, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found
