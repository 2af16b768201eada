"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM does not compile methods above 8000 bytes: longer generated stages run
    # faster as separate operators than interpreted as one method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


# Shuffle bytes per task: several tasks fit an executor's memory, and tasks stay many.
_TASK_BYTES = 256 * 1024 * 1024


def sized_for(shuffle_bytes: int) -> dict[str, str]:
    """Settings for jobs that shuffle about this much; AQE joins partitions that turn out small."""
    partitions = max(8, -(-shuffle_bytes // _TASK_BYTES))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(_TASK_BYTES),
        "spark.sql.files.maxPartitionBytes": str(_TASK_BYTES),
    }


def build_session(app: str = "lakesmith", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators are written for (zone UTC, AQE on)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new path for intermediate tables, below the shared folder of the cluster.

    The folder is the session's ``spark.checkpoint.dir``. Only a local-mode
    session may fall back to a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="lakesmith-")
    return os.path.join(base, f"{label}-{uuid.uuid4().hex}")
