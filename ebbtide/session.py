"""Session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_announced: set[str] = set()

# Settings the plans are tuned for. A cluster overrides memory and parallelism;
# AQE then sizes the shuffle partitions from the data.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Scoring spends much CPU on little data: do not merge small partitions too far.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot leaves methods above 8000 bytes interpreted; wide projections are
    # better off split into small methods than fused into one huge one.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
}


def build(app: str = "ebbtide", master: str | None = None, **extra: str) -> SparkSession:
    """A session with this library's settings; ``extra`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it in ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver may fall back to a folder of
    its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="ebbtide-")
    spark.sparkContext.setCheckpointDir(folder)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _filesystem(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def run_folder(spark: SparkSession) -> str:
    """This run's own part of the shared folder. It is deleted when the driver ends; what
    is to stay is written elsewhere."""
    folder = f"{shared_folder(spark)}/ebbtide/{spark.sparkContext.applicationId}"
    if folder not in _announced:
        files, path = _filesystem(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _announced.add(folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the run's folder that nothing else uses."""
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete scratch data that no later result reads."""
    files, target = _filesystem(spark, path)
    files.delete(target, True)
