"""Session helper for scripts, tests and the bench; a cluster job brings its own session."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(app: str = "huskwatch", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.ui.enabled", "false"))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if "SPARK_DRIVER_MEMORY" in os.environ:
        builder = builder.config("spark.driver.memory", os.environ["SPARK_DRIVER_MEMORY"])
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """A new folder below the shared one that the cluster names in spark.checkpoint.dir.

    Without that setting a local master gets a temporary folder; on a cluster, where executors do not see each other's
    disks, it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/huskwatch-{uuid.uuid4().hex}"
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return tempfile.mkdtemp(prefix="huskwatch-ckpt-")
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
