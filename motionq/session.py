"""A SparkSession with the settings the engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "motionq", shared: str | None = None) -> SparkSession:
    """The session; ``shared`` is the folder all executors share (``spark.checkpoint.dir``), where the cluster doesn't name one."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.files.maxPartitionBytes": "128m",
    }
    if shared:
        conf["spark.checkpoint.dir"] = shared
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=conf).getOrCreate()
