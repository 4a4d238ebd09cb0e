"""Lineage cuts: tables written into the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths written; modules travel to tasks by value, so no DataFrame may lie here.
_written: set[str] = set()
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local master may go without the setting (tests); it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="motionq-"))
    return "file://" + _own[0]


def fresh(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the process ends."""
    path = f"{shared_dir(spark)}/motionq-{uuid.uuid4().hex}"
    _written.add(path)
    return path


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of plans run inside are dropped as each ends: nothing reads them again."""
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        yield
    finally:
        spark.conf.set(clean, before)


def table(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as a table into the shared folder and read it again.

    Columnar and compressed, so smaller than a checkpoint; survives the loss of executors.
    """
    spark = df.sparkSession
    path = fresh(spark)
    with cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_path"] = path
    return out


def _delete(spark: SparkSession, paths) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _written.discard(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables (of ``table``) that no plan still to run reads."""
    for t in tables:
        path = t.__dict__.pop("_path", None)
        if path:
            _delete(t.sparkSession, [path])


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    try:
        _delete(spark, list(_written))
    except Exception:  # noqa: BLE001 - the session may be going down
        pass


def partitions(spark: SparkSession, least: int = 0) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), least)
