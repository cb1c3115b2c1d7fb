"""Session plumbing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reach_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers that share this file system import the package from where the driver did,
    whatever their working folder is. On a cluster without a shared checkout the package is sent
    with ``--py-files``; the extra entry does no harm there."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares (``spark.checkpoint.dir``). Only a local
    master may do without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no shared folder")
        root = tempfile.mkdtemp(prefix="quakeframe-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to and read from a table in the folder that the cluster shares: no lineage is left,
    and no size estimate, which a checkpoint would keep and rounds of joins would multiply."""
    folder = shared_folder(df.sparkSession, "cut")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder made by ``shared_folder`` that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the files of a query's shuffles go when it ends, not when the driver's heap is full. For queries
    whose results are written, as those of ``cut``."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
