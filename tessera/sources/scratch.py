"""Folders that the driver and all executors share, for tables that cut a lineage and for stores that a query builds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode without one, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def release(spark: SparkSession) -> None:
    """Deletes what this session has put in the shared folder; call it once the results are written."""
    for owner, path in [x for x in _made if x[0] is spark]:
        delete(spark, path)
        _made.remove((owner, path))


def file_system(spark: SparkSession, root: str):
    """Hadoop's file system of a folder, and its Path class."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def delete(spark: SparkSession, where: str) -> None:
    fs, path = file_system(spark, where)
    fs.delete(path(where), True)


def names(spark: SparkSession, where: str) -> list[str]:
    """The names in a folder, sorted; none if it isn't there."""
    fs, path = file_system(spark, where)
    return sorted(f.getPath().getName() for f in fs.listStatus(path(where))) if fs.exists(path(where)) else []


class Stage:
    """Tables written by the steps of an iteration; each step's table is deleted once the next one stands."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, new_path(spark, name), 0

    def __call__(self, df: DataFrame) -> DataFrame:
        """df written to the shared folder and read again."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_at = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            delete(self.spark, df._staged_at)
