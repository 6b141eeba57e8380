"""The folder that driver and executors share, and small files in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's path below spark.checkpoint.dir. Unset, a local session gets one of its own; a cluster must set it. The folder goes when the JVM ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    fs, at = _place(spark, path)
    fs.deleteOnExit(at)
    return path


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, such as a rule pack, written by the driver."""
    fs, at = _place(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def materialised(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: its lineage ends there. llm/common.py has the same for itself, as neither part imports the other."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
