"""Cutting lineage in loops: a written table in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where that is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-engine-"))


def settled(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_states(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """Name, length and time of a file, or of the files of a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)))
