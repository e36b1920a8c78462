"""Results written once in the folder that all executors share, and read back."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where driver and executors are one process
    (tests, local mode) may it be unset: a folder on this machine is used then."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = Path(tempfile.gettempdir(), "lexiflow-checkpoints").as_uri()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder by Hadoop's file system, which knows every store."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet and read back, and its path.

    Cuts the lineage: a lost executor costs a re-read, not the stages before;
    and the size of what was written is known, so that Catalyst broadcasts it
    only if it is small.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def spread(df: DataFrame, bytes_each: int = 32 << 20) -> DataFrame:
    """A table of a few files dealt to all cores before costly work per row.

    A file of one row group is one task, however many cores there are. Tables
    of more than ``bytes_each`` per core have splits enough and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * bytes_each else df
