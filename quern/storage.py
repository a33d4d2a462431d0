"""Cuts of lineage that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one; Spark deletes what is written there when the driver ends."""
    _base(spark)
    context = spark.sparkContext
    path = f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def settled(df: DataFrame) -> DataFrame:
    """The rows as they are now, kept in the folder that ``spark.checkpoint.dir`` names: later plans read them and work nothing out anew.

    Where the setting is absent a local session gets a folder of its own; any other master
    is an error, because a machine-local folder would lose rows there.
    """
    _base(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """As ``settled``, in Parquet: for long rows, which take several times less room there."""
    path = shared(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _base(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(base or f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}")
