"""Shared plumbing of the operators: tables in the shared folder, Arrow columns, batch sizes."""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that goes to Python. Texts are long, so the default of 10,000 rows would hold too much.
ROWS_PER_BATCH, BYTES_PER_BATCH = 1000, 64 << 20
#: Rows of a few longs that a task takes where a table's size is known: small tables needn't go through as many tasks as large ones.
ROWS_PER_TASK = 50_000


def tuned(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches that suit whole texts: whichever bound is met first ends one. Read when a plan runs, so it stays set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))
    return spark


class Workspace:
    """Tables that cut lineage, in a folder all executors share.

    The folder is the one named in ``spark.checkpoint.dir``. Where it is unset, a local
    session gets one of its own; any other master is an error, because a machine-local
    folder would lose data there. Files go when they are dropped or when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file:///tmp/checkpoints"
        self.spark = tuned(spark)
        self.root = f"{base.rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"
        self._fs().deleteOnExit(self._path(self.root))
        self._n = 0

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, rows: int = 0) -> DataFrame:
        """Write a table and read it back: recovery needs the files alone. rows: about how many it has, if known; a task writes ROWS_PER_TASK of them or so."""
        if rows:
            df = df.coalesce(-(-rows // ROWS_PER_TASK))
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quern_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that no later plan reads, and let Spark see that the shuffles behind them are over.

        Spark deletes shuffle files once the driver has collected the plans that own them,
        which may otherwise take until the job's end.
        """
        for t in tables:
            self._fs().delete(self._path(t._quern_path), True)
        if self.spark.sparkContext.master.startswith("local["):
            return
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two long columns that name a record: its id (null: the least long) and a hash of its text.

    Rows that repeat in both get the same key; they are the same record, told apart nowhere.
    """
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"),
    ]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and the n + 1 offsets of its rows. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]
