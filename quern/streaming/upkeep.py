"""Lists kept up to date as rows come in: a batch works out anew only the keys it touches.

Rows go to a log, one folder for each batch; a list table has a version of each bucket of
keys. A batch reads the touched buckets of the log, works out the touched keys, takes the
other keys of those buckets from their last version, and writes both as the bucket's next
version. Other buckets are not read or written. Every folder is written by one batch only and
a batch reads versions before its own, so a batch that is run again after a failure writes the
same once more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.storage import settled


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _newest(lists: DataFrame) -> DataFrame:
    """Only the last version of each bucket; at most as many rows as buckets are broadcast."""
    return lists.join(F.broadcast(lists.groupBy("bucket").agg(F.max("batch").alias("batch"))), ["bucket", "batch"])


def apply(batch: DataFrame, number: int, path: str, keys: list[str], unique: list[str], work_out: Callable[[DataFrame], DataFrame], buckets: int) -> None:
    """One batch. Rows that agree in ``unique`` count once, however far apart they come; ``work_out`` makes the list rows, with the keys, of all rows of some keys."""
    spark = batch.sparkSession
    rows = settled(batch.withColumn("bucket", _bucket(keys, buckets)))
    if rows.isEmpty():
        return
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/log/batch={number}")
    touched = rows.select(*keys).distinct()
    own = [r[0] for r in rows.select("bucket").distinct().collect()]
    log = spark.read.parquet(f"{path}/log").filter(F.col("batch") <= number).filter(F.col("bucket").isin(own))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    due = log.alias("l").join(touched.alias("t"), same, "left_semi").dropDuplicates(unique).drop("batch", "bucket")
    fresh = work_out(due).withColumn("bucket", _bucket(keys, buckets))
    if _exists(spark, f"{path}/lists"):
        old = spark.read.parquet(f"{path}/lists").filter(F.col("batch") < number).filter(F.col("bucket").isin(own))
        fresh = fresh.unionByName(_newest(old).alias("l").join(touched.alias("t"), same, "left_anti").drop("batch"))
    fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/lists/batch={number}")


def keep(stream: DataFrame, path: str, checkpoint: str, keys: list[str], unique: list[str], work_out: Callable[[DataFrame], DataFrame], buckets: int = 64) -> StreamingQuery:
    """Keeps the lists of a stream's keys in ``path`` until all that is there has been read. See ``apply``."""

    def write(batch: DataFrame, number: int) -> None:
        apply(batch, number, path, keys, unique, work_out, buckets)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lists(spark: SparkSession, path: str) -> DataFrame:
    """The lists as the last batch left them."""
    return _newest(spark.read.parquet(f"{path}/lists")).drop("batch", "bucket")


def compact(spark: SparkSession, path: str) -> int:
    """Deletes versions of buckets that later ones have replaced, and says how many. Not while a batch runs.

    The last batch may not have been committed and run again, so what it started from stays.
    """
    have = spark.read.parquet(f"{path}/lists").select("batch", "bucket").distinct()
    top = have.agg(F.max("batch")).first()[0]
    last = have.filter(F.col("batch") < top).groupBy("bucket").agg(F.max("batch").alias("last"))
    old = have.join(last, "bucket").filter("batch < last").collect()  # numbers of folders
    for r in old:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/lists/batch={r['batch']}/bucket={r['bucket']}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return len(old)
