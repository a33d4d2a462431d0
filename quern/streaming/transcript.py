"""Append-only streams: transcripts as they grow, and pages that became due."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "conv_id long, turn long, role string, text string"


def turns(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def append(stream: DataFrame, path: str, checkpoint: str, key: tuple[str, ...] = ("conv_id", "turn")) -> StreamingQuery:
    """Appends turns to a Parquet table, partitioned by ``batch``; stops when what is there has been read.

    Repeats inside a batch go, and no state is kept for it. A batch that is run again after a
    failure replaces its own partition, so each turn is written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(list(key)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(stream: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Rows in each window of time and type of event; rows later than ``late`` are dropped. An extension: the content site has no streams."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"))
