"""Named queries that read a table as a stream, until all of it has been read, with SQL for the rows that it must have given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.catalog import query, table
from quern.storage import shared
from quern.streaming import sessions, upkeep


def _stream(spark: SparkSession, sf_dir: str, name: str, files: int = 0) -> DataFrame:
    """The table's files as a stream; the pattern lets a single file stand for a folder."""
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(f"{sf_dir}/{name}.parque[t]")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _turns(stream: DataFrame) -> DataFrame:
    """Turns have no time of their own: minutes after a start that goes by the conversation, further apart the later the turn."""
    minutes = F.col("conv_id") * 3 + F.col("turn") * F.col("turn") * 5
    return stream.withColumn("time", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)))


def _done(result: DataFrame, name: str) -> DataFrame:
    spark = result.sparkSession
    path = shared(spark, name)
    sessions.written(result, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{path}/out")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL),
n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
s AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM n GROUP BY user_id, k)
SELECT user_id, start, "end", n FROM s WHERE "end" <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 HOUR""")
def t1_sessions(spark, sf_dir):
    """Sessions of users that the watermark has closed."""
    return _done(sessions.sessions(_events(spark, sf_dir), "ts", "12 hours", "1 hour", "user_id"), "sessions")


@query("""WITH w AS (SELECT event_type, unnest([date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts)]) AS start FROM events WHERE ts IS NOT NULL)
SELECT event_type, start, start + INTERVAL 2 DAY AS "end", count(*) AS n FROM w GROUP BY event_type, start HAVING start + INTERVAL 2 DAY <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 DAY""")
def t1_sliding(spark, sf_dir):
    return _done(sessions.sliding(_events(spark, sf_dir), "ts", "2 days", "1 day", "1 day", "event_type"), "sliding")


_MINUTES = "to_minutes(conv_id * 3 + turn * turn * 5)"


@query(f"""WITH t AS (SELECT conv_id, turn, TIMESTAMP '2024-01-01 00:00:00' + {_MINUTES} AS time FROM conversations),
e AS (SELECT conv_id, time, CASE WHEN time <= lag(time) OVER (PARTITION BY conv_id ORDER BY time) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM t WHERE time IS NOT NULL),
n AS (SELECT conv_id, time, sum(new) OVER (PARTITION BY conv_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS k FROM e),
s AS (SELECT conv_id, min(time) AS start, max(time) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM n GROUP BY conv_id, k)
SELECT conv_id, start, "end", n FROM s WHERE "end" <= (SELECT max(time) FROM t) - INTERVAL 1 HOUR""")
def t1_conversation_sessions(spark, sf_dir):
    return _done(sessions.sessions(_turns(_stream(spark, sf_dir, "conversations")), "time", "30 minutes", "1 hour", "conv_id"), "conversations")


@query("SELECT conv_id, count(*) AS turns, max(turn) AS last_turn, count(*) FILTER (role = 'user') AS questions FROM (SELECT DISTINCT conv_id, turn, role FROM conversations) AS t GROUP BY conv_id")
def t2_kept_lists(spark, sf_dir):
    """A list of conversations kept up by a stream that brings every row twice; repeats count once."""
    path = shared(spark, "lists")
    rows = _stream(spark, sf_dir, "conversations").union(_stream(spark, sf_dir, "conversations")).select("conv_id", "turn", "role")
    work_out = lambda own: own.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"), F.count_if(F.col("role") == "user").alias("questions"))
    upkeep.keep(rows, path, f"{path}/state", ["conv_id"], ["conv_id", "turn", "role"], work_out, 16).awaitTermination()
    return upkeep.lists(spark, path)
