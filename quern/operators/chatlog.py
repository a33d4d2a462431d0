"""The chat log: filtered pages, retention, and export."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import csv_field, moment
from quern.operators import ranks
from quern.operators.faq import DAYS, search
from quern.plans.find import Find
from quern.plans.paging import SIZES
from quern.storage import settled

#: Fixed value: the header of an export.
HEADER = ("Câu hỏi", "Loại quyết định", "Trả lời", "Thời gian")


_TOP = "\ufeff" + ",".join(f'"{h}"' for h in HEADER)


def matching(df: DataFrame, keyword: str = "", decision: str = "") -> DataFrame:
    out = search(df, keyword, ("ask", "answer"))
    return out.filter(F.col("decistion_type") == decision) if decision else out


def listing(df: DataFrame, keyword: str = "", decision: str = "", newest_first: bool = True, page: int = 1, size: int = SIZES[0], id_col: str = "id") -> DataFrame:
    """A page of the log by time: filtered first, then sorted and cut."""
    return Find({}, "-timestamp" if newest_first else "timestamp", size, page, id_col=id_col).run(matching(df, keyword, decision))


def retained(df: DataFrame, column: str, as_of: Column, days: int) -> DataFrame:
    """Rows not older than so many days at as_of."""
    if not DAYS[0] <= days <= DAYS[1]:
        raise ValueError(f"days must be {DAYS[0]} to {DAYS[1]}")
    return df.filter(F.col(column) >= as_of - F.expr(f"make_interval(0, 0, 0, {days})"))


def csv_lines(df: DataFrame, *keep: str) -> DataFrame:
    """One ``line`` for each row, every field quoted, beside the columns to keep."""
    return df.select(*keep, F.concat_ws(",", *[csv_field(c) for c in (F.col("ask"), F.col("decistion_type"), F.col("answer"), moment(F.col("timestamp")))]).alias("line"))


def csv_text(page: DataFrame, order: Column) -> str:
    """A loaded page as one CSV text: byte-order mark, header, CRLF. A page has at most 500 rows and ends up in the caller's hands."""
    rows = csv_lines(page.orderBy(order)).collect()
    return "\r\n".join([_TOP, *[r["line"] for r in rows]])


def export(df: DataFrame, path: str, *order: Column) -> None:
    """A whole log as text files whose bytes, by file name one after the other, are the one CSV text of ``csv_text``.

    Rows are dealt out by range, so files are written in parallel and in order; only the
    first one has the byte-order mark and the header. Rows that tie in the order come in
    any order. A spreadsheet's export is the same text under another name.
    """
    placed = ranks.numbered(df.select("ask", "decistion_type", "answer", "timestamp"), *order, name="_rank")
    lines = csv_lines(placed, "_rank")
    before = F.when(F.col("_rank") == 0, F.lit(_TOP + "\r\n")).otherwise(F.lit("\r\n"))
    # Every line ends with a quote. That quote is what the writer puts behind a line, so that none has a line end behind it.
    text = lines.select(F.concat(before, F.expr("left(line, length(line) - 1)")).alias("value"))
    if df.isEmpty():
        text = df.sparkSession.range(1).select(F.lit(_TOP[:-1]).alias("value")).coalesce(1)
    text.write.option("lineSep", '"').text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A whole log as CSV files, each with the header, in parallel: quoted fields, null as an empty text, times as in ``csv_text``."""
    named = [c.alias(h) for c, h in zip((F.col("ask"), F.col("decistion_type"), F.coalesce("answer", F.lit("")), moment(F.col("timestamp"))), HEADER, strict=True)]
    df.select(*named).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def store(df: DataFrame, path: str, column: str = "timestamp") -> None:
    """Appends rows to a log laid out by day of their time; rows without a time have a folder of their own."""
    df.withColumn("day", F.to_date(column)).write.mode("append").partitionBy("day").parquet(path)


def trim_store(spark: SparkSession, path: str, as_of: datetime, days: int, column: str = "timestamp") -> int:
    """``retained`` for a stored log: whole days go as folders, the day of the edge is written anew, later days aren't touched. Says how many folders went.

    Rows without a time go, as in ``retained``. A run that is cut off before the edge day's
    files change places can be run again; that change is Spark's commit of the one write.
    The names of days, one each, go through the driver.
    """
    if not DAYS[0] <= days <= DAYS[1]:
        raise ValueError(f"days must be {DAYS[0]} to {DAYS[1]}")
    edge = as_of - timedelta(days=days)
    log = spark.read.parquet(path)
    have = [r["day"] for r in log.select("day").distinct().collect()]
    own = log.filter(F.col("day") == F.lit(edge.date()))
    left = settled(retained(own, column, F.lit(as_of), days))
    empty = left.isEmpty()
    gone = [d for d in have if d is None or d < edge.date() or (d == edge.date() and empty)]
    if not empty and left.count() < own.count():
        left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    for d in gone:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/day={d or '__HIVE_DEFAULT_PARTITION__'}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return len(gone)
