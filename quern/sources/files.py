"""Reading and writing: typed Parquet collections, JSON, question imports in CSV, media metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import parse_int, trim
from quern.schemas import CHAT, COLLECTIONS
from quern.storage import settled

_COLUMNS = ("answer_id", "category", "type", "content", "answer")


def collection(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(COLLECTIONS.get(name) or CHAT[name]).parquet(path)


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one array of records."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_each(texts: DataFrame, path: str) -> None:
    """Each row of a text column as a file of its own, all in one new folder.

    As many tasks as a shuffle has parts write them, however few bytes they are, and put
    them in place themselves; a folder for each file, or the driver moving one after the
    other, would cost several times as much as the files. A task writes up to a million.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts.repartition(parts).write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)


def media_files(spark: SparkSession, path: str) -> DataFrame:
    """Names, sizes and times of files; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def cells(line: Column) -> Column:
    """The cells of a CSV line as the editor reads them: a quote switches commas off or on and vanishes; cells are trimmed."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',((?:[^",]++|"[^"]*+(?:"|\z))*+)'), F.lit(1))
    return F.transform(found, lambda x: trim(F.replace(x, F.lit('"'), F.lit(""))))


def import_rows(text: Column) -> Column:
    """array<struct> of an import's rows, in order. Line 1 is the header, whatever it holds; a later header of a name wins.

    Lines end records. Blank lines go, and so do rows without content or type. Missing cells
    are empty, extra ones are not read.
    """
    lines = F.split(text, "\r?\n")
    header = F.reverse(F.transform(cells(F.get(lines, F.lit(0))), F.lower))

    def row(line: Column) -> Column:
        own = cells(line)
        cell = lambda c: F.when(F.array_contains(header, c), F.coalesce(F.get(own, F.size(header) - F.array_position(header, c).cast("int")), F.lit(""))).otherwise("")
        return F.struct(*[cell(c).alias(c) for c in _COLUMNS])

    rest = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), lambda x: trim(x) != "")
    return F.filter(F.transform(rest, row), lambda r: (r["content"] != "") & (r["type"] != ""))


def faq_import(spark: SparkSession, path: str) -> DataFrame:
    """Imports of questions in CSV as the editor reads them: file, idx, answer_id, category, type, content, answer.

    A file is one upload of a person and is read whole; many files are read in parallel.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), import_rows(F.col("value")).alias("rows"))
    raw = files.select("file", F.posexplode("rows").alias("idx", "row")).select("file", "idx", "row.*")
    return raw.withColumn("answer_id", parse_int(F.col("answer_id"), 0))


def faq_standard(spark: SparkSession, path: str) -> DataFrame:
    """The same columns by the CSV standard: doubled quotes, line ends inside quotes."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = df.toDF(*[c.lstrip("﻿").strip().lower() for c in df.columns])
    df = df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in _COLUMNS])
    return df.filter("content <> '' AND type <> ''").withColumn("answer_id", parse_int(F.col("answer_id"), 0))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, record): the records of CSV files of any size, numbered from 0 in each file, with line ends inside quotes kept.

    Files are read by splits. Whether a line begins inside quotes is told by the number of
    quotes before it, odd or even: each split counts its own, one row a split is summed up,
    and a line adds what its split has had so far. A line that begins outside and has an
    even number of quotes is a record by itself; only lines of longer records are brought
    together. A quote that is never closed makes the rest of its file one record. Blank
    lines between records are none; a carriage return before a line end goes.
    """
    where = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    lines = spark.read.option("lineSep", "\n").text(path).select(where.alias("w"), F.monotonically_increasing_id().alias("at"), "value").select("w.file", "w.split", "at", "value")
    lines = settled(lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"')))))
    along = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("here", F.coalesce(F.sum("quotes").over(along), F.lit(0)))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    split = lines.groupBy("file", "split").agg(F.sum("quotes").alias("q")).select("file", "split", F.coalesce(F.sum("q").over(before), F.lit(0)).alias("earlier"))
    lines = lines.join(split, ["file", "split"]).withColumn("starts", (F.col("here") + F.col("earlier")) % 2 == 0)
    lines = settled(lines.filter(~F.col("starts") | (F.col("quotes") > 0) | (trim(F.col("value")) != "")).select("file", "split", "at", "value", "quotes", "starts"))
    count = F.sum(F.col("starts").cast("long"))
    first = lines.groupBy("file", "split").agg(count.alias("c")).select("file", "split", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("earlier"))
    own = count.over(Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    numbered = lines.withColumn("here", own).join(first, ["file", "split"]).withColumn("n", F.col("here") + F.col("earlier") - 1)
    alone = F.col("starts") & (F.col("quotes") % 2 == 0)
    long = numbered.filter(~alone).groupBy("file", "n").agg(F.array_sort(F.collect_list(F.struct("split", "at", "value"))).alias("own"))
    long = long.select("file", "n", F.array_join("own.value", "\n").alias("record"))
    every = numbered.filter(alone).select("file", "n", F.col("value").alias("record")).unionByName(long)
    return every.withColumn("record", F.regexp_replace("record", "\r$", ""))


def standard_cells(record: Column) -> Column:
    """The cells of a record by the standard: doubled quotes stand for one, white space stays."""
    found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(r',("(?:[^"]++|"")*+"|[^,]*+)'), F.lit(1))
    return F.transform(found, lambda x: F.when(x.startswith('"'), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x))


def faq_large(spark: SparkSession, path: str) -> DataFrame:
    """``faq_standard`` for files that one task can't hold: (file, idx, answer_id, category, type, content, answer), idx the number of the record in its file. Each file has its own header; a later column of a name wins."""
    every = settled(records(spark, path))
    heads = every.filter("n = 0").select("file", F.reverse(F.transform(standard_cells(F.replace("record", F.lit("\ufeff"), F.lit(""))), lambda x: F.lower(trim(x)))).alias("header"))
    rows = every.filter("n > 0").join(heads, "file").withColumn("own", standard_cells(F.col("record")))
    cell = lambda c: F.when(F.array_contains("header", c), F.get("own", F.size("header") - F.array_position("header", c).cast("int")))
    out = rows.select("file", F.col("n").alias("idx"), *[F.coalesce(cell(c), F.lit("")).alias(c) for c in _COLUMNS])
    return out.filter("content <> '' AND type <> ''").withColumn("answer_id", parse_int(F.col("answer_id"), 0))
