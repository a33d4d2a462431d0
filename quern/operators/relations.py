"""Lookups: media of a document, children in their parent, fixed dictionaries.

No side is broadcast by hand: Spark does that by itself where it knows a side to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import menu_title, trim


def with_media(df: DataFrame, media: DataFrame, column: str, title: str | None = None) -> DataFrame:
    """df with media_url and media_caption of the id in column, null where it is unresolved; with a title, '' and the title instead."""
    own = media.select(F.col("id").alias("_media"), F.col("url").alias("media_url"), F.col("caption").alias("media_caption"))
    out = df.join(own, F.col(column) == F.col("_media"), "left").drop("_media")
    if title:
        out = out.withColumn("media_url", F.coalesce("media_url", F.lit(""))).withColumn("media_caption", F.coalesce("media_caption", F.col(title)))
    return out


def nested(parents: DataFrame, children: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """parents with an array of their children, sorted; empty where there are none. Children of one parent are one row's worth, the variants of a question; ``joined`` has no such bound."""
    own = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in children.columns if c not in (key, order)]))).alias(name))
    return parents.join(own, key, "left").withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))


def joined(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """A row for each child beside its parent, and one for a parent without any: what ``spread`` makes of ``nested``, with no group ever held whole."""
    return parents.join(children, key, "left")


def spread(parents: DataFrame, name: str) -> DataFrame:
    return parents.select("*", F.explode_outer(name).alias("_child")).drop(name).select("*", "_child.*").drop("_child")


def edited(rows: DataFrame, edits: DataFrame, key: str, column: str) -> DataFrame:
    """rows with column from edits where they have one; edits: key, column."""
    new = edits.select(key, F.col(column).alias("_new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_new", F.col(column))).drop("_new")


def upsert(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows with the changes' values where those are not null, and the changes' new keys. Writes a new table, never in place."""
    mine, theirs = rows.alias("r"), changes.alias("c")
    both = mine.join(theirs, F.col(f"r.{key}") == F.col(f"c.{key}"), "full_outer")
    return both.select(*[F.coalesce(F.col(f"c.{c}"), F.col(f"r.{c}")).alias(c) if c in changes.columns else F.col(f"r.{c}") for c in rows.columns])


def insert(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """rows and the new ones whose key is not taken; a column they lack is null."""
    fresh = new.join(rows.select(key), key, "left_anti")
    return rows.unionByName(fresh, allowMissingColumns=True)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def lookup(c: Column, table: dict[str, str], other: str | None = None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)
    return F.coalesce(found, F.lit(other)) if other is not None else found


def slots(df: DataFrame, order: list[Column], most: int, key: str | None = None) -> DataFrame:
    """The first ``most`` rows with position (from 1), total and slot: "only", "main" (the first of most or more), "sub" or "item"."""
    keys = [key] if key else []
    if key:
        out = df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("position") <= most)
    else:  # a top-k first: what is numbered in one task is a page
        out = df.orderBy(*order).limit(most).withColumn("position", F.row_number().over(Window.orderBy(*order)))
    out = out.withColumn("total", F.count("*").over(Window.partitionBy(*keys)))
    return out.withColumn("slot", F.when(F.col("total") == 1, "only").when(F.col("total") < most, "item").when(F.col("position") == 1, "main").otherwise("sub"))


def menu(df: DataFrame) -> DataFrame:
    """slug and title for a menu: slugs are trimmed, rows with a blank one go, a blank title gives way to the slug."""
    return df.select(trim(F.coalesce("slug", F.lit(""))).alias("slug"), menu_title(F.col("title"), F.col("slug")).alias("title")).filter("slug <> ''")


def by_source(df: DataFrame) -> DataFrame:
    """Videos with only the field that their source uses: an uploaded file or an outside address."""
    return df.withColumn("videoFile", F.when(F.col("source") == "upload", F.col("videoFile"))).withColumn("externalUrl", F.when(F.col("source") == "external", F.col("externalUrl")))


def of_year(df: DataFrame, year: int | str = "All") -> DataFrame:
    """Rows of that year, newest first with ties by id; "All" passes every year."""
    return (df if year == "All" else df.filter(F.col("year") == year)).orderBy(F.desc("year"), "id")
