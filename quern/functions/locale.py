"""Languages: which one a reader gets, and which of several rows is in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import blank_to

#: Fixed value.
DEFAULT = "en"


def resolve(cookie: Column) -> Column:
    return blank_to(cookie, DEFAULT)


def catalogue(cookie: Column) -> Column:
    """Texts exist in two languages: vi if that is asked for, else en."""
    return F.when(cookie == "vi", "vi").otherwise(DEFAULT)


def prefer(df: DataFrame, lang: str, key: str = "slug", lang_col: str = "lang", id_col: str = "id") -> DataFrame:
    """One row for each key: the least id in that language, else the least id."""
    order = [(F.col(lang_col).eqNullSafe(lang)).desc(), F.col(id_col)]
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def translate(df: DataFrame, messages: DataFrame, lang: str, key: str = "key") -> DataFrame:
    """df with ``text``: the message of its key in that language, or the key. messages: locale, key, text; one row for each locale and key."""
    own = messages.filter(F.col("locale") == lang).select(F.col("key").alias(key), "text")
    return df.join(own, key, "left").withColumn("text", F.coalesce("text", F.col(key)))
