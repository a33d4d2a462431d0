"""Forms that create and change users: what is asked of the store, and why a form is turned down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _or_null(text: str) -> Column:
    return F.when(F.col(text) != "", F.col(text))


def _differs(a: str, b: str) -> Column:
    return ~F.coalesce(F.col(a), F.lit("")).eqNullSafe(F.coalesce(F.col(b), F.lit("")))


def creations(forms: DataFrame, users: DataFrame) -> DataFrame:
    """(form_id, username, password, full_name, problem) for forms (form_id, is_admin, username, password, confirm, full_name).

    problem is forbidden (no admin), mismatch (the password isn't repeated) or taken (a user
    or an earlier good form has the name), tested in this order, or null. A blank full name
    is null; a null flag stands for no. Passwords go on as they were typed.
    """
    judged = forms.withColumn("problem", F.when(~F.coalesce("is_admin", F.lit(False)), "forbidden").when(_differs("password", "confirm"), "mismatch"))
    known = users.filter("username IS NOT NULL").select(F.col("username").alias("_u")).distinct()
    good = judged.filter("problem IS NULL")
    first = good.groupBy("username").agg(F.min("form_id").alias("_first")).withColumnRenamed("username", "_name")
    out = judged.join(known, F.col("username") == F.col("_u"), "left").join(first, F.col("username") == F.col("_name"), "left")
    taken = F.col("_u").isNotNull() | (F.col("form_id") > F.col("_first"))
    return out.select("form_id", "username", "password", _or_null("full_name").alias("full_name"), F.coalesce("problem", F.when(taken, "taken")).alias("problem"))


def updates(forms: DataFrame) -> DataFrame:
    """(form_id, user_id, full_name, is_active, password, problem) for forms (form_id, is_admin, by, user_id, username, password, confirm, full_name, is_active).

    problem is forbidden (no admin, and not the own row), mismatch (a new password isn't
    repeated) or null. A blank name or password is null and leaves the old one; is_active is
    an admin's to set, and null from others.
    """
    admin = F.coalesce("is_admin", F.lit(False))
    blank = F.coalesce("password", F.lit("")) == ""
    problem = F.when(~admin & ~F.col("username").eqNullSafe(F.col("by")), "forbidden").when(~blank & _differs("password", "confirm"), "mismatch")
    return forms.select("form_id", "user_id", _or_null("full_name").alias("full_name"), F.when(admin, F.col("is_active")).alias("is_active"), _or_null("password").alias("password"), problem.alias("problem"))
