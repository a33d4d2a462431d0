"""Who may see and change what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Which roles see which tab ("*": all), which readers there are, and which verbs need a user.
TABS = {"faq": "*", "users": "*", "logs": "*", "rules": "admin", "config": "admin"}
ROLES = ("student", "teacher", "business")
VERBS = {"create": True, "delete": True, "read": False, "update": True}


def may(verb: str, user: str | None, preview: bool = False) -> bool:
    """Reading is open to anyone; a preview overrides."""
    return preview or not VERBS[verb] or user is not None


def allowed(verb: Column, signed_in: Column, preview: Column) -> Column:
    """``may`` for a table of requests. An unknown verb is not allowed; null stands for no."""
    needs = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in VERBS.items() for x in pair]), verb), F.lit(True))
    known = F.coalesce(verb.isin(*VERBS), F.lit(False))
    no = F.lit(False)
    return F.coalesce(preview, no) | (known & (~needs | F.coalesce(signed_in, no)))


def visible_users(df: DataFrame, username: str | None, is_admin: bool) -> DataFrame:
    """An admin sees all rows, another user the own one, nobody none."""
    if is_admin:
        return df
    return df.filter(F.col("username") == username) if username else df.filter(F.lit(False))


def permissions(df: DataFrame, username: str | None, is_admin: bool) -> DataFrame:
    """df with can_edit (an admin: everyone; others: themselves) and can_delete (an admin: whose role isn't "admin", as it stands)."""
    own = F.coalesce(F.col("username") == username, F.lit(False)) if username else F.lit(False)
    return df.withColumn("can_edit", F.lit(True) if is_admin else own).withColumn("can_delete", F.lit(is_admin) & ~F.col("role").eqNullSafe("admin"))


def own_row(me: DataFrame) -> DataFrame:
    """The signed-in user as a row of the user table; when it was made is not told."""
    return me.select("id", "username", "full_name", "is_active", F.lit(None).cast("timestamp").alias("created_at"), "role")


def known_role(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).isin(*ROLES)


def masked(df: DataFrame) -> DataFrame:
    """What a list of users shows: no password, a hyphen for what is missing."""
    return df.withColumn("password", F.lit("******")).withColumn("full_name", F.coalesce(F.nullif("full_name", F.lit("")), F.lit("-")))


def tab_open(tab: Column, role: Column) -> Column:
    rule = F.try_element_at(F.create_map(*[F.lit(x) for pair in TABS.items() for x in pair]), tab)
    return F.coalesce((rule == "*") | (rule == F.lower(role)), F.lit(False))


def menu_active(path: Column, links: Column, prefixes: list[str]) -> Column:
    out = F.exists(links, lambda x: x == path)
    for p in prefixes:
        out = out | path.startswith(p)
    return out
