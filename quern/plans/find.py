"""Finds: one declarative description of a filtered, sorted, paged read, turned into a DataFrame.

Filters and column selection reach the Parquet scan; a sorted page is one top-k, never a full
sort. Sorting is always made total by the id.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import contains_fold


def condition(column: Column, op: str, value: Any) -> Column:
    """One predicate. ``like`` asks for every word of the value, in any order and case; ``contains`` for the value as it stands."""
    if op == "equals":
        return column == value
    if op == "not_equals":
        return column != value
    if op == "in":
        return column.isin(*value) if value else F.lit(False)
    if op == "greater_than":
        return column > value
    if op == "contains":
        return contains_fold(column, value)
    if op == "like":
        out = F.lit(True)
        for word in value.split():
            out = out & contains_fold(column, word)
        return out
    raise ValueError(f"unknown operator {op}")


@dataclass(frozen=True)
class Find:
    """where: {column: {operator: value}}, all of which must hold. sort: column, with - for descending.

    published: rows of a table with ``_status`` that are drafts go (null counts as published).
    limit: rows of a page, None for all. page: from 1. An unknown sort column is left out.
    """

    where: dict[str, dict[str, Any]] = field(default_factory=dict)
    sort: str | None = None
    limit: int | None = None
    page: int = 1
    published: bool = False
    columns: tuple[str, ...] | None = None
    id_col: str = "id"

    def matching(self, df: DataFrame) -> DataFrame:
        for name, tests in self.where.items():
            for op, value in tests.items():
                if value is None or isinstance(value, str) and not value:  # a parameter that wasn't given
                    continue
                df = df.filter(condition(F.col(name), op, value))
        if self.published and "_status" in df.columns:
            df = df.filter(F.coalesce("_status", F.lit("published")) == "published")
        return df

    def order(self, df: DataFrame) -> list[Column]:
        name = (self.sort or "").lstrip("-")
        if name not in df.columns:
            return [F.col(self.id_col).asc()]
        return [F.col(name).desc() if self.sort.startswith("-") else F.col(name).asc(), F.col(self.id_col).asc()]

    def run(self, df: DataFrame) -> DataFrame:
        if self.limit is not None and (self.limit < 1 or self.page < 1):
            raise ValueError("limit and page count from 1")
        out = self.matching(df)
        if self.limit is not None or self.sort:
            out = out.orderBy(*self.order(out))
        if self.limit is not None:
            out = out.offset((self.page - 1) * self.limit).limit(self.limit) if self.page > 1 else out.limit(self.limit)
        return out.select(*self.columns) if self.columns else out


def _tagged(*tags: str) -> dict:
    return {"in": list(tags)}


def sites(lang: str, as_of: Any = None, slug: str = "", page: int = 1) -> dict[str, tuple[str, Find]]:
    """The finds a content site makes: name, table and find. Detail reads take the language afterwards (``locale.prefer``)."""
    local, newest = {"equals": lang}, "-publishedAt"
    latest = lambda n, **w: Find({"lang": local, **w}, newest, n, published=True)
    paged = lambda **w: Find({"lang": local, **w}, newest, 6, page, published=True)
    detail = Find({"slug": {"equals": slug}}, published=True)
    course = {"tag": {"like": "short-course"}, "lang": local}
    lecture = {"tag": {"like": "public-lecture"}, "lang": local}
    return {
        "q1": ("news", latest(3)), "q2": ("solutions", Find({"lang": local}, "-createdAt", 4, published=True)), "q3": ("courses", Find(course, published=True)),
        "q4": ("courses", Find(lecture, published=True)), "q5": ("publications", Find({}, "-year", 4, published=True)), "q6": ("courses", Find(course, newest, published=True)),
        "q7": ("courses", Find(lecture, newest, published=True)), "q8": ("news", latest(3, tag=_tagged("seminar", "workshop"))),
        "q9": ("upcoming_events", Find({"time": {"greater_than": as_of}}, "-time", published=True)), "q10": ("news", latest(3, tag=_tagged("workshop"))),
        "q11": ("news", latest(3, tag=_tagged("hackathon"))), "q12": ("courses", Find(lecture, newest, 3, published=True)), "q13": ("news", latest(3, tag=_tagged("workshop"))),
        "q14": ("news", latest(3, tag=_tagged("hackathon"))), "q15": ("courses", Find(lecture, newest, 3, published=True)), "q16": ("news", paged()),
        "q17": ("news", paged(tag=_tagged("ecotech"))), "q18": ("news", paged(tag=_tagged("workshop"))), "q19": ("news", paged(tag=_tagged("hackathon"))),
        "q20": ("publications", Find({}, "-year", 1000)), "q21": ("members", Find({}, "rank", 100)), "q22": ("news", detail), "q23": ("courses", detail), "q24": ("research_labs", detail),
        "q25": ("solutions", Find({"title": {"equals": slug}}, published=True)), "q26": ("learning_materials", detail), "q27": ("cyber_clinic_videos", Find({"slug": {"equals": slug}}, limit=1, published=True)),
        "q28": ("news", Find({"tag": _tagged("cyber-clinic"), "lang": {"equals": "vi"}}, newest, 4, published=True)), "q29": ("cyber_clinic_videos", Find({}, newest, published=True)),
        "q30": ("learning_materials", Find({"_status": {"equals": "published"}}, newest, 4)), "q31": ("learning_materials", Find({"_status": {"equals": "published"}}, newest)),
        "q32": ("courses", Find({"lang": local, "tag": {"equals": "short-course"}}, newest, published=True)), "q33": ("research_labs", Find({"lang": local}, newest, published=True)),
    }
