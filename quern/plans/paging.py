"""Page counts, page numbers and neighbours."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import ranks

#: Page sizes that a reader may choose, and the width of the row of page numbers.
SIZES, PAGER = (20, 200, 500), 4


def page_number(text: str | None) -> int:
    """What is not a whole number from 1 on is page 1."""
    return max(1, int(text)) if text and re.fullmatch(r"\s*[+-]?[0-9]+\s*", text, re.ASCII) else 1


def page_of(text: Column) -> Column:
    """``page_number`` for a column of addresses. What is too long for a whole number is page 1 as well."""
    whole = F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(F.translate(text, "\t\n\x0b\f\r", "     ")).try_cast("int"))
    number = F.coalesce(whole, F.lit(1))
    return F.greatest(number, F.lit(1))


def moved(page: Column, to: Column, pages: Column) -> Column:
    """``move`` for a table of requests: pages that aren't there are not gone to."""
    return F.when(to.between(1, pages), to).otherwise(page)


def resized(page: Column, size: Column, to: Column) -> Column:
    """struct(page, size) after another page size is chosen: page 1 of it, if readers may choose it; no change if not, or if it is the same."""
    same = F.struct(page.alias("page"), size.alias("size"))
    return F.when(to.isin(*SIZES) & (to != size), F.struct(F.lit(1).cast("long").alias("page"), to.alias("size"))).otherwise(same)


def move(page: int, to: int, pages: int) -> int:
    return to if 1 <= to <= pages else page


def pages_of(total: Column, size: int) -> Column:
    return F.ceil(total / F.lit(size))


def numbers(pages: Column) -> Column:
    """1 to pages; an empty array for none."""
    return F.when(pages > 0, F.sequence(F.lit(1).cast("long"), pages.cast("long"))).otherwise(F.array().cast("array<bigint>"))


def pager(pages: Column, page: Column | int, width: int = PAGER) -> Column:
    """The group of ``width`` page numbers that page is in."""
    page = page if isinstance(page, Column) else F.lit(page)
    return F.slice(numbers(pages), (F.floor((page - 1) / width) * width + 1).cast("int"), width)


def envelope(df: DataFrame, page: int, size: int) -> DataFrame:
    """One row: total, page, page_size, total_pages, prev_page and next_page (null at the ends), and the pager."""
    one = df.agg(F.count("*").alias("total")).withColumn("total_pages", pages_of(F.col("total"), size).cast("long"))
    return one.select(
        "total", F.lit(page).alias("page"), F.lit(size).alias("page_size"), "total_pages",
        F.when(F.lit(page) > 1, F.lit(page - 1)).alias("prev_page"), F.when(F.lit(page) < F.col("total_pages"), F.lit(page + 1)).alias("next_page"),
        pager(F.col("total_pages"), page).alias("pager"),
    )


def placed(df: DataFrame, sort: Sequence[tuple[str, bool]], size: int) -> DataFrame:
    """df with the place (from 0) and the page (from 1) of every row. sort: columns and whether they descend; the last one should tell rows apart.

    All pages at once, and no task holds the whole: rows are dealt out by range. Nulls come
    last where a column descends, first where it ascends.
    """
    out = ranks.numbered(df, *[F.col(c).desc() if down else F.col(c).asc() for c, down in sort], name="place")
    return out.withColumn("page", F.floor(F.col("place") / size) + 1)


def starts(numbered: DataFrame, sort: Sequence[tuple[str, bool]]) -> DataFrame:
    """(page, the sort columns) of the first row of each page: a small table by which any page is read again without a sort."""
    first = numbered.groupBy("page").agg(F.min_by(F.struct(*[c for c, _ in sort]), "place").alias("k"))
    return first.select("page", "k.*")


def _from(sort: Sequence[tuple[str, bool]], key: Sequence) -> Column:
    """Rows that come at this key or after it."""
    out = F.lit(True)
    for (c, down), v in reversed(list(zip(sort, key, strict=True))):
        v = F.lit(v)
        beyond = (F.col(c) < v) if down else (F.col(c) > v)
        out = beyond | ((F.col(c) == v) & out)
    return out


def page_rows(df: DataFrame, first: DataFrame, sort: Sequence[tuple[str, bool]], page: int) -> DataFrame:
    """One page of df by its key range: the filter reaches the scan, nothing is skipped over row by row. The sort columns must not be null. Two keys at most go through the driver."""
    keys = {r["page"]: tuple(r)[1:] for r in first.filter(F.col("page").isin(page, page + 1)).select("page", *[c for c, _ in sort]).collect()}
    if page not in keys:
        return df.limit(0)
    out = df.filter(_from(sort, keys[page]))
    return out.filter(~_from(sort, keys[page + 1])) if page + 1 in keys else out
