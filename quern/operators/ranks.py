"""Places and running sums in one order over a whole table, without a window in one task.

Rows are dealt out by range and sorted where they are, then kept. A row's place is its place
in its part, which Spark counts while it reads, and the number of rows in the parts before:
one number for each part, so nothing that grows with the rows goes through the driver.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.storage import settled

#: monotonically_increasing_id: the part above, the row within it below this bit.
_BITS = 33


def placed(df: DataFrame, order: list[Column], parts: int = 0) -> DataFrame:
    """df dealt out by range and kept, with ``_at``: the part and, below it, the place in the part."""
    return settled(df.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))


def part() -> Column:
    """The part of a row of ``placed``."""
    return F.shiftrightunsigned("_at", _BITS)


def numbered(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with the place of each row in that order, from 0. Ties are numbered in any order, so name a total one where that matters.

    An empty table stays empty. A column of that name is replaced.
    """
    rows = placed(df.drop(name), list(order))
    counts = sorted(rows.groupBy(part().alias("part")).count().collect())
    before = [0, *accumulate(r["count"] for r in counts)]
    starts = df.sparkSession.createDataFrame([(r["part"], b) for r, b in zip(counts, before, strict=False)], "_part long, _before long")
    within = F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))
    return rows.join(F.broadcast(starts), part() == F.col("_part")).withColumn(name, F.col("_before") + within).drop("_at", "_part", "_before")


def running(df: DataFrame, within: list[str], order: list[Column], value: str, name: str = "before") -> DataFrame:
    """df with the sum of ``value`` over the rows of the same group that come earlier in that order.

    A group of any size is spread over parts: sums of whole parts are taken first (as many
    rows for a group as it has parts), then each part is summed along by itself. Null groups
    are a group; null values count as 0. Many rows that tie in the whole order stay in one part: give the order a
    last column that tells them apart.
    """
    rows = placed(df, [*(F.col(c) for c in within), *order]).withColumn("_part", part())
    number = F.coalesce(F.col(value), F.lit(0))
    parts = rows.groupBy(*within, "_part").agg(F.sum(number).alias("_sum"))
    earlier = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(within)], F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    here = Window.partitionBy(*within, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn(name, F.coalesce(F.sum(number).over(here), F.lit(0)))
    same = F.col("_part") == F.col("_p")
    for k, c in enumerate(within):
        same &= F.col(c).eqNullSafe(F.col(f"_g{k}"))
    return summed.join(parts, same).withColumn(name, F.col(name) + F.col("_start")).drop("_at", "_part", "_p", "_start", *[f"_g{k}" for k in range(len(within))])
