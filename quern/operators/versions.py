"""Version tables: the newest of each document, what is published, what is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: versions kept of each document.
KEPT = 50


def newest(df: DataFrame, key: str, order: list[str], n: int = KEPT) -> DataFrame:
    """The n newest rows of each key. Spark cuts each task's share to n before the shuffle."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def latest_published(df: DataFrame, key: str, order: str) -> DataFrame:
    return newest(df.filter(F.col("_status") == "published"), key, [order], 1)


def due(df: DataFrame, column: str, as_of: Column) -> DataFrame:
    """Scheduled rows whose time has come."""
    return df.filter(F.col(column) <= as_of)


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def in_force(reads: DataFrame, versions: DataFrame, key: str, at: str, since: str, order: str, width: str = "day") -> DataFrame:
    """reads with version: the row of versions (a struct) in force for its key at its time, null before the first one.

    A version holds from its own time on, until the next one; of several at one time the
    greatest in ``order`` does. Null keys and times have none. A key with any number of
    reads or versions is split by ``width`` of time (a unit of date_trunc): each piece is
    ordered by itself, and what was in force at its beginning comes from one row a piece.
    """
    piece = lambda c: F.date_trunc(width, c)
    held = F.struct(*[F.col(c) for c in versions.columns])
    v = versions.filter(F.col(key).isNotNull() & F.col(since).isNotNull()).select(F.col(key).alias("_k"), F.col(since).alias("_t"), F.lit(0).alias("_side"), F.col(order).alias("_o"), held.alias("_v"))
    kind = v.schema["_v"].dataType
    row = F.struct(*[F.col(c) for c in reads.columns])
    r = reads.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(v.schema["_o"].dataType).alias("_o"), F.lit(None).cast(kind).alias("_v"), row.alias("_r"))
    both = v.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).unionByName(r).withColumn("_p", piece(F.col("_t")))
    here = Window.partitionBy("_k", "_p").orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("_own", F.last("_v", True).over(here)).filter("_side = 1")
    last = v.withColumn("_p", piece(F.col("_t"))).groupBy("_k", "_p").agg(F.max_by("_v", F.struct("_t", "_o")).alias("_last"))
    pieces = last.unionByName(own.filter("_k IS NOT NULL AND _own IS NULL").select("_k", "_p", F.lit(None).cast(kind).alias("_last")).distinct())
    pieces = pieces.groupBy("_k", "_p").agg(F.first("_last", True).alias("_last"))
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    earlier = pieces.select("_k", "_p", F.last("_last", True).over(before).alias("_earlier"))
    out = own.join(earlier, ["_k", "_p"], "left")
    return out.select("_r.*", F.when(F.col("_k").isNotNull() & F.col("_t").isNotNull(), F.coalesce("_own", "_earlier")).alias("version"))
