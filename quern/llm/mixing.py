"""A mix of sources by weight, with a limit on how often a text is repeated.

Capped water-filling: each source should get a share of all words by its weight, but no more
than ``epochs`` times its own. What clamped sources can't take is shared out again among the
others by weight, until none is above its limit. The state of the rounds is one number, the
words for a unit of weight: a source is clamped where its weight times that is more than its
limit, so a round is one sum over the sources, wherever they lie.

A source then takes whole repetitions of all its texts, and in the last, fractional one the
texts that come first in a seeded order, up to its target; the text at the target is cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import ranks
from quern.storage import settled

WORD = r"[^\x20\x09-\x0D]+"
#: Values that tell apart rows which agree in all else, so that a range can end between them. They swap places without effect.
SALTS = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weighed(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """sources with a weight: the given ones in turn, in the order of the sources' code points, null last."""
    placed = ranks.numbered(sources, F.col("source").asc_nulls_last(), name="place")
    turn = F.pmod("place", F.lit(len(weights))).cast("int") + 1
    return placed.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), turn)).drop("place")


def fill(sources: DataFrame, epochs: int) -> DataFrame:
    """sources (source, source_size, weight) with a target: words to take from each.

    There are at most as many rounds as sources; in each one at least one more is clamped.
    """
    limit = F.col("source_size") * epochs
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    unit, clamped = 0.0, None
    while True:
        above = F.col("weight") * F.lit(unit) > limit
        row = sources.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if row[0] == clamped:
            break
        clamped = row[0]
        if not row[2]:  # none is left to take anything
            break
        unit = float(total - row[1]) / float(row[2])
    return sources.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.lit(unit)))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), epochs: int = 3, seed: int = 1, keep: Sequence[str] = ()
) -> DataFrame:
    """One row for each row of docs: (id_col, size, source_size, target, taken, whole, part) and the columns of ``keep``.

    size counts the words of the text, source_size those of its source, target what the
    source should give. taken = whole * size + part: all words so many times, and so many
    of its first ones once more. The words taken from a source are its target, to the
    nearest word. Null and empty texts have no words and give none. A null source is a
    source, the last in order; null ids share a place in the seeded order, where shorter
    texts come first. Rows that agree in id, source and size may swap their parts, so
    results agree between runs as sets of rows. An empty table gives an empty one.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), words(F.col(f"`{text_col}`")).alias("size"), row.alias("row"))
    rows = settled(rows.withColumn("key", F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 16)))
    sources = settled(fill(settled(weighed(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights)), epochs))
    salted = rows.withColumn("salt", F.monotonically_increasing_id() % SALTS)
    placed = ranks.running(salted, ["source"], [F.col("key"), F.col("size"), F.col("salt")], "size")
    own = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.select(F.col("source").alias("_source"), "source_size", "target", own.alias("whole"))
    sources = sources.withColumn("rest", F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    out = placed.join(sources, F.col("source").eqNullSafe(F.col("_source"))).withColumn("part", part)
    out = out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"), "whole", "part", *[F.col(f"row.`{c}`").alias(c) for c in keep])
    return out


def repeated(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The texts of the mix: a row of ``mixed`` (with its text kept) for each repetition, numbered by ``epoch`` from 1; the last may hold the first words only, one space between them."""
    times = F.col("whole") + (F.col("part") > 0).cast("long")
    rows = mixed.filter(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.lit(1), F.col("part").cast("int")), " ")
    return rows.withColumn(text_col, F.when((F.col("epoch") > F.col("whole")) & (F.col("part") < F.col("size")), first).otherwise(F.col(text_col)))
