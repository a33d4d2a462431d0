"""Questions scored against what is asked: an inverted index of terms by weight. This engine's own design.

A text is the set of its terms. A term weighs more the fewer different texts have it: the
number of binary digits of (texts / texts with it). Two texts score by the weight of the
terms they share over the weight of all their terms. Only pairs that can reach the least
score meet: they share a term among the first of both, rarest first, whose rest still
weighs enough, and their weights are within the score of each other. Texts of equal terms
are one entry, so copies meet nobody twice, and the entries of a frequent term are split.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import faq
from quern.storage import stored

#: Entries of one term and band that meet in one place; more are split.
SPLIT = 4096


def terms(text: Column) -> Column:
    """The different words of letters and digits, in lower case, sorted; null has none."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))))


def _named(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, terms) of the rows that have terms; name stands for the set of terms."""
    found = df.select(F.col(key).alias("key"), terms(F.col(text)).alias("terms")).filter(F.size("terms") > 0)
    return found.withColumn("name", F.sha2(F.array_join("terms", " "), 256))


def _weighed(sets: DataFrame, vocabulary: DataFrame, total: int) -> DataFrame:
    """(id, marks, weight): a mark is 99 less a term's weight and the term, so marks sort from rare to frequent."""
    each = sets.select("id", F.explode("terms").alias("term")).join(vocabulary, "term", "left")
    weight = F.length(F.bin(F.floor(F.lit(total) / F.coalesce("n", F.lit(1))).cast("long"))).cast("long")
    mark = F.concat(F.lpad((99 - weight).cast("string"), 2, "0"), "term")
    marks = each.groupBy("id").agg(F.array_sort(F.collect_list(mark)).alias("marks"))
    return stored(marks.withColumn("weight", _of(F.col("marks"))), "weighed")


def _of(marks: Column) -> Column:
    """What marks weigh together."""
    return F.aggregate(marks, F.lit(0).cast("long"), lambda total, m: total + 99 - F.substring(m, 1, 2).cast("long"))


def _posted(sets: DataFrame, least: int) -> DataFrame:
    """(id, weight, seats, codes, band, mark, own, rest) of the first marks of each set: with each of them, what follows still weighs ``least`` thousandths of the whole.

    own is what the mark weighs, rest what it and those after it weigh. A mark goes by its
    hash of 64 bits. seats are 256 bits, of which each mark of the set takes one; codes hold
    for each mark its seat and what it weighs.
    """
    own = lambda m: 99 - F.substring(m, 1, 2).cast("int")
    steps = F.aggregate(
        "marks",
        F.struct(F.col("weight").cast("int").alias("rest"), F.array().cast("array<struct<mark:bigint,own:int,rest:int>>").alias("first")),
        lambda s, m: F.struct(
            (s["rest"] - own(m)).alias("rest"),
            F.when(s["rest"].cast("long") * 1000 >= F.col("weight") * least, F.array_append(s["first"], F.struct(F.xxhash64(m).alias("mark"), own(m).alias("own"), s["rest"].alias("rest")))).otherwise(s["first"]).alias("first"),
        ),
    )
    first = sets.select("id", "weight", steps["first"].alias("first"), F.transform("marks", lambda m: F.pmod(F.xxhash64(m, F.lit(1)), F.lit(256)) * 64 + own(m)).cast("array<smallint>").alias("codes"))
    seats = F.array(*[F.expr(f"aggregate(codes, 0L, (t, c) -> if(shiftright(c, 12) = {k}, t | shiftleft(1L, shiftright(c, 6) & 63), t))") for k in range(4)])
    return first.select("id", "weight", seats.alias("seats"), "codes", F.length(F.bin("weight")).alias("band"), F.inline("first"))


def _seated() -> Column:
    """What those marks of codes weigh whose seats are taken in _seats; what two sets share weighs no more."""
    return F.expr("aggregate(codes, 0, (t, c) -> t + (c & 63) * cast(shiftright(_seats[shiftright(c, 12)], shiftright(c, 6) & 63) & 1 AS int))")


def suggestions(asked: DataFrame, questions: DataFrame, ask: str = "ask_id", answer: str = "answer_id", text: str = "text", least: int = 300, most: int = 2, split: int = SPLIT) -> DataFrame:
    """(ask, answer, score, place): for each row of asked the ``most`` best answers, of ``least`` thousandths or more; place starts at 1.

    An answer scores as its best question or variant, and of equal scores the least id comes
    first. A text without terms, null or empty, gets and gives no suggestion; so does any
    text where the other table is empty. Rows of asked that repeat get their suggestions
    each. Columns of other names are not read.
    """
    if not 0 < least <= 1000:
        raise ValueError("least must be 1 to 1000 thousandths")
    entries, wanted = _named(questions, answer, text), _named(asked, ask, text)
    # Kept with a number for each different set of terms, which is shorter than its name.
    alike = lambda df: stored(df.groupBy("name").agg(F.first("terms").alias("terms")).withColumn("id", F.monotonically_increasing_id()), "terms")
    kept, sought_for = alike(entries), alike(wanted)
    total = kept.count()
    vocabulary = kept.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    index, queries = _weighed(kept, vocabulary, total), _weighed(sought_for, vocabulary, total)

    reach = math.ceil(math.log2(1000 / least))
    posted, sought = _posted(index, least), _posted(queries, least)
    posted = posted.select(F.col("id").alias("entry"), F.xxhash64("mark", "band").alias("place"), F.col("weight").alias("_weight"), F.col("own"), F.col("rest").alias("_rest"), F.col("seats").alias("_seats"))
    sought = sought.withColumn("band", F.explode(F.sequence(F.col("band") - reach, F.col("band") + reach))).select("id", F.xxhash64("mark", "band").alias("place"), "weight", "rest", "codes")
    frequent = posted.groupBy("place").agg(F.ceil(F.count("*") / split).cast("int").alias("lots")).filter("lots > 1")
    lots = F.coalesce("lots", F.lit(1))
    posted = posted.join(frequent, "place", "left").select("entry", "place", "_weight", "own", "_rest", "_seats", F.pmod(F.xxhash64("entry"), lots).cast("int").alias("lot"))
    sought = sought.join(frequent, "place", "left").select("id", "place", "weight", "rest", "codes", F.explode(F.sequence(F.lit(0), lots - 1)).alias("lot"))
    # What a pair can share: from a common mark on, no more than the lighter rest; in all, no more than its seats tell, nor than the common first marks and the lighter rest after the last one. Few pairs of texts that are unlike get past the seats, so hardly any of them move.
    enough = lambda shared: shared.cast("long") * (1000 + least) >= (F.col("weight") + F.col("_weight")).cast("long") * least
    met = sought.join(posted, ["place", "lot"]).filter(enough(F.least("rest", "_rest")) & enough(_seated()))
    met = met.groupBy("id", "entry", "weight", "_weight").agg(F.sum("own").alias("own"), F.min(F.least("rest", "_rest") - F.col("own")).alias("after"))
    pairs = met.filter(enough(F.col("own") + F.col("after"))).select("id", "entry")

    theirs = index.select(F.col("id").alias("entry"), F.col("marks").alias("_marks"), F.col("weight").alias("_weight"))
    shared = pairs.join(queries, "id").join(theirs, "entry").withColumn("both", _of(F.array_intersect("marks", "_marks")))
    either = F.col("weight") + F.col("_weight") - F.col("both")
    scored = shared.filter(F.col("both") * 1000 >= either * least).select("id", "entry", (F.col("both") / either).alias("score"))
    scored = scored.join(sought_for.select("id", "name"), "id").join(kept.select(F.col("id").alias("entry"), F.col("name").alias("of")), "entry").select("name", F.col("of").alias("entry"), "score")

    # Of the answers that share an entry only the least ones can be among the best.
    first = entries.select(F.col("name").alias("entry"), F.col("key").alias(answer)).distinct()
    first = first.withColumn("_n", F.row_number().over(Window.partitionBy("entry").orderBy(answer))).filter(F.col("_n") <= most).drop("_n")
    best = scored.join(first, "entry").groupBy("name", answer).agg(F.max("score").alias("score"))
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), answer))).filter(F.col("place") <= most)
    return wanted.select("name", F.col("key").alias(ask)).join(best, "name").select(ask, answer, "score", "place")


def decisions(asked: DataFrame, scored: DataFrame, ask: str = "ask_id", similarity: float = 0.6, margin: float = 0.1) -> DataFrame:
    """(ask, decision, answer_id, best) for every different id of asked; without suggestions it is fallback, with null in best."""
    made = faq.decide(scored, ask, similarity, margin)
    return asked.select(ask).distinct().join(made, ask, "left").withColumn("decision", F.coalesce("decision", F.lit("fallback")))
