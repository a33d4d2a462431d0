"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, which change places.

Where a text is cut is a number of units (a run of letters, or one other character); what is
needed is a number of characters. The relational way: texts become rows of blocks, BLOCK
units each; a window sums the blocks' lengths along the text; a cut request meets the block
that holds its unit by number; the offsets found are gathered by text and go back to it. What
is left of a cut, under a block of units, is counted in the text itself, which ``substring``
cuts. Only keys and lengths are shuffled on the way, no pieces of text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import row_key

#: Possessive, because neither a run of letters nor a block may give back what it has taken.
UNIT = "[A-Za-z]++|[^A-Za-z]"
#: Units of a block. A text of n units makes n / BLOCK rows to shuffle, and BLOCK / 2 on average to count on for each cut.
BLOCK = 128
P, S, M = "<P>", "<S>", "<M>"
KEY = ["_id", "_h", "_n"]


def units(text: Column) -> Column:
    return F.regexp_count(text, F.lit(UNIT)).cast("long")


def split(text: Column, size: int = 1) -> Column:
    """The text in blocks of so many units, the last one shorter. All characters are in one of them."""
    return F.regexp_extract_all(text, F.lit(UNIT if size == 1 else f"(?:{UNIT}){{1,{size}}}+"), F.lit(0))


def offsets(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, n, first, second): for texts (key, text, n, low, high) of n units, to be cut after low and high of them, where either cut lies.

    first and second are structs: characters before the cut's block, and units from there
    to the cut. The block is the one of the last unit before the cut. Texts that come
    twice, key and all, count once. 0 <= low <= high.
    """
    own = lambda c: F.greatest(F.floor((F.col(c) - 1) / block), F.lit(0)).cast("int")
    blocks = texts.select(*KEY, own("low").alias("a"), own("high").alias("b"), F.posexplode(split(F.col("text"), block)).alias("block", "piece"))
    blocks = blocks.select(*KEY, "block", F.char_length("piece").alias("chars"), F.col("block").isin(F.col("a"), F.col("b")).alias("cut")).distinct()
    along = Window.partitionBy(*KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summed = blocks.withColumn("before", F.coalesce(F.sum("chars").over(along), F.lit(0)).cast("int")).filter("cut").select(*KEY, "block", "before")
    requests = F.array(*[F.struct(F.lit(k).alias("cut"), own(c).alias("block"), F.col(c).alias("units")) for k, c in ((1, "low"), (2, "high"))])
    wanted = texts.select(*KEY, "n", F.inline(requests)).distinct()
    found = wanted.join(summed, [*KEY, "block"])
    at = F.struct("before", (F.col("units") - F.col("block").cast("long") * block).cast("int").alias("rest"))
    pick = lambda k: F.max(F.when(F.col("cut") == k, at))
    return found.groupBy(*KEY).agg(F.max("n").alias("n"), pick(1).alias("first"), pick(2).alias("second"))


def reached(text: Column, at: Column, block: int) -> Column:
    """Characters before a cut: those before its block, and its units there. A unit can be as long as the text, so the block is read to the text's end, as far as the match goes."""
    ahead = F.substring(text, at["before"] + 1, F.char_length(text))
    own = F.regexp_extract(ahead, f"^(?:{UNIT}){{1,{block}}}+", 0)
    return (at["before"] + F.char_length(F.array_join(F.slice(split(own), F.lit(1), at["rest"]), ""))).cast("long")


def number(digits: Column, k: int) -> Column:
    return F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = 90, spm: int = 20, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: (id_col, n, form, prefix_chars, middle_chars, output).

    n counts the units. rate in 100 texts are cut at two places drawn from seed and id,
    the others are plain: output is the text. spm in 100 of the cut ones put the suffix
    first (spm), the rest the prefix (psm). Null texts are empty; empty texts and those
    that hold one of the marks are plain, with n all the same; offsets of plain ones are
    null. A null id draws as an empty one. Repeated rows give repeated rows. Other columns
    are not read. A row's key is id, hash and length in bytes.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    base = docs.select(*row_key(f"`{id_col}`", f"`{text_col}`"), F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    base = base.select("_id", "_h", F.octet_length("text").alias("_n"), "id", "text", digits.alias("digits"))
    marked = F.col("text").contains(P) | F.col("text").contains(S) | F.col("text").contains(M)
    is_plain = (F.col("_n") == 0) | marked | (F.pmod(number(F.col("digits"), 2), F.lit(100)) >= rate)
    plain, cut = base.filter(is_plain), base.filter(~is_plain)
    numbered = cut.select(*KEY, "text", "digits", units(F.col("text")).alias("n"))
    a, b = (F.pmod(number(F.col("digits"), k), F.col("n") + 1) for k in (0, 1))
    found = offsets(numbered.select(*KEY, "text", "n", F.least(a, b).alias("low"), F.greatest(a, b).alias("high")), block)
    form = F.when(F.pmod(number(F.col("digits"), 3), F.lit(100)) < spm, "spm").otherwise("psm")
    # Texts stream past the offsets of their part: a few longs a text, held by key, and no sort of the texts. Plain ones stay where they are.
    joined = cut.select(*KEY, "id", "text", form.alias("form")).join(found.hint("shuffle_hash"), KEY)
    joined = joined.select("id", "text", "form", "n", reached(F.col("text"), F.col("first"), block).alias("first"), reached(F.col("text"), F.col("second"), block).alias("second"))
    part = lambda lo, hi: F.substring(F.col("text"), lo.cast("int") + 1, (hi - lo).cast("int"))
    prefix, middle, suffix = part(F.lit(0), F.col("first")), part(F.col("first"), F.col("second")), F.substring(F.col("text"), F.col("second").cast("int") + 1, F.char_length("text"))
    output = F.when(F.col("form") == "psm", F.concat(F.lit(P), prefix, F.lit(S), suffix, F.lit(M), middle)).otherwise(F.concat(F.lit(S), suffix, F.lit(P), prefix, F.lit(M), middle))
    joined = joined.select(F.col("id").alias(id_col), "n", "form", F.col("first").alias("prefix_chars"), (F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"))
    none = F.lit(None).cast("long")
    whole = plain.select(F.col("id").alias(id_col), units(F.col("text")).alias("n"), F.lit("plain").alias("form"), none.alias("prefix_chars"), none.alias("middle_chars"), F.col("text").alias("output"))
    return joined.union(whole)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. A mark stands once in a text that was cut."""
    body = F.substring(output, 4, 2**31 - 1)
    side = lambda mark, k: F.split_part(body, F.lit(mark), F.lit(k))
    middle = side(M, 2)
    before = lambda x: F.split_part(x, F.lit(M), F.lit(1))
    psm = F.concat(side(S, 1), middle, before(side(S, 2)))
    spm = F.concat(before(side(P, 2)), middle, side(P, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
