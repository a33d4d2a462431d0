"""Rewriting rules kept in a table, all of them applied in one pass over a text.

This engine's own design; the rules' semantics are specified nowhere. From left to right, at
each place the longest rule that fits there replaces what it matches, and reading goes on
behind it, so what a rule has put in is never rewritten again. Rules of the same text count
once, the first by their order. The work for a text doesn't depend on the number of rules.
"""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules and characters that every task may be given to hold. More of them are an error, never left out.
MOST, SIZE = 100_000, 16 << 20
_built: dict[int, tuple[tuple, ahocorasick.Automaton]] = {}


def active(rules: DataFrame) -> list[tuple[str, str]]:
    """(raw, normalized) of the active rules of a table (raw, normalized, active, rank), each raw text once. A null rank comes last, a null text replaces by nothing, an empty raw text is no rule."""
    own = rules.filter("active AND raw <> ''").groupBy("raw").agg(F.min_by(F.coalesce("normalized", F.lit("")), F.struct(F.col("rank").isNull(), "rank", F.coalesce("normalized", F.lit("")))).alias("normalized"))
    size = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("raw") + F.octet_length("normalized")), F.lit(0)).alias("bytes")).first()
    if size["n"] > MOST or size["bytes"] > SIZE:
        raise ValueError(f"{size['n']} rules of {size['bytes']} bytes; at most {MOST} of {SIZE} go to every task")
    return sorted((r["raw"], r["normalized"]) for r in own.collect())


def _automaton(rules: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    key = hash(rules)
    have = _built.get(key)
    if have is None or have[0] != rules:
        made = ahocorasick.Automaton()
        for raw, normalized in rules:
            made.add_word(raw, (len(raw), normalized))
        made.make_automaton()
        have = _built[key] = (rules, made)
    return have[1]


def rewritten(text: str, automaton: ahocorasick.Automaton) -> str:
    """The text with every leftmost, longest match replaced."""
    best: dict[int, tuple[int, str]] = {}
    for last, (n, normalized) in automaton.iter(text):
        start = last - n + 1
        if n > best.get(start, (0, ""))[0]:
            best[start] = (n, normalized)
    out, at = [], 0
    for start in sorted(best):
        if start >= at:
            n, normalized = best[start]
            out += [text[at:start], normalized]
            at = start + n
    return "".join([*out, text[at:]])


def rewrite(df: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """df with the column rewritten by the active rules. Null stays null. Without rules nothing changes."""
    own = tuple(active(rules))
    if not own:
        return df

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        made = _automaton(own)
        return texts.map(lambda t: rewritten(t, made), na_action="ignore")

    done: Column = apply(F.col(column))
    return df.withColumn(column, done)
