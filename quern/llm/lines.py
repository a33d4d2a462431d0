"""Line deduplication by a tree of log templates.

A line goes down a tree of fixed depth: by its number of tokens, then by its leading tokens,
with every token that holds a digit taken for a variable field. In a leaf, a token that
few lines have at its place becomes a variable field too, and what is left is the line's
template. Templates that recur in enough different texts are boilerplate, and their lines go.

Texts are counted by content: a hundred copies of one text are one text, so its lines are
not boilerplate on that account. On demand near copies are one text too: a text of little but
boilerplate loses its lines, a text with four edited copies doesn't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import windows
from quern.llm.common import Workspace, row_key, text_bytes
from quern.llm.simhash import near_classes

_FIELD = np.uint64(0x5BF0A8B1)
#: So many keys of texts (two longs each), or names of lines, are broadcast to meet the texts where they lie; if there are more, they meet in a shuffle. The rows are the same.
KEYS = 1_000_000


def parsed(column: pa.Array, depth: int) -> tuple[np.ndarray, ...]:
    """For each line with tokens: text, number in it, leaf and name; then each line's first token and count, and all masked tokens."""
    data, offsets = text_bytes(column)
    start, end, name, _ = windows.words(data, offsets)
    digits = np.concatenate(([0], np.cumsum((data >= 48) & (data <= 57))))
    tokens = np.where(digits[end] > digits[start], _FIELD, name)
    breaks = np.concatenate(([0], np.cumsum(data == 10)))
    text = np.searchsorted(offsets, start, "right") - 1
    number = breaks[start] - breaks[offsets[text]]
    first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (number[1:] != number[:-1])))) if len(start) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(start)))
    names = windows.Names(tokens)
    line = names.at(first, count)
    leaf = windows.mix(names.at(first, np.minimum(count, depth)) + count.astype(np.uint64))
    return text[first], number[first], leaf.view(np.int64), line.view(np.int64), first, count, tokens.view(np.int64)


def lines(docs: DataFrame, depth: int) -> DataFrame:
    """docs: _id, _h, text. Leaf and name of each different line of each text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, _, leaf, line, *_ = parsed(b.column(2), depth)
            order = np.lexsort((line, leaf, text))
            t, f, n = text[order], leaf[order], line[order]
            new = np.concatenate(([True], (t[1:] != t[:-1]) | (f[1:] != f[:-1]) | (n[1:] != n[:-1]))) if len(t) else np.zeros(0, bool)
            at = t[new]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(f[new]), pa.array(n[new])], ["_id", "_h", "leaf", "line"])

    return docs.mapInArrow(scan, "_id long, _h long, leaf long, line long")


def places(docs: DataFrame, depth: int) -> DataFrame:
    """docs: text, wanted array<struct<line, texts>>. One row for each token of a wanted line: leaf, line, texts, place and token."""
    ddl = "leaf long, line long, texts long, place int, token long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, _, leaf, line, first, count, tokens = parsed(b.column(0), depth)
            cuts = np.searchsorted(text, np.arange(b.num_rows + 1))
            for row, wanted in enumerate(b.column(1).to_pylist()):
                own = slice(cuts[row], cuts[row + 1])
                _, at = np.unique(line[own], return_index=True)  # a line that stands twice in a text counts once
                texts = {w["line"]: w["texts"] for w in wanted}
                at = np.array([own.start + k for k in at if line[own.start + k] in texts], np.int64)
                n = count[at]
                group = np.repeat(np.arange(len(at)), n)
                place = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
                weight = np.array([texts[x] for x in line[at]], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (leaf[at][group], line[at][group], weight[group], place.astype(np.int32), tokens[first[at][group] + place])], ["leaf", "line", "texts", "place", "token"]
                )

    return docs.mapInArrow(scan, ddl)


def boilerplate(ws: Workspace, keyed: DataFrame, found: DataFrame, depth: int, least: int, constant: float, classes: DataFrame | None = None) -> DataFrame:
    """The lines (leaf, line) of found whose template recurs in ``least`` texts.

    keyed: _id, _h, text; found: their lines. classes: _h, root; texts of one root count once.
    """
    own = found.groupBy("leaf", "line", "_h").agg(F.min("_id").alias("_id"))
    own = ws.save(own.withColumn("root", F.col("_h")) if classes is None else own.join(classes.select("_h", "root"), "_h", "left").withColumn("root", F.coalesce("root", "_h")))
    popular = own.select("leaf", "root").distinct().groupBy("leaf").count().filter(F.col("count") >= least).select("leaf")
    by_root = own.groupBy("leaf", "line", "root").agg(F.min(F.struct("_id", "_h")).alias("one"))
    counted = by_root.groupBy("leaf", "line").agg(F.count("*").alias("texts"), F.min("one").alias("one"))
    known = ws.save(counted.join(popular, "leaf"))
    wanted = ws.save(known.groupBy(F.col("one._id").alias("_id"), F.col("one._h").alias("_h")).agg(F.collect_set(F.struct("line", "texts")).alias("wanted")))
    # Few texts are wanted; the others need not be shuffled to meet nothing.
    picked = keyed.join(F.broadcast(wanted.select("_id", "_h")), ["_id", "_h"], "left_semi") if wanted.count() <= KEYS else keyed
    # One text stands for each line; a record that comes twice gives its tokens twice, hence the distinct.
    spread = ws.save(places(picked.join(wanted, ["_id", "_h"]).select("text", "wanted"), depth).distinct())
    fixed = spread.groupBy("leaf", "place", "token").agg(F.sum("texts").alias("n")).filter((F.col("n") >= least) & (F.col("token") != int(_FIELD))).select("leaf", "place", "token", F.lit(1).alias("fixed"))
    shaped = spread.join(fixed, ["leaf", "place", "token"], "left").withColumn("token", F.when(F.col("fixed") == 1, F.col("token")))
    shaped = ws.save(
        shaped.groupBy("leaf", "line", "texts").agg(F.bit_xor(F.xxhash64("place", F.coalesce("token", F.lit(0)))).alias("template"), F.count("fixed").alias("constants"), F.count("*").alias("n"))
    )
    recur = shaped.filter(F.col("constants") >= F.lit(constant) * F.col("n")).groupBy("leaf", "template").agg(F.sum("texts").alias("total")).filter(F.col("total") >= least).select("leaf", "template")
    if classes is not None:  # copies that differ in a line have it once
        several = shaped.join(recur, ["leaf", "template"]).select("leaf", "line", "template").join(own.select("leaf", "line", "root"), ["leaf", "line"])
        recur = several.select("leaf", "template", "root").distinct().groupBy("leaf", "template").count().filter(F.col("count") >= least).select("leaf", "template")
    by_template = shaped.filter(F.col("constants") >= F.lit(constant) * F.col("n")).join(recur, ["leaf", "template"]).select("leaf", "line")
    # A line that recurs as it stands needs no constants.
    dropped = ws.save(by_template.union(known.filter(F.col("texts") >= least).select("leaf", "line")).distinct())
    ws.drop(own)
    return dropped


def _cut(texts: pd.Series, most: float, gone) -> pd.DataFrame:
    """The texts without their dropped lines, or as they are where these hold more than ``most`` of the tokens; and how many went. gone: of a row and its line names, which to drop."""
    text, number, _, line, _, count, _ = parsed(pa.array(texts, pa.large_string()), 1)
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    out, n = [], []
    for row, t in enumerate(texts):
        own = slice(cuts[row], cuts[row + 1])
        hit = gone(row, line[own])
        if hit.any() and count[own][hit].sum() > most * count[own].sum():
            hit[:] = False
        drop = set(number[own][hit].tolist())
        out.append("\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop) if drop else t)
        n.append(len(drop))
    return pd.DataFrame({"text": out, "n_dropped": n})


def cleaner(most: float):
    """A pandas UDF of a text and the names of its lines that go."""

    @F.pandas_udf("text string, n_dropped int")
    def clean(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        return _cut(texts, most, lambda row, own: np.isin(own, np.zeros(0, np.int64) if gone[row] is None else np.asarray(gone[row], np.int64)))

    return clean


def known_cleaner(most: float, shared):
    """A pandas UDF of a text alone; shared: broadcast sorted names of all lines that go."""

    @F.pandas_udf("text string, n_dropped int")
    def clean(texts: pd.Series) -> pd.DataFrame:
        names = shared.value
        return _cut(texts, most, lambda _, own: names[np.minimum(np.searchsorted(names, own), len(names) - 1)] == own if len(names) else np.zeros(len(own), bool))

    return clean


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, least: int = 5, constant: float = 0.6, most: float = 1.0, copies: bool = True) -> DataFrame:
    """The rows of docs with all their columns, text_col without boilerplate lines, and n_dropped, their number, at the end.

    Lines end at line feeds and tokens at ASCII white space. A template is boilerplate if its
    lines come in ``least`` different texts or more and ``constant`` or more of its tokens are
    not variable fields; a line that recurs as it stands, fields aside, needs no constants.
    Lines without tokens stay. With ``most`` under 1, a text of which more than that share of tokens
    would go stays whole: it is a copy rather than a page with boilerplate. Without ``copies``,
    near copies (simhash.near_classes) count as one text: classes are sought among the texts
    that have a line to drop, since no other text counts for one. A null text stays null; rows that repeat are treated alike; other columns pass through, whatever
    their names; an n_dropped of the input gives way.
    """
    ws = Workspace(docs.sparkSession, "lines")
    key = row_key(id_col, text_col)
    keyed = docs.select(*key, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = ws.save(lines(keyed, depth))
    dropped = boilerplate(ws, keyed, found, depth, least, constant)
    if not copies:
        hit = ws.save(found.join(dropped, ["leaf", "line"]).select("_id", "_h").distinct())
        few = F.broadcast(hit) if hit.count() <= KEYS else hit
        classes = near_classes(ws, keyed.join(few, ["_id", "_h"], "left_semi").select("_id", "_h", "text"))
        dropped = boilerplate(ws, keyed, found, depth, least, constant, ws.save(classes.filter("root <> _h").select("_h", "root")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    names = dropped.select("line").distinct()  # a line's name tells its leaf
    if names.count() <= KEYS:
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(names.toPandas()["line"].to_numpy(np.int64)))
        now, rows = known_cleaner(most, shared)(text), docs.select(row)
    else:
        gone = found.join(dropped, ["leaf", "line"]).groupBy("_id", "_h").agg(F.collect_set("line").alias("gone"))
        now, rows = cleaner(most)(text, F.col("gone")), docs.select(*key, row).join(gone, ["_id", "_h"], "left")
    done = rows.select("row", now.alias("now"))
    text = F.when(F.col(f"row.`{text_col}`").isNotNull(), F.col("now.text")).alias(text_col)
    return done.select(*[text if c == text_col else F.col(f"row.`{c}`") for c in docs.columns if c != "n_dropped"], F.col("now.n_dropped").alias("n_dropped"))
