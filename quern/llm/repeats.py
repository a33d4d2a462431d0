"""Every position covered by a window of a fixed length that stands twice in the corpus, without a pair of texts ever formed.

The common ground of the suffix-array and the seed-and-extend deduplication. Both look for
windows (400 bytes, 35 words) that start at two places at least:

1. Seeds. The windows of a text fall into runs that share a winnowed anchor. A run becomes
   one row: its place, the anchor's name, and the name of all it covers. A repeated window
   has a repeated anchor, so everything near an anchor that occurs once is settled here.
2. Whole runs that are equal are repeats, however many there are: counting them is a
   grouped sum, combined before its shuffle.
3. What is left are the rims of repeats: a run that occurs once although its anchor occurs
   in other runs too. Only for those, and one of each sort of run they might match, are
   single windows compared; how is up to the caller (``match``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import windows
from quern.llm.common import Workspace, row_key, text_bytes

KEY = ["_id", "_h"]
RUNS = "_id long, _h long, at int, last int, place int, anchor long, sort long"


def symbols(batch: pa.RecordBatch, unit: str, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, symbols, offsets of the texts in symbols, and start and end of each symbol in data; empty for bytes)."""
    data, offsets = text_bytes(batch.column(column))
    if unit == "bytes":
        return data, data, offsets, offsets[:0], offsets[:0]
    start, end, names, count = windows.words(data, offsets)
    return data, names, count, start, end


def piece_symbols(all_symbols: np.ndarray, part: list[tuple[int, int, int]], unit: str) -> np.ndarray:
    joined = np.concatenate([all_symbols[a:b] for _, a, b in part])
    return windows.symbols_of_bytes(joined) if unit == "bytes" else joined


def runs(docs: DataFrame, unit: str, length: int, gram: int) -> DataFrame:
    """docs: _id, _h, text. One row for each run of window starts [at, last] that share the anchor at place; sort names all it covers."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = (b.column(k).to_numpy() for k in (0, 1))
            _, syms, offsets, _, _ = symbols(b, unit, 2)
            for part in windows.pieces(offsets, length - 1):
                text, start, stop = (np.array(x) for x in zip(*part, strict=True))
                names, first, last, anchor, piece = windows.governed(piece_symbols(syms, part, unit), stop - start, length, gram)
                if not len(first):
                    continue
                whole = names.at(first, last - first + length)
                whole = windows.mix(whole + windows.mix((anchor - first).astype(np.uint64) * np.uint64(1 << 32) + (last - first).astype(np.uint64)))
                grams = names.at(anchor, gram)
                begin = np.concatenate(([0], np.cumsum(stop - start)[:-1]))  # of the piece among the joined symbols
                at = first - begin[piece] + (start - offsets[text])[piece]
                row = text[piece]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (ids[row], hashes[row], at.astype(np.int32), (at + last - first).astype(np.int32), (at + anchor - first).astype(np.int32), grams.view(np.int64), whole.view(np.int64))],
                    schema=_arrow(RUNS),
                )

    return docs.mapInArrow(scan, RUNS)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def rim_windows(docs: DataFrame, unit: str, length: int, steps: list[tuple[int, int]]) -> DataFrame:
    """docs: _id, _h, text, rims array<struct<at, last, alone>>. One row for each window start in a rim.

    Columns: the key, at, alone (its run occurs once), and n0, n1, ...: the names of the
    symbols [at + from, at + from + size) for each (from, size) of steps.
    """
    ddl = "_id long, _h long, at int, alone int, " + ", ".join(f"n{k} long" for k in range(len(steps)))
    schema = _arrow(ddl)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = (b.column(k).to_numpy() for k in (0, 1))
            _, syms, offsets, _, _ = symbols(b, unit, 2)
            for row, rims in enumerate(b.column(3).to_pylist()):
                own = syms[offsets[row] : offsets[row + 1]]
                for part in near(sorted(rims, key=lambda r: r["at"]), length):
                    base = part[0]["at"]
                    names = windows.Names(piece_symbols(own, [(0, base, part[-1]["last"] + length)], unit))
                    at = np.concatenate([np.arange(r["at"], r["last"] + 1) for r in part])
                    alone = np.repeat([r["alone"] for r in part], [r["last"] - r["at"] + 1 for r in part])
                    got = [names.at(at - base + f, size).view(np.int64) for f, size in steps]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (np.full(len(at), ids[row]), np.full(len(at), hashes[row]), at.astype(np.int32), alone.astype(np.int32), *got)], schema=schema
                    )

    return docs.mapInArrow(scan, ddl)


def rim_blocks(docs: DataFrame, unit: str, length: int, block: int) -> DataFrame:
    """docs: _id, _h, text, rims array<struct<at, last, anchor, alone>>. One row for each block of window starts in a rim.

    Blocks are cut at multiples of ``block`` before the anchor, so equal windows lie in blocks
    cut alike. core names what all windows of a block share, hull what they cover together
    (null where the rim holds a part of the block only). at and last are the block's starts.
    """
    ddl = "_id long, _h long, at int, last int, alone int, core long, hull long"
    schema = _arrow(ddl)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = (b.column(k).to_numpy() for k in (0, 1))
            _, syms, offsets, _, _ = symbols(b, unit, 2)
            for row, rims in enumerate(b.column(3).to_pylist()):
                own = syms[offsets[row] : offsets[row + 1]]
                for part in near(sorted(rims, key=lambda r: r["at"]), length):
                    base = part[0]["at"]
                    names = windows.Names(piece_symbols(own, [(0, base, part[-1]["last"] + length)], unit))
                    at, last, anchor, alone = (np.array([r[k] for r in part]) for k in ("at", "last", "anchor", "alone"))
                    low, high = (anchor - last) // block, (anchor - at) // block  # numbers of the blocks, backwards from the anchor
                    n = high - low + 1
                    run = np.repeat(np.arange(len(part)), n)
                    j = np.repeat(low, n) + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
                    end, begin = anchor[run] - j * block, anchor[run] - (j + 1) * block + 1
                    first, final = np.maximum(begin, at[run]), np.minimum(end, last[run])
                    core = names.at(end - base, length - block + 1)
                    full = (first == begin) & (final == end)
                    hull = np.zeros(len(run), np.int64)
                    hull[full] = names.at(begin[full] - base, length + block - 1).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (np.full(len(run), ids[row]), np.full(len(run), hashes[row]), first.astype(np.int32), final.astype(np.int32), alone[run].astype(np.int32), core.view(np.int64))]
                        + [pa.array(hull, mask=~full)],
                        schema=schema,
                    )

    return docs.mapInArrow(scan, ddl)


def near(rims: list[dict], length: int) -> Iterator[list[dict]]:
    """Sorted rims, as many at a time as lie within a piece."""
    k = 0
    while k < len(rims):
        j = k + 1
        while j < len(rims) and rims[j]["last"] + length - rims[k]["at"] <= windows.PIECE:
            j += 1
        yield rims[k:j]
        k = j


def repeated(ws: Workspace, docs: DataFrame, unit: str, length: int, gram: int, match: Callable[[Workspace, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): the texts that have a repeated anchor (key, text), and their covered spans (key, lo, hi) in symbols.

    docs: _id, _h, text; spans may overlap and come more than once. match: gets texts with
    the rims in them (key, text, rims array<struct<at, last, anchor, alone>>) and returns the
    spans (key, lo, hi) of windows of runs that occur once (alone) that equal another one.
    A record that comes twice gives runs that occur twice, so its own rims never count alone.
    """
    found = ws.save(runs(docs, unit, length, gram))
    often = ws.save(found.groupBy("anchor").count().filter("count > 1").select("anchor"))
    again = ws.save(found.join(often, "anchor"))
    ws.drop(found, often)
    sorts = ws.save(again.groupBy("anchor", "sort").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "at")).alias("one")))
    mixed = ws.save(sorts.groupBy("anchor").agg(F.count("*").alias("sorts")).filter("sorts > 1").select("anchor", F.lit(1).alias("mixed")))
    known = ws.save(sorts.join(mixed, "anchor", "left").select("anchor", "sort", (F.col("n") == 1).alias("alone"), F.coalesce("mixed", F.lit(0)).alias("mixed"), "one").filter("NOT alone OR mixed = 1"))
    ws.drop(sorts, mixed)
    places = ws.save(
        again.join(known, ["anchor", "sort"])
        .select(*KEY, "at", "last", "place", F.col("alone").cast("int").alias("alone"), (~F.col("alone")).alias("all"), ((F.col("mixed") == 1) & (F.col("alone") | (F.col("one") == F.struct(*KEY, "at")))).alias("rim"))
        .filter("all OR rim")
    )
    ws.drop(again, known)
    # By text: bounded by the text's own length.
    by_text = places.groupBy(*KEY).agg(F.collect_set(F.when(F.col("rim"), F.struct("at", "last", F.col("place").alias("anchor"), "alone"))).alias("rims"))
    texts = ws.save(docs.join(by_text, KEY))
    rims = ws.save(match(ws, texts.filter(F.size("rims") > 0)))
    return texts.select(*KEY, "text"), places.filter("all").select(*KEY, F.col("at").alias("lo"), (F.col("last") + length).alias("hi")).union(rims)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*row_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def covered(spans: DataFrame) -> DataFrame:
    """(key, spans): the spans of each text in one array, bounded by the text's own length."""
    return spans.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"))


def without(texts: DataFrame, spans: DataFrame, unit: str, ddl: str, result: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple]) -> DataFrame:
    """One row for each text that has spans: the key and what ``result`` makes of it.

    result: gets the bytes of the text, its maximal removed spans in symbols (lo, hi), and
    the starts and ends of its words in bytes (empty where the symbols are bytes).
    """
    schema = _arrow(ddl)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, _, offsets, start, end = symbols(b, unit, 2)
            edges = text_bytes(b.column(2))[1]
            ids, hashes = (b.column(k).to_numpy() for k in (0, 1))
            values = b.column(3).flatten()
            lo, hi = (values.field(k).to_numpy() for k in (0, 1))
            at = b.column(3).offsets.to_numpy() - b.column(3).offsets[0].as_py()
            rows = []
            for k in range(b.num_rows):
                spans_lo, spans_hi = merged(lo[at[k] : at[k + 1]].astype(np.int64), hi[at[k] : at[k + 1]].astype(np.int64))
                own = slice(offsets[k], offsets[k + 1]) if len(start) else slice(0, 0)
                rows.append((ids[k], hashes[k], *result(data[edges[k] : edges[k + 1]], spans_lo, spans_hi, start[own] - edges[k], end[own] - edges[k])))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], t.type) for t in schema], schema=schema)

    return texts.join(covered(spans), KEY).select(*KEY, "text", "spans").mapInArrow(cut, ddl).dropDuplicates(KEY)


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted spans, joined where they overlap or touch."""
    if not len(lo):
        return lo, hi
    reach = np.maximum.accumulate(hi)
    new = np.concatenate(([True], lo[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return lo[first], reach[np.append(first[1:], len(lo)) - 1]
