"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words, word beginnings and word ends learns from texts known to
be toxic and from texts about which nothing is known. With the share of toxic texts among
the latter (the class prior p), the risk on clean texts is the risk of calling the
unlabelled ones clean, less p times that of calling the toxic ones clean; the estimate is
held at zero or more, because below it the model only memorises.

Fitting reads a bounded sample, the texts of least hash; scoring reads everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import windows
from quern.llm.common import Workspace, text_bytes

#: Hashed features, and the most texts of either kind that fitting takes: both bound what the driver holds.
BUCKETS, POSITIVES, UNLABELLED = 1 << 18, 3000, 6000
_EDGES = (4, 6, 8)
#: What the values of a text are multiplied by after they have been brought to length 1.
SCALE = 8.0
_KINDS = 1 + 2 * len(_EDGES)


def _wordly(data: np.ndarray) -> np.ndarray:
    return (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of texts, in order: the text of each distinct (text, word), its count, and _KINDS buckets for it."""
    low = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    data, offsets = text_bytes(low)
    at = 0
    while at < len(offsets) - 1:  # as many whole texts as fit in a piece
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + windows.PIECE, "right")) - 1)
        part, cuts = data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        start, end, name, count = windows.words(np.where(_wordly(part), part, np.uint8(32)), cuts)
        text = np.repeat(np.arange(stop - at), np.diff(count))
        order = np.lexsort((name, text))
        t, n = text[order], name[order]
        new = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (n[1:] != n[:-1])))) if len(t) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(t)))
        one = order[new]
        names = windows.Names(windows.symbols_of_bytes(part))
        s, e = start[one], end[one]
        got = [name[one]]
        for k in _EDGES:
            size = np.minimum(e - s, k)
            got += [names.at(s, size) + np.uint64(k), names.at(e - size, size) + np.uint64(1000 + k)]
        yield at + t[new], times, (windows.mix(np.stack(got, 1)) >> np.uint64(46)).astype(np.int32)
        at = stop


def weigh(times: np.ndarray) -> np.ndarray:
    return np.log1p(np.minimum(times, 50))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def margins(self, column: pa.Array) -> np.ndarray:
        total, norm = np.zeros(len(column)), np.zeros(len(column))
        for text, times, buckets in features(column):
            w = weigh(times)
            total += np.bincount(text, w * self.weights[buckets].sum(1), len(column))
            norm += np.bincount(text, w * w * _KINDS, len(column))
        return total / np.sqrt(np.maximum(norm, 1e-9)) + self.bias


def telling(p: np.ndarray, u: np.ndarray, p_n: int, u_n: int, most: int, least: int = 5) -> np.ndarray:
    """Sorted buckets whose share of texts differs most between the two kinds, by a two-sample z; each in ``least`` toxic texts or more.

    p, u: of the p_n toxic and u_n unlabelled texts, how many hold each bucket.
    """
    share = (p + u) / (p_n + u_n)
    z = np.abs(p / p_n - u / u_n) / np.sqrt(np.maximum(share * (1 - share) * (1 / p_n + 1 / u_n), 1e-12))
    z[p < least] = 0
    return np.sort(np.argsort(-z, kind="stable")[:most])


def blank(prior: float) -> Model:
    """Knows the prior alone."""
    return Model(np.zeros(BUCKETS, np.float32), float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))), prior)


def fit(rows: pd.DataFrame, used: np.ndarray, prior: float, rounds: int = 200, rate: float = 0.1, shrink: float = 1e-4) -> Model:
    """rows: positive (bool), and for each text the arrays at (places in used) and value. Adam on the whole sample."""
    model, positive, n = blank(prior), rows["positive"].to_numpy(bool), len(rows)
    text = np.repeat(np.arange(n), [len(x) for x in rows["at"]])
    at, value = np.concatenate(list(rows["at"])).astype(np.int64), np.concatenate(list(rows["value"])).astype(np.float64)
    p_n, u_n = positive.sum(), (~positive).sum()
    w, b = np.zeros(len(used)), model.bias
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for k in range(1, rounds + 1):
        g = np.bincount(text, w[at] * value, n) + b
        called = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        risk = np.logaddexp(0, g)  # of calling a text clean
        slope = np.where(positive, -prior * called / p_n, called / u_n)
        if risk[~positive].mean() < prior * risk[positive].mean():  # below zero: step back
            slope = -slope
        else:
            slope += np.where(positive, -prior * (1 - called) / p_n, 0.0)
        grad = np.append(np.bincount(at, slope[text] * value, len(used)) + shrink * w, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    model.weights[used] = SCALE * w
    model.bias = float(b)
    return model


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, most: int = 1000) -> Model:
    """Fits on at most so many toxic and unlabelled texts outside the held-out fold, those of least hash.

    Labels of 0 serve for one number, the share of toxic texts; no text is taken as clean.
    Spark counts features and picks the ``most`` telling ones; only those of the sample go to
    the driver. Without both kinds of text, or a prior inside (0, 1), the model knows the
    prior alone. A null id or label says nothing; of labels of one id the toxic one holds; a
    document whose id comes twice is read as often.
    """
    ws = Workspace(docs.sparkSession, "toxicity")
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("_toxic"))
    prior = known.agg(F.avg((F.col("_toxic") == 1).cast("double"))).first()[0] or 0.0
    rank = F.xxhash64(F.col(id_col), F.lit(11))
    toxic = known.filter("_toxic = 1").select(id_col, F.lit(True).alias("positive")).orderBy(rank, id_col).limit(positives)
    ids = docs.filter(~held_out(id_col)).select(id_col)
    other = ids.join(labels.select(id_col), id_col, "left_anti").select(id_col, F.lit(False).alias("positive")).orderBy(rank, id_col).limit(unlabelled)
    chosen = ws.save(toxic.union(other))  # at most positives + unlabelled ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = [([], [])] * b.num_rows
            for text, times, buckets in features(b.column(2)):
                cuts = np.flatnonzero(np.diff(text)) + 1
                for k, x, y in zip(text[np.concatenate(([0], cuts))] if len(text) else [], np.split(times, cuts), np.split(buckets, cuts), strict=False):
                    rows[k] = (x, y.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in rows], pa.list_(pa.int32())), pa.array([y for _, y in rows], pa.list_(pa.int32()))], ["id", "positive", "times", "buckets"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(chosen.select(F.col(id_col).cast("long").alias("id"), "positive")), "id").select("id", "positive", "text")
    sample = ws.save(texts.mapInArrow(read, "id long, positive boolean, times array<int>, buckets array<int>"))
    p_n, u_n = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not (p_n and u_n and 0 < prior < 1):
        return blank(prior)
    held = sample.select("positive", F.explode(F.array_distinct("buckets")).alias("bucket")).groupBy("bucket").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")).toPandas()  # at most BUCKETS rows
    p, u = (np.bincount(held["bucket"], held[c], BUCKETS) for c in ("p", "u"))
    used = telling(p, u, p_n, u_n, most)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.full(BUCKETS, -1)
        at[used] = np.arange(len(used))
        for b in batches:
            places, values = [], []
            for times, buckets in zip(b.column(2), b.column(3), strict=True):
                own = weigh(times.values.to_numpy())
                spot = at[buckets.values.to_numpy()]
                value = (SCALE * own / np.sqrt(max((own * own).sum() * _KINDS, 1e-9))).repeat(_KINDS)
                places.append(spot[spot >= 0])
                values.append(value[spot >= 0])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], ["id", "positive", "at", "value"])

    rows = sample.mapInArrow(pick, "id long, positive boolean, at array<int>, value array<double>").toPandas()
    return fit(rows.sort_values(["id", "positive"], kind="stable"), used, prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id_col, held_out, score, predicted), or the columns in keep and score. Null and wordless texts get the score of the bias alone; a null id is in the fold of the empty text; rows that repeat come out as often."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats: 1 MB
    cols = keep or [id_col]
    plain = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(cols)], F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = 1 / (1 + np.exp(-np.clip(shared.value.margins(b.column(b.num_columns - 1)), -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], [*b.schema.names[:-1], "_score"])

    out = plain.mapInArrow(run, T.StructType([*plain.schema.fields[:-1], T.StructField("_score", T.DoubleType())]))
    out = out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(cols)], F.col("_score").alias("score"))
    return out if keep else out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
