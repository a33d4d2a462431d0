"""The pipeline's stages, one by one and together, on a small planted corpus."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghiklmnoprstuv") for _ in range(r.randint(3, 8))) for _ in range(900)]
    bad = ["vile", "scum", "hatred", "trash", "filth"]
    sentence = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    docs = [(i, sentence(80) + "\n" + sentence(40)) for i in range(300)]
    for i in range(0, 300, 10):  # toxic
        docs[i] = (i, docs[i][1] + " " + " ".join(r.choice(bad) for _ in range(12)))
    items = [(k, sentence(40)) for k in range(5)]
    docs += [(400 + k, sentence(30) + " " + t + " " + sentence(30)) for k, (_, t) in enumerate(items)]
    docs += [(500 + k, docs[k + 1][1]) for k in range(5)]  # exact copies
    docs += [(600 + k, docs[k + 11][1].replace(" ", " edited ", 1)) for k in range(5)]  # near copies
    docs = [(i, t + "\nsubscribe to our newsletter now") if 100 < i < 140 else (i, t) for i, t in docs]
    docs += [(700, None), (701, ""), (702, sentence(20_000))]
    at = str(tmp_path_factory.mktemp("sf"))
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    labels = [(i, 1, int(i % 10 == 0)) for i in range(300) if i % 3 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        ids[name] = {r[0] for r in docs.select("doc_id").collect()}
    every = {*range(300), *range(400, 405), *range(500, 505), *range(600, 605), 700, 701, 702}
    assert every - ids["toxicity"] == set(range(0, 300, 10))
    assert ids["line dedup"] == ids["toxicity"]
    text = spark.read.parquet(f"{folder}/stage1")
    assert text.filter("text LIKE '%newsletter%'").count() == 0
    assert text.filter(F.col("n_chars") != F.length("text")).count() == 0
    assert ids["line dedup"] - ids["SimHash near-dedup"] == {*range(500, 505), *range(600, 605), 701}
    assert ids["SimHash near-dedup"] - ids["benchmark decontamination"] == set(range(400, 405))
    assert ids["packing"] == ids["benchmark decontamination"]
    assert {r[0] for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()} == ids["packing"]


def test_empty(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        docs = docs if "text" not in out.columns else out


def test_documents_of_mostly_boilerplate_lose_it_and_near_copies_keep_their_lines(spark, folder):
    r = random.Random(9)
    words = lambda k: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(k))
    shared, own = "\n".join(words(15) for _ in range(4)), [words(40) for _ in range(8)]
    rows = [(i, f"{shared}\n{own[i]}") for i in range(8)]
    base = [words(12) for _ in range(15)]
    for i in range(8):
        copy = list(base)
        copy[i] = copy[i].replace(" ", " edited ", 1)
        rows.append((100 + i, "\n".join(copy)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {x["doc_id"]: (x["text"], x["n_chars"]) for x in corpus_pipeline.drop_boilerplate(spark, docs, folder).collect()}
    assert {i: out[i] for i in range(8)} == {i: (own[i], len(own[i])) for i in range(8)}
    assert all(out[i] == (t, len(t)) for i, t in rows[8:])


def test_nulls_repeats_and_odd_columns_go_through_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 40 OR doc_id > 600")
    more = spark.createDataFrame([(None, "a text without an id", None, None, None), (None, None, None, None, None), (7000, "the same row twice", "en", "s", 18), (7000, "the same row twice", "en", "s", 18), (7001, "", "en", "s", 0)], docs.schema)
    docs = docs.union(more).select("*", *[F.lit(1).alias(c) for c in ("a.b", "row", "_id", "_text", "score", "fp", "n_dropped", "bucket")])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns
            docs = out
    ids = [r["doc_id"] for r in out.collect()]
    assert ids.count(7000) == 1 and ids.count(None) == 2 and 7001 not in ids  # the null text, of a null id, stands for the empty ones
