from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quern.operators import suggest


def plain(asked, questions, least=300, most=2):
    """Every text against every other."""
    bag = lambda t: frozenset(re.findall(r"[^\W_]+", (t or "").lower()))
    sets = {bag(t) for _, t in questions} - {frozenset()}
    weight = lambda term: (len(sets) // max(1, sum(term in s for s in sets))).bit_length()
    known = {term: weight(term) for term in {w for s in sets for w in s} | {w for _, t in asked for w in bag(t)}}
    out = set()
    for ask, t in asked:
        best = {}
        for answer, text in questions:
            a, b = bag(t), bag(text)
            both, either = sum(known[w] for w in a & b), sum(known[w] for w in a | b)
            if both and both * 1000 >= either * least:
                best[answer] = max(best.get(answer, 0), both / either)
        out |= {(ask, k, v, n + 1) for n, (k, v) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:most])}
    return out


def run(spark, asked, questions, **more):
    made = suggest.suggestions(spark.createDataFrame(asked, "ask_id long, text string"), spark.createDataFrame(questions, "answer_id long, text string"), **more)
    return [(x["ask_id"], x["answer_id"], x["score"], x["place"]) for x in made.collect()]


@pytest.mark.parametrize("least", [100, 300, 700, 1000])
def test_as_every_text_with_every_other(spark, least):
    r = random.Random(least)
    words = ["the"] * 30 + ["of", "ß", "été"] * 6 + [f"w{k}" for k in range(25)]
    text = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 8)))
    questions = [(r.randint(1, 60), text()) for _ in range(250)] + [(k, "the") for k in range(900, 930)] + [(5, None), (6, ""), (7, "?!")]
    asked = [(k, text()) for k in range(60)] + [(100, "unknown words"), (101, None), (102, " , "), (103, "THE")]
    have = run(spark, asked, questions, least=least, split=7)
    assert len(have) == len(set(have)) and set(have) == plain(asked, questions, least)


def test_seats_bound_what_texts_share(spark):
    r = random.Random(5)
    sets = [[f"{99 - r.randint(1, 14):02}w{r.randint(0, 3000)}" for _ in range(r.randint(1, 70))] for _ in range(40)]
    sets = [sorted({m[2:]: m for m in s}.values()) for s in sets] + [[]]
    rows = spark.createDataFrame([(k, s, sum(99 - int(m[:2]) for m in s)) for k, s in enumerate(sets)], "id long, marks array<string>, weight long")
    each = suggest._posted(rows, 300).select("id", "codes", "seats").distinct()
    bound = {(x["id"], x["other"]): x["b"] for x in each.crossJoin(each.select(F.col("id").alias("other"), F.col("seats").alias("_seats"))).select("id", "other", suggest._seated().alias("b")).collect()}
    shared = lambda i, j: sum(99 - int(m[:2]) for m in set(sets[i]) & set(sets[j]))
    assert len(bound) == 40 * 40 and all(b >= shared(i, j) for (i, j), b in bound.items())
    assert sum(bound[i, j] for i, j in bound if i != j) < 0.4 * sum(shared(i, i) for i, j in bound if i != j)


def test_equal_scores_take_the_least_ids(spark):
    have = run(spark, [(1, "Opening hours?")], [(k, "opening hours") for k in range(40, 3, -1)], most=3)
    assert sorted(have) == [(1, 4, 1.0, 1), (1, 5, 1.0, 2), (1, 6, 1.0, 3)]


def test_empty_tables_and_bounds(spark):
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a")], []) == []
    with pytest.raises(ValueError):
        run(spark, [(1, "a")], [(1, "a")], least=0)


def test_decisions_from_scores(spark):
    questions = spark.createDataFrame([(1, "opening hours of the library"), (2, "opening hours of the laboratory"), (3, "parking")], "answer_id long, text string")
    asked = spark.createDataFrame([(1, "parking"), (2, "opening hours of the"), (3, "nothing known"), (4, None)], "ask_id long, text string")
    made = suggest.decisions(asked, suggest.suggestions(asked, questions), similarity=0.4)
    assert {(x["ask_id"], x["decision"], x["answer_id"]) for x in made.collect()} == {(1, "answer", 3), (2, "ambiguity", None), (3, "fallback", None), (4, "fallback", None)}
