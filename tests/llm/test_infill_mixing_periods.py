"""Operators 11 to 13 against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import infill, mixing, periods
from tests.llm.test_operators import corpus, empty, frame, got  # noqa: F401

sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# Fill-in-the-middle


def brute_infill(doc_id, text, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digits = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digits[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


ODD = [(300, "x <P> y"), (301, "a<S>"), (302, "<M>"), (303, "<" * 50 + "P>" * 3), (304, "naïve 𝄞𝄞 ends\r\n\tßx́ " * 9), (305, "𝄞"), (306, "a"), (307, "9" * 31), (308, "9" * 32), (309, "9" * 33), (310, " <\x00>" * 40), (None, "null id " * 20), (None, "other null id"), (None, None)]


@pytest.mark.parametrize("block", [1, 2, 32])
def test_infill(spark, block):
    rows = corpus() + ODD + [(None, "null id " * 20)] * 3
    made = infill.transform(frame(spark, rows), block=block)
    assert got(made) == sorted((brute_infill(*r) for r in rows), key=str)
    back = made.select(infill.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(r["t"] for r in back) == sorted(t or "" for _, t in rows)


def test_infill_forms_long_text_and_empty_table(spark, empty):  # noqa: F811
    assert infill.transform(empty).collect() == []
    rows = [(k, f"some text number {k}, and more of it") for k in range(400)] + [(1000 + k, "word, " * 300_000) for k in range(3)]
    out = {r["doc_id"]: tuple(r) for r in infill.transform(frame(spark, rows)).collect()}
    assert out == {i: brute_infill(i, t) for i, t in rows}
    share = [sum(r[2] == f for r in out.values()) / len(out) for f in ("plain", "spm", "psm")]
    assert abs(share[0] - 0.1) < 0.05 and abs(share[1] - 0.18) < 0.06


def test_infill_repeats_are_merged_before_the_window(spark):
    """A row that stands many times is summed along once; other columns aren't read."""
    df = frame(spark, [(7, "one, two, three, four " * 30)] * 500)
    out = infill.transform(df).distinct().collect()
    assert [tuple(r) for r in out] == [brute_infill(7, "one, two, three, four " * 30)]


# Mixing


def brute_targets(sizes: dict, weights=(5, 2, 1), epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, clamped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in clamped]
        if not free:
            return {s: float(epochs * sizes[s]) for s in names}
        unit = (total - sum(epochs * sizes[s] for s in clamped)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > epochs * sizes[s]}
        if not over:
            return {s: float(epochs * sizes[s]) if s in clamped else weight[s] * unit for s in names}
        clamped |= over


def mixed_rows(seed=5):
    r = random.Random(seed)
    text = lambda n: " ".join("w" for _ in range(n))
    rows = [(k, text(r.randint(0, 60)), r.choice(["big"] * 9 + ["b", "é", "Z", None, "tiny"])) for k in range(500)]
    rows += [(900, text(2), "one"), (901, None, "void"), (902, "", "void"), (903, text(4000), "long")]
    rows += [(None, text(9), "big"), (None, text(9), "big"), (None, text(8), "big"), (3, rows[3][1], rows[3][2])]
    return rows


def source_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("target", F.lit(1)).repartition(4)


def test_mixing(spark):
    rows = mixed_rows()
    out = mixing.mix(source_frame(spark, rows), keep=["source", "text"]).collect()
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    assert len(out) == len(rows) and {x["source"]: x["source_size"] for x in out} == sizes
    assert any(want[s] == 3 * sizes[s] > 0 for s in sizes) and any(0 < want[s] < 3 * sizes[s] for s in sizes)
    for s in sizes:
        own = [x for x in out if x["source"] == s]
        assert all(x["target"] == pytest.approx(want[s], rel=1e-12) for x in own)
        assert sum(x["taken"] for x in own) == int(want[s] + 0.5)
        assert len([x for x in own if 0 < x["part"] < x["size"]]) <= 1
    assert all(0 <= x["taken"] <= 3 * x["size"] for x in out)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    again = mixing.mix(source_frame(spark, rows).repartition(2), keep=["source", "text"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mixing_gives_the_texts(spark):
    rows = [(1, "a b  c d", "s"), (2, "e f", "t"), (3, "g", "t")]
    mixed = mixing.mix(source_frame(spark, rows), keep=["text", "source"])
    taken = {x["doc_id"]: x["taken"] for x in mixed.collect()}
    texts: dict = {}
    for x in mixing.repeated(mixed).orderBy("epoch").collect():
        texts.setdefault(x["doc_id"], []).append(x["text"])
    assert {i: sum(len(t.split()) for t in ts) for i, ts in texts.items()} == {i: n for i, n in taken.items() if n}
    assert all(t.split() == dict((i, t.split()) for i, t, _ in rows)[i][: len(t.split())] for i, ts in texts.items() for t in ts)


def test_mixing_of_one_source_of_nothing_and_of_repeats(spark):
    assert mixing.mix(source_frame(spark, [])).collect() == []
    assert [tuple(x)[1:5] for x in mixing.mix(source_frame(spark, [(1, None, None), (2, " ", None)])).collect()] == [(0, 0, 0.0, 0)] * 2
    same = mixing.mix(source_frame(spark, [(None, "x y z", "s")] * 300 + [(k, "p", "t") for k in range(100)])).collect()
    assert sum(x["taken"] for x in same if x["source_size"] == 900) == 714 and sum(x["taken"] for x in same if x["source_size"] == 100) == 286
    assert len([x for x in same if 0 < x["part"] < x["size"]]) <= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=12))
def test_water_filling_is_feasible(sizes):
    want = brute_targets({f"{k:02}": n for k, n in enumerate(sizes)})
    assert sum(want.values()) == pytest.approx(sum(sizes))


# Runs


def brute_runs(w):
    out: dict = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                out.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in out.items())


def brute_periods(doc_id, text, plant=False):
    words = (text or "").encode().split()
    n = len(words)
    if plant and doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(kept)


stretches = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 7)), max_size=4)


@settings(max_examples=150, deadline=None)
@given(stretches, st.integers(1, 3))
def test_runs(parts, twice):
    w = [x for part, k in parts for x in part * k] * twice
    assert periods.runs_of(w) == brute_runs(w) == periods.search([b"%d" % x for x in w])


def test_factors_are_the_longest_that_start_earlier():
    r = random.Random(4)
    for _ in range(300):
        w = [r.randrange(3) for _ in range(r.randint(1, 40))]
        at = 0
        for a, b, source in periods.factors(w):
            longest = max((k for j in range(a) for k in range(len(w) - a + 1) if w[j : j + k] == w[a : a + k]), default=0)
            assert a == at and b - a == max(1, longest) and (source < 0 or (source < a and w[source : source + b - a] == w[a:b]))
            at = b
        assert at == len(w)


def test_periods_of_texts(spark, empty):  # noqa: F811
    r = random.Random(8)
    rows = corpus() + [(200 + k, " ".join(r.choice("ab") for _ in range(r.randint(0, 90)))) for k in range(150)]
    rows += [(400, "x " * 5), (401, "x " * 6), (402, "x y " * 4), (403, "a x y x y x y x b"), (404, "q\tq\nq\rq\x0bq\x0cq"), (None, "z " * 20), (None, None), (405, "é " * 7 + " "), (401, "x " * 6)]
    for plant in (False, True):
        assert got(periods.find(frame(spark, rows), plant=plant)) == sorted((brute_periods(i, t, plant) for i, t in rows), key=str)
    assert periods.find(empty).collect() == []


def test_periods_of_a_long_text(spark):
    r = random.Random(9)
    block = [str(r.randrange(4000)) for _ in range(9000)]
    words = [str(r.randrange(10**6)) for _ in range(50_000)] + block * 5 + ["end"] * 40_000 + block
    out = periods.find(frame(spark, [(1, " ".join(words))])).collect()[0]
    assert (out["n_runs"], out["start"], out["length"], out["period"], out["exponent_milli"]) == (2, 50_000, 45_000, 9000, 5000)
    assert out["collapsed_sha256"] == sha(" ".join(words[:59_000] + ["end"] + block))
