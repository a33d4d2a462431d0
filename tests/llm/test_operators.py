"""Every operator against a plain version, on a table with nulls, empties, ties, repeats, long texts and clashing columns."""

from __future__ import annotations

import time
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import components, decontaminate, graph, licences, lines, packing, passages, queries, simhash, suffixes, toxicity, urls
from quern.llm.common import Workspace
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, _id string, bin int, word string, `a.b` int"


def corpus(seed: int = 3, n: int = 60) -> list[tuple[int | None, str | None]]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghiklmnoprstuvé") for _ in range(r.randint(2, 8))) for _ in range(400)]
    sentence = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared = [sentence(60), sentence(45), sentence(36)]
    out: list[tuple[int | None, str | None]] = []
    for i in range(n):
        text = sentence(r.randint(1, 120))
        if i % 4 == 0:
            text += " " + r.choice(shared) + "  " + sentence(r.randint(0, 30))
        if i % 7 == 0:
            text = text.replace(" ", "\n", 3).title()
        out.append((i, text))
    words = out[5][1].split()
    out += [(100, out[3][1]), (101, out[3][1]), (102, " ".join([*words[:20], "changed", *words[21:]])), (103, None), (104, ""), (105, " \t\n "), (106, "x"), (107, " ".join([shared[0]] * 3))]
    out += [(108, sentence(3000) + " " + shared[1] + " " + sentence(2000)), (109, "ab" * 900), (110, out[8][1]), (110, out[8][1])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, "f", "k", 3, "w", 1) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


def same(df, want) -> None:
    assert got(df) == sorted(want, key=str)


def test_suffixes(docs, empty):
    same(suffixes.remove_repeats(docs, length=100, gram=25), brute.suffixes(corpus(), 100))
    same(suffixes.remove_repeats(docs, length=400), brute.suffixes(corpus(), 400))
    same(suffixes.remove_repeats(empty), [])


def test_suffixes_hot_passage(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcd") for _ in range(5))
    hot = " ".join(word() for _ in range(90))
    rows = [(i, " ".join(word() for _ in range(r.randint(0, 20))) + hot[r.randint(0, 60) :] + word()) for i in range(40)] + [(50, "a" * 900)]
    same(suffixes.remove_repeats(frame(spark, rows), length=400), brute.suffixes(rows, 400))


def test_passages(docs, empty):
    same(passages.remove_passages(docs, length=35), brute.passages(corpus(), 35))
    same(passages.remove_passages(docs, length=12, gram=4), brute.passages(corpus(), 12))
    same(passages.remove_passages(empty), [])


def test_null_ids(spark):
    rows = [(None, "a b c d e f g h"), (None, None), (7, "a b c d e f g h")]
    same(passages.remove_passages(frame(spark, rows), length=5, gram=2), brute.passages(rows, 5))
    same(suffixes.remove_repeats(frame(spark, rows), length=10, gram=4, block=4), brute.suffixes(rows, 10))
    assert len(got(simhash.near_duplicates(frame(spark, rows)))) == 3
    assert len(got(packing.pack(frame(spark, rows)))) == 3
    assert len(got(lines.drop_lines(frame(spark, rows)))) == 3


def test_simhash(docs, empty):
    want = brute.simhash(corpus())
    for i, fp, c in got(simhash.near_duplicates(docs)):
        assert (fp, c) == want[i]
    same(simhash.near_duplicates(empty), [])


@pytest.mark.parametrize(("budget", "n"), [(4, 700), (8, 700)])
def test_trie_join(spark, budget, n):
    r = np.random.default_rng(budget)
    base = r.integers(0, 1 << 63, 40, np.int64)
    fps = {int(b) ^ sum(1 << int(k) for k in r.choice(63, r.integers(0, budget + 2), replace=False)) for b in base for _ in range(n // 40)} | {0, 1, -1}
    want = brute.components(sorted(fps), [(a, b) for a, b in combinations(sorted(fps), 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= budget])
    ws = Workspace(spark, "test")
    links = simhash.link_forest(ws, spark.createDataFrame([(x,) for x in fps], "fp long"), budget)
    found = dict(got(components.components(ws, links)))
    assert {x: found.get(x, x) for x in fps} == want


@pytest.mark.parametrize("full", [1, 1 << 20])
def test_subtries_dealt_on_find_the_same_links(spark, monkeypatch, full):
    r = np.random.default_rng(5)
    fps = sorted({int(x) ^ (int(y) << 3) ^ (int(z) << 40) for x in r.integers(0, 1 << 62, 8, np.int64) for y in range(12) for z in range(12)})
    want = brute.components(fps, [(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 3])
    monkeypatch.setattr(simhash, "FULL", full)
    monkeypatch.setattr(simhash, "max", lambda *x: x[1] if x[0] == 256 else max(*x), raising=False)  # cells of one at full = 1
    ws = Workspace(spark, "test")
    found = dict(got(components.components(ws, simhash.link_forest(ws, spark.createDataFrame([(x,) for x in fps], "fp long"), 3))))
    assert {x: found.get(x, x) for x in fps} == want


def test_one_of_each(spark, docs, empty):
    r = random.Random(2)
    base = [" ".join(str(r.randint(0, 9999)) for _ in range(200)) for _ in range(12)]
    rows = []
    for k, text in enumerate(base):
        for j in range(5):
            w = text.split()
            if j:
                w[r.randrange(200)] = "edit"
            rows.append((k * 10 + j, " ".join(w)))
    rows += [(900, rows[0][1]), (901, None), (902, ""), (903, rows[0][1]), (903, rows[0][1])]
    kept = simhash.one_of_each(frame(spark, rows))
    assert sorted(x["doc_id"] for x in kept.collect()) == [*range(0, 120, 10), 901]
    assert kept.columns == docs.columns
    assert got(simhash.one_of_each(empty)) == []


def test_one_of_each_asks_for_the_similarity(spark):
    r = random.Random(12)
    word = lambda: f"w{r.randint(0, 10**6)}"
    sets = lambda t: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}
    rows = []
    for k in range(30):
        base = [word() for _ in range(200)]
        rows.append((k * 10, " ".join(base)))
        for j, cut in enumerate((194, 185, 165, 150), 1):  # 0.94, 0.86, 0.69, 0.58
            rows.append((k * 10 + j, " ".join(base[:cut] + [word() for _ in range(200 - cut)])))
    links = [(a, b) for (a, x), (b, y) in combinations(rows, 2) if len(sets(x) & sets(y)) >= 0.8 * len(sets(x) | sets(y))]
    want = set(brute.components([i for i, _ in rows], links).values())
    assert {x["doc_id"] for x in simhash.one_of_each(frame(spark, rows)).collect()} == want


@pytest.mark.parametrize("members", [2, 32])
def test_large_groups_lose_no_link_and_meet_few_pairs(spark, monkeypatch, members):
    """Texts far from the hub and from each other, some with near copies, some in chains that reach the hub's copies."""
    monkeypatch.setattr(simhash, "MEMBERS", members)
    r = random.Random(members)
    base = list(range(100))
    new = lambda s, n: {*r.sample(sorted(s), len(s) - n), *(r.randint(10**3, 10**15) for _ in range(n))}
    sets = [set(base)]
    for _ in range(150):
        far = new(sets[0], r.randint(9, 40))
        sets += [far] + [new(far, r.randint(1, 14)) for _ in range(r.choice([0, 0, 1]))]
    for _ in range(40):
        sets.append(new(r.choice(sets), r.randint(1, 14)))
    sets.append({-1, -2})
    links = [(i, j) for (i, x), (j, y) in combinations(enumerate(sets), 2) if len(x & y) >= 0.8 * len(x | y)]
    want = brute.components(list(range(len(sets))), links)
    met = []
    own = simhash.alike
    monkeypatch.setattr(simhash, "alike", lambda ws, pairs, *a: met.append(pairs.count()) or own(ws, pairs, *a))
    groups = spark.createDataFrame([(g, i) for i in range(len(sets)) for g in ((1, 2) if i % 3 else (1,))], "g long, _h long")
    rows = spark.createDataFrame([(i, len(x), list(x)) for i, x in enumerate(sets)], "_h long, n int, s array<long>")
    found = dict(got(simhash.near_links(Workspace(spark, "x"), groups, spark.createDataFrame([], "a long, b long"), rows, 0.8)))
    assert {i: found.get(i, i) for i in want} == want
    assert sum(met) < 6 * len(sets)


@pytest.mark.parametrize("seats", [64, 1 << 24])
def test_a_member_costs_its_own_shingles_not_its_hubs(spark, monkeypatch, seats):
    """A long hub and many short members: rows for what they differ in stay within a quarter of the members' own shingles, whatever elements share a seat."""
    monkeypatch.setattr(simhash, "SEATS", seats, raising=False)
    r = random.Random(seats)
    hub = {r.randint(1, 10**15) for _ in range(3000)}
    core = r.sample(sorted(hub), 20)
    sets = [hub]
    for _ in range(60):
        own = {*core, *(r.randint(1, 10**15) for _ in range(20))}
        n = r.randint(0, 4)
        sets += [own, {*r.sample(sorted(own), 40 - n), *(r.randint(1, 10**15) for _ in range(n))}]
    want = {(j, i) for (i, x), (j, y) in combinations(enumerate(sets), 2) if len(x & y) >= 0.8 * len(x | y)}
    assert len(want) >= 60
    made = []
    own_save = Workspace.save

    def save(self, df, *a):
        out = own_save(self, df, *a)
        if "e" in out.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(Workspace, "save", save)
    ws = Workspace(spark, "x")
    rows = spark.createDataFrame([(i, len(x), list(x)) for i, x in enumerate(sets)], "_h long, n int, s array<long>")
    members = spark.createDataFrame([(0, i, i, True) for i in range(1, len(sets))], "b long, a long, root long, out boolean")
    met = {tuple(x) for x in simhash._apart(ws, members, rows, 0.8).collect()}
    assert want - {(i, 0) for i in range(len(sets))} <= met
    assert max(made) <= sum(len(x) // 4 + 1 for x in sets[1:])


def test_vectors(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(60, 16))
    rows = [(i, (base[i % 60] + (0.0 if i % 5 else 0.06) * r.normal(size=16)).tolist()) for i in range(300)]
    rows += [(400, None), (401, [0.0] * 16), (402, [None] + [1.0] * 15), (403, [float("nan")] + [1.0] * 15), (404, []), (405, [float("inf")] + [1.0] * 15), (406, (base[3] * 7).tolist())]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, id int")
    want = brute.vectors(rows, 0.95)
    assert {i: (n, c) for i, n, c, _ in got(graph.near_vectors(df, cell=64))} == want
    assert all(k == (i == c) for i, _, c, k in got(graph.near_vectors(df)))
    assert got(graph.near_vectors(df.filter("vec_id < 0"))) == []
    assert got(graph.near_vectors(df.filter("vec_id = 400"))) == [(400, 0, 400, True)]


def test_vectors_with_null_and_repeated_ids_and_other_lengths(spark):
    r = np.random.default_rng(8)
    base = r.normal(size=(40, 8))
    rows = [(i, base[i % 40].tolist()) for i in range(80)] + [(None, base[0].tolist()), (5, base[1].tolist()), (5, base[1].tolist()), (90, [1.0, 2.0]), (91, [1.0, 2.0]), (None, r.normal(size=8).tolist())]
    out, recall = graph.searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell=16)
    done = got(out)
    assert len(done) == len(rows) and recall >= 0.9
    assert (0, 2, 0, True) in done and (None, 2, 0, False) in done  # two copies and the nameless one
    assert [x for x in done if x[0] == 5] == [(5, 1, 5, True), (5, 4 - 1, 1, False), (5, 4 - 1, 1, False)] or sorted(x[1] for x in done if x[0] == 5) == [1, 3, 3]
    assert (90, 0, 90, True) in done and (91, 0, 91, True) in done  # of a length that isn't the common one
    assert (None, 0, None, True) in done


def test_linked_vectors_over_many_clusters(spark):
    r = np.random.default_rng(4)
    centre = r.normal(size=(150, 24))
    rows = [(i, (centre[i % 150] + 0.04 * r.normal(size=24) * (i % 3)).tolist()) for i in range(1500)]
    want = brute.vectors(rows, 0.95)
    out, recall = graph.searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell=40)
    done = {i: (n, c) for i, n, c, _ in got(out)}
    true, found = sum(n for n, _ in want.values()), sum(n for n, _ in done.values())
    assert true > 5000 and 0.9 * true <= found <= true and recall >= 0.9
    assert all(done[i][0] <= want[i][0] for i in done)


def test_audit_counts_vectors_whose_links_were_all_missed(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(3000, 16))
    base[1::30] = base[::30] + 0.01 * r.normal(size=(100, 16))  # 100 pairs among 3000
    vectors = spark.createDataFrame([(i, v.tolist(), 5000 if i == 0 else 1) for i, v in enumerate(base)], "id long, v array<double>, copies long")
    found = [(i, 5000 if i == 1 else 1, 1) for k in range(80) for i in (30 * k, 30 * k + 1)]  # one in five is missed wholly
    assert graph.audit(vectors, spark.createDataFrame(found, "id long, n long, links long"), 0.95) == pytest.approx(0.8, abs=0.05)


def test_rare_links_count_for_both_ends(spark):
    r = np.random.default_rng(11)
    v = r.normal(size=(20_000, 16))
    v[1:1000:2] = v[:1000:2] + 0.05 * r.normal(size=(500, 16))  # 500 pairs among 20,000
    u = graph.unit(v)
    true = np.concatenate([(u[k : k + 1000] @ u.T >= 0.95).sum(1) - 1 for k in range(0, 20_000, 1000)])
    out, recall = graph.searched(spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>"), cell=64)
    done = {i: (n, c) for i, n, c, _ in got(out)}
    n = np.array([done[i][0] for i in range(20_000)])
    assert true.sum() >= 900 and (n <= true).all() and n.sum() >= 0.9 * true.sum() and recall >= 0.9
    alone = [i for i in range(0, 1000, 2) if true[i] == true[i + 1] == 1]
    assert len(alone) > 400 and all(done[i] == (done[i + 1][0], i) for i in alone if done[i][0] or done[i + 1][0])
    assert all((n > 0) == (len(x) > 1) for x in _classes(done) for n, _ in x)


def _classes(done: dict) -> list[list]:
    by: dict = {}
    for n, c in done.values():
        by.setdefault(c, []).append((n, c))
    return list(by.values())


def test_a_crowd_of_near_vectors_over_many_lots(spark):
    r = np.random.default_rng(12)
    crowd = r.normal(size=12) + 0.02 * r.normal(size=(400, 12))  # all linked with all
    rows = list(enumerate([*crowd.tolist(), *r.normal(size=(300, 12)).tolist()]))
    out, _ = graph.searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell=24)
    done = {i: (n, c) for i, n, c, _ in got(out)}
    want = brute.vectors(rows, 0.95)
    assert sum(n for n, _ in done.values()) >= 0.98 * sum(n for n, _ in want.values()) and all(done[i][0] <= want[i][0] for i in done)
    assert sum(n for n, _ in done.values()) % 2 == 0  # each link counts twice


def test_audit_is_bounded_and_tells_its_interval(spark):
    r = np.random.default_rng(13)
    base = r.normal(size=(2000, 16))
    base[1:400:2] = base[:400:2] + 0.01 * r.normal(size=(200, 16))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "id long, v array<double>")
    none = spark.createDataFrame([], "id long, links long")
    some = graph.audited(vectors, spark.createDataFrame([(i, 1) for i in range(360)], "id long, links long"), 0.95, most=300, asked_most=1000)
    assert some.asked == 1000 and 100 < some.linked < 300 and some.low < some.recall == pytest.approx(0.9, abs=0.06) and some.recall < some.high < 1
    empty = graph.audited(vectors.filter("id >= 400"), none, 0.95, asked_most=500)
    assert empty == (500, 0, 0, 0, 1.0, 0.0, 1.0)


def test_robust_prune_leaves_out_what_a_neighbour_covers():
    u = graph.unit(np.array([[1, 0.0], [1, 0.1], [1, 0.2], [1, -0.5]]))
    assert graph.robust_prune(u, degree=3, pool=3)[0].tolist()[:2] == [1, 3]


def test_leaks(spark, docs, empty):
    texts = corpus()
    item = texts[10][1].split()
    items = [(1, texts[20][1]), (2, " ".join([*item[:4], "other", *item[5:]])), (3, None), (4, ""), (5, texts[11][1] + " zzz"), (6, "never seen words here at all")]
    df = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    found = {(d, i): k for d, i, _, _, k in got(decontaminate.matches(docs, df))}
    assert found == brute.leaks(texts, items)
    gone = {d for d, _ in found}
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, df).collect()) == sorted(i for i, _ in texts if i not in gone)
    assert got(decontaminate.matches(empty, df)) == []
    assert got(decontaminate.matches(docs, df.filter("item_id = 3"))) == []


def test_leaks_at_the_full_number_of_edits():
    for n in (6, 15, 40):
        walks = decontaminate.walks_for(decontaminate.errors(n, 0.8))
        assert decontaminate.measured(n, 0.8, 150, walks)[-1] >= decontaminate.RECALL


def test_leaks_with_null_and_repeated_ids_and_several_runs(spark, monkeypatch):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    items = [(k % 3, " ".join(word() for _ in range(12))) for k in range(6)]
    rows = [(None, f"{word()} {items[0][1]} {word()}"), (1, items[1][1]), (1, items[1][1]), (2, " ".join(word() for _ in range(5000)) + " " + items[4][1]), (3, word())]
    df = spark.createDataFrame(items, "item_id long, text string")
    one = got(decontaminate.matches(frame(spark, rows), df))
    assert [(d, i) for d, i, *_ in one] == [(1, 1), (1, 1), (2, 1), (None, 0)]
    monkeypatch.setattr(decontaminate, "RUN_WORDS", 20)
    assert got(decontaminate.matches(frame(spark, rows), df)) == one
    assert [x["doc_id"] for x in decontaminate.clean(frame(spark, rows), df).collect()] == [3]


def test_licences(spark, empty):
    rows = [
        (1, "Licensed Under the MIT-License; cc by nc, CC BY NC 4.0"), (2, None), (3, ""), (4, "apache license version 2 apache\nlicense, version 2"),
        (5, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception\ncode"), (6, "SPDX-License-Identifier: ) nonsense"), (7, "é under the mit licensé"),
    ]
    out = {r["doc_id"]: r for r in licences.scan(frame(spark, rows)).collect()}
    for i, t in rows:
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.licences(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
    assert out[5]["labels"] == "apache-2.0,gpl-2.0-only,mit"
    assert out[6]["labels"] == ""
    more = licences.scan(frame(spark, [(None, "SPDX-License-Identifier: see below"), (1, "License-Expression: MIT and LicenseRef-own"), (1, "License-Expression: MIT and LicenseRef-own"), (2, "word " * 300_000 + "cc by nc")]))
    assert [(r["labels"], r["n_base"]) for r in more.orderBy("doc_id").collect()] == [("", 0), ("licenseref-own,mit", 0), ("licenseref-own,mit", 0), ("cc-by-nc", 1)]
    assert out[5]["score"] == 1.0 and out[1]["score"] == pytest.approx(0.1)
    assert got(licences.scan(empty)) == []


@pytest.mark.parametrize(
    ("text", "want"),
    [("MIT", 1.0), ("GPL-3.0-only", 0.3), ("MIT AND GPL-3.0-only", 0.3), ("MIT OR GPL-3.0-only", 1.0), ("GPL-2.0-only AND (MIT OR AGPL-3.0-only)", 0.3), ("GPL-2.0-only OR AGPL-3.0-only AND MIT", 0.3), ("MIT AND", 1.0)],
)
def test_expressions(text, want):
    assert licences.evaluate(text)[1] == want


def test_many_tags_in_one_long_line():
    found = licences.automaton(licences.BASE)
    tag = "SPDX-License-Identifier: MIT OR (é BSD-3-Clause) "
    small = "".join(f"License-Expression\t=\"x{k}\" AND isc, " for k in range(300)) + "\nSPDX-License-Identifier:\nGPL-3.0-only"
    assert set(licences.scan_text(found, small.encode())[5].split(",")) == {f"x{k}" for k in range(300)}  # a quote ends an expression, and so does the line
    begun = time.perf_counter()
    n, *_, labels, score = licences.scan_text(found, (tag * 200_000).encode())
    assert (n, labels, score) == (200_000 * 9, "mit", 1.0)
    many = " or ".join(f"lib-{k}.0" for k in range(200_000))
    assert licences.scan_text(found, f"license expression: {many}".encode())[5].count(",") == 199_999
    assert time.perf_counter() - begun < 60


def test_urls(spark):
    rules = queries.RULES
    cases = [
        (1, "http://A.NET/x?q", "a.net", "/x", "net/", "block"), (2, "https://www.example.net/en/1", "www.example.net", "/en/1", "example.net/en/", "allow"),
        (3, "https://x.example.com/de/1#t", "x.example.com", "/de/1", "example.com/de/", "block"), (4, "no scheme", "", "", None, "allow"), (5, None, "", "", None, "allow"),
        (6, "http://b.org/fr/", "b.org", "/fr/", "org/fr/", "allow"), (7, "http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"), (8, "a://b://c/d", "b:", "//c/d", None, "allow"),
        (9, "http://example.net", "example.net", "", None, "allow"), (10, "://net/", "net", "/", "net/", "block"), (11, "http://x.io?a/b", "x.io", "", None, "allow"),
    ]
    spam = [(1000 + k, f"http://s.org/win/{k}") for k in range(40)] + [(2000 + k, f"http://s.org/ok/{k}") for k in range(40)]
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u, *_ in cases] + [(i, u, "h", "x") for i, u in spam], "page_id long, url string, host string, template string")
    labels = spark.createDataFrame([(i, int(i >= 2000)) for i, _ in spam] + [(None, 0), (1, None)], "doc_id long, quality int")
    out = {r["page_id"]: r for r in urls.judge(pages, rules, labels).collect()}
    for i, _, host, path, rule, verdict in cases:
        assert (out[i]["host"], out[i]["path"], out[i]["rule"], out[i]["verdict"]) == (host, path, rule, verdict)
    assert {out[i]["verdict"] for i, _ in spam if i < 2000} == {"block"} and {out[i]["verdict"] for i, _ in spam if i >= 2000} == {"allow"}
    assert out[1000]["template"] == "/win/0"
    assert got(urls.judge(pages.limit(0), rules, labels)) == []
    assert {r["verdict"] for r in urls.judge(pages.filter("page_id > 999"), rules, labels.limit(0)).collect()} == {"allow"}


def test_url_templates_part_at_any_depth(spark):
    deep = "/".join(f"d{k}" for k in range(6))
    rows = [(k, f"http://h.org/{deep}/{'bad' if k % 2 else 'good'}/{k}") for k in range(80)]
    rows += [(200 + k, f"http://h.org/s{k}/x") for k in range(30)] + [(None, f"http://h.org/{deep}/bad/7"), (3, f"http://h.org/{deep}/bad/3"), (900, "http://h.org/" + "q" * 100_000 + "/" + "/".join("ab" * 300))]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(80)], "doc_id long, quality int")
    out = urls.judge(pages, [], labels).collect()
    assert len(out) == len(rows)
    assert {x["verdict"] for x in out if "/bad/" in x["path"]} == {"block"} and {x["verdict"] for x in out if "/bad/" not in x["path"]} == {"allow"}
    # Purity by hand: 41 labelled pages of bad (one comes twice), all unwanted, smoothed to the host's share and that to the overall one.
    host = (41 + 4 * 41 / 81) / (81 + 4)
    assert {round(1 - x["purity"], 9) for x in out if x["page_id"] in (1, 5)} == {round((41 + 4 * host) / (41 + 4), 9)}


def test_a_small_section_that_differs_is_judged_on_its_own(spark):
    rows = [(k, f"http://h.org/a{k % 4}/{k}") for k in range(4000)] + [(5000 + k, f"http://h.org/spam/{k}") for k in range(20)]
    labels = spark.createDataFrame([(k, 1) for k in range(0, 4000, 4)] + [(k, 1) for k in range(1, 4000, 7)] + [(5000 + k, 0) for k in range(20)], "doc_id long, quality int")
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), [], labels).collect()
    assert {x["page_id"] for x in out if x["verdict"] == "block"} == {5000 + k for k in range(20)}


def test_branches_merge_by_rate():
    assert urls.alike([100, 100, 100], [5, 6, 90], ["a", "b", "c"]) == ["a|b", "a|b", "c"]
    assert urls.alike([0, 0], [0, 0], ["a", "b"]) == ["a|b", "a|b"]


def test_packing(spark, docs, empty):
    r = random.Random(4)
    lengths = [r.randint(1, 40) for _ in range(60)]
    steps, count = np.unique(lengths, return_counts=True)
    for k in (1, 2, 3):
        ends = packing.boundaries(steps, count, steps * count, k)
        best = min(brute.padding(lengths, [*c, max(lengths)]) for c in combinations(steps.tolist()[:-1], k - 1))
        assert brute.padding(lengths, ends) == best
    hot = packing.pack(frame(spark, [(None, "same text")] * 5000), buckets=2, budget=64).groupBy(F.element_at(F.split("batch", "-"), 2)).count().collect()
    assert len(hot) > 1 and max(x["count"] for x in hot) < 3000
    out = packing.pack(docs, buckets=4, budget=256).collect()
    assert len(out) == len(corpus())
    want = {i: len(re.findall(r"\w+|[^\w\s]", t or "")) for i, t in corpus()}
    assert all(x["n_tokens"] == want[x["doc_id"]] and x["padding"] >= 0 and x["boundary"] == x["n_tokens"] + x["padding"] for x in out)
    batches: dict = {}
    for x in out:
        batches.setdefault(x["batch"], []).append(x)
    for b in batches.values():
        assert len({(x["bucket"], x["boundary"]) for x in b}) == 1 and sorted(x["slot"] for x in b) == list(range(len(b)))
        assert len(b) * b[0]["boundary"] <= 256 or len(b) == 1
    assert got(packing.pack(empty)) == []


def test_lines(spark, empty):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    own = [f"{word()} {word()} {word()} {word()}" for _ in range(30)]
    rows = [(i, f"{own[i]}\nPosted by user{i} at {i}:30 today\nAll rights reserved here\n{word()} {word()}") for i in range(10)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, own[20]), (54, own[21]), (54, own[21])] + [(60 + k, own[22]) for k in range(20)]
    out = {x["doc_id"]: x for x in lines.drop_lines(frame(spark, rows)).collect()}
    for i, t in rows[:10]:
        a, _, _, d = t.split("\n")
        assert (out[i]["text"], out[i]["n_dropped"]) == (f"{a}\n{d}", 2)
    assert all((out[i]["text"], out[i]["n_dropped"]) == (t, 0) for i, t in rows[10:])
    assert got(lines.drop_lines(empty)) == []
    assert lines.drop_lines(empty).columns == [*empty.columns, "n_dropped"]


def test_toxicity(spark, empty):
    r = random.Random(8)
    bad, good = ["vile", "scum", "hatred", "trash"], ["river", "garden", "music", "harbour", "bread", "window", "paper", "lamp"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = [r.choice(good) for _ in range(30)]
        if toxic:
            words[5:12] = [r.choice(bad) for _ in range(7)]
        rows.append((i, " ".join(words)))
        if toxic and i % 12 == 0 or i % 10 == 1:
            labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "\n"), (None, "river")]
    df = frame(spark, rows)
    model = toxicity.train(df, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"))
    out = {x["doc_id"]: x for x in toxicity.score(df, model).collect()}
    assert len(out) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in out.values())
    score = np.array([out[i]["score"] for i in range(600)])
    toxic = np.arange(600) % 6 == 0
    assert score[toxic].min() > score[~toxic].max()
    assert out[1000]["score"] == out[1001]["score"] == out[1002]["score"]
    assert toxicity.score(empty, model).count() == 0
    blank = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {x["score"] < 0.5 for x in toxicity.score(df, blank).collect()} == {True}


def test_one_step_of_the_risk_estimator_by_hand():
    import pandas as pd

    rows = pd.DataFrame({"positive": [True, False, False], "at": [np.array([0]), np.array([1]), np.array([0, 1])], "value": [np.array([1.0]), np.array([2.0]), np.array([1.0, 1.0])]})
    prior, start = 0.2, toxicity.blank(0.2).bias
    loss = lambda g, y: np.log1p(np.exp(-y * g))

    def risk(w, b):  # prior * positive part + the clean part, held at zero
        g = np.array([w[0], 2 * w[1], w[0] + w[1]]) + b
        clean = loss(g[1:], -1).mean() - prior * loss(g[:1], -1).mean()
        return prior * loss(g[:1], 1).mean() + max(clean, 0), clean

    w, b, eps = np.zeros(2), start, 1e-6
    assert risk(w, b)[1] > 0
    slope = np.array([(risk(w + eps * np.eye(2)[k], b)[0] - risk(w - eps * np.eye(2)[k], b)[0]) / (2 * eps) for k in range(2)])
    got = toxicity.fit(rows, np.array([0, 1]), prior, rounds=1, shrink=0.0)
    assert np.sign(got.weights[:2]).tolist() == (-np.sign(slope)).tolist()  # the first step of Adam is the rate, against the slope
    assert np.allclose(np.abs(got.weights[:2]), toxicity.SCALE * 0.1, rtol=1e-3)


def test_toxicity_with_repeats_conflicts_and_long_texts(spark):
    rows = [(i, f"river garden {'vile scum' if i % 4 == 0 else 'music bread'} {i}") for i in range(400)] * 2 + [(900, "garden " * 300_000), (901, "vile scum " * 100_000), (None, None)]
    labels = [(i, int(i % 4 == 0)) for i in range(0, 400, 2)] + [(4, 0), (8, 0), (None, 1)]  # a row of 1 decides
    df = frame(spark, rows)
    out = toxicity.score(df, toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    assert len(out) == len(rows)
    by = {x["doc_id"]: x["score"] for x in out}
    assert by[901] > by[900] and min(by[i] for i in range(0, 400, 4)) > max(by[i] for i in range(400) if i % 4)


def brute_lines(rows, least=5, constant=0.6, depth=3):
    """Lines that go, by text: leaf, variable fields and templates looked up one by one."""
    mask = lambda w: "#" if any(c in "0123456789" for c in w) else w
    parsed = {i: [tuple(map(mask, x.split())) for x in t.split("\n")] for i, t in rows}
    texts = {}
    for i, own in parsed.items():
        for x in own:
            if x:
                texts.setdefault(x, set()).add(dict(rows)[i])
    leaf = lambda x: (len(x), x[:depth])
    by_leaf = {}
    for x in texts:
        by_leaf.setdefault(leaf(x), []).append(x)
    gone = {x for x in texts if len(texts[x]) >= least}
    for own in by_leaf.values():
        if len(set().union(*[texts[x] for x in own])) < least:
            continue
        n = {}
        for x in own:
            for k, w in enumerate(x):
                n[k, w] = n.get((k, w), 0) + len(texts[x])
        shape = {x: tuple(w if w != "#" and n[k, w] >= least else None for k, w in enumerate(x)) for x in own}
        fit = [x for x in own if sum(w is not None for w in shape[x]) >= constant * len(x)]
        for s in {shape[x] for x in fit}:
            same = [x for x in fit if shape[x] == s]
            if sum(len(texts[x]) for x in same) >= least:
                gone |= set(same)
    return {i: "\n".join(raw for raw, x in zip(t.split("\n"), parsed[i], strict=True) if x not in gone) for i, t in rows}


def test_lines_against_brute_force(spark):
    r = random.Random(31)
    word = lambda: "".join(r.choice("abc") for _ in range(2))
    kinds = ["by {} on {}", "page {} of {} here {}", "read more about {} now", "{} {}", "all rights reserved"]
    rows = [(i, "\n".join(r.choice(kinds).format(*[r.choice([word(), str(r.randint(0, 99))]) for _ in range(3)]) for _ in range(r.randint(1, 8)))) for i in range(60)]
    rows.append((99, "\n".join([f"own{k} line{k} of text {word()}" for k in range(20_000)])))
    out = {x["doc_id"]: x["text"] for x in lines.drop_lines(frame(spark, rows)).collect()}
    assert out == brute_lines(rows)


@pytest.mark.parametrize("whole", [0, components.WHOLE])
def test_components(spark, whole):
    ws = Workspace(spark, "test")
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 150)] + [(5, 5), (200, 100), (-3, -9)]
    nodes = sorted({x for p in links for x in p})
    found = dict(got(components.components(ws, spark.createDataFrame(links, "a long, b long"), whole)))
    want = brute.components(nodes, links)
    assert found == want
    assert got(components.components(ws, spark.createDataFrame([], "a long, b long"), whole)) == []


def test_checkpoint_folder_is_asked_for(spark, monkeypatch):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        Workspace(Elsewhere, "x")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    pytest.importorskip("duckdb")
    from tests.oracle import agree

    agree(spark, queries.QUERIES[name], queries.ORACLE[name])


def test_lines_same_rows_without_a_broadcast_of_keys(spark, monkeypatch):
    docs = frame(spark, [(i, f"head {i} of page\nsame line here\n{'abc' * (i % 3)} rest") for i in range(12)] + [(None, None), (3, "")])
    rows = lambda: sorted(map(str, lines.drop_lines(docs).select("doc_id", "text", "n_dropped").collect()))
    few = rows()
    monkeypatch.setattr(lines, "KEYS", -1)
    assert rows() == few
    assert any("n_dropped=2" in r or "n_dropped=1" in r for r in few)
