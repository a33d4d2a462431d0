from __future__ import annotations

import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quern.operators import edits, richtext

# Rich text


def walk(node, place=()):
    kids = node.get("children") if isinstance(node, dict) else None
    for k, child in enumerate(kids if isinstance(kids, list) else []):
        yield [*place, k], child
        yield from walk(child, (*place, k))


def random_tree(r, depth):
    if depth == 0 or r.random() < 0.3:
        value = r.choice([3, "m5", 99, None, {"caption": "c", "url": "/u"}, {"url": "/x"}, [1], True])
        return r.choice([{"type": "text", "text": r.choice(["a", "", 'q"\n', "é"])}, {"type": "upload", "relationTo": r.choice(["media", "news", None]), "value": value}, 7, None, "s", {"type": "linebreak"}])
    return {"type": "list", "children": r.choice([None, "x", {}]) if r.random() < 0.1 else [random_tree(r, depth - 1) for _ in range(r.randint(0, 4))]}


def test_trees_of_any_depth(spark):
    r = random.Random(5)
    trees = {k: {"root": {"children": [random_tree(r, 5) for _ in range(3)]}} for k in range(40)}
    deep = {"type": "text", "text": "bottom"}
    for _ in range(60):
        deep = {"type": "list", "children": [deep]}
    trees[100] = {"root": {"children": [deep]}}
    rows = [(k, json.dumps(t)) for k, t in trees.items()] + [(200, None), (201, ""), (202, "{broken"), (203, "[]"), (204, '{"root":null}'), (205, '{"other":1}')]
    tree = richtext.nodes(spark.createDataFrame(rows, "id long, rich string").repartition(3), "id", "rich")
    want = {(k, tuple(p)): n for k, t in trees.items() for p, n in walk(t["root"])}
    got = {(x["id"], tuple(x["place"])): (x["type"], x["text"]) for x in tree.select("id", "place", "type", "text").collect()}
    assert got == {k: (n.get("type"), n.get("text")) if isinstance(n, dict) else (None, None) for k, n in want.items()}
    texts: dict = {}
    for (k, _), n in sorted(want.items()):
        if isinstance(n, dict) and n.get("text") is not None:
            texts.setdefault(k, []).append(n["text"])
    plain = {x["id"]: x["plain"] for x in richtext.plain(tree, "id").collect()}
    assert plain == {k: " ".join(texts.get(k, [])) for k, t in trees.items() if t["root"]["children"]}
    media = {"3": ("three", "/3"), "m5": ("five", None)}
    shown = set()
    for (k, p), n in want.items():
        if isinstance(n, dict) and n.get("type") == "upload" and n.get("relationTo") == "media":
            v = n["value"]
            if isinstance(v, dict):
                shown.add((k, p, v.get("caption"), v.get("url")))
            elif str(v) in media and not isinstance(v, (bool, list)):
                shown.add((k, p, *media[str(v)]))
    out = richtext.figures(tree, "id", spark.createDataFrame([(k, *v) for k, v in media.items()], "id string, caption string, url string"))
    assert {(x["id"], tuple(x["place"]), x["caption"], x["url"]) for x in out.collect()} == shown and shown


def test_no_trees(spark):
    tree = richtext.nodes(spark.createDataFrame([], "id long, rich string"), "id", "rich")
    assert tree.collect() == [] and richtext.plain(tree, "id").collect() == []


# Logs of edits

KINDS = ["question", "Question", "variant_1", "variant_2", None]


def sequential(rows, log):
    """The list of rows after each edit in turn, positions and all."""
    rows = [dict(r) for r in rows]
    is_question = lambda r: (r["type"] or "").lower() == "question"
    for seq, op, uid, field, value in log:
        at = next((k for k, r in enumerate(rows) if r["uid"] == uid), None)
        if at is None:
            continue
        if op == "set":
            old = dict(rows[at])
            new = (int(value) if value.lstrip("-").isdigit() else 0) if field == "answer_id" else value
            rows[at][field] = new
            if is_question(old) and field in ("answer_id", "category", "answer"):
                for k, r in enumerate(rows):
                    if k != at and r["answer_id"] == old["answer_id"] and not is_question(r):
                        r[field] = new
        elif op == "delete":
            gone = rows[at]
            rows = [r for r in rows if r["answer_id"] != gone["answer_id"]] if is_question(gone) else rows[:at] + rows[at + 1 :]
        else:
            own = int(value)
            n = sum(r["answer_id"] == own and not is_question(r) for r in rows)
            parent = next((r for r in rows if r["answer_id"] == own and is_question(r)), {})
            rows.insert(at + 1, {"uid": -seq, "answer_id": own, "category": parent.get("category") or "", "type": f"variant_{n + 1}", "content": "", "answer": parent.get("answer") or ""})
    return rows


def made(r, n_rows, n_edits, n_ids):
    rows = [{"uid": k, "idx": k, "answer_id": r.randrange(n_ids), "category": r.choice(["c", None]), "type": r.choice(KINDS), "content": f"t{k}", "answer": r.choice(["a", None, "b"])} for k in range(n_rows)]
    log, known = [], [x["uid"] for x in rows]
    for seq in range(1, n_edits + 1):
        uid, op = r.choice([*known, 10**6]), r.choices(["set", "delete", "add"], [8, 1, 2])[0]
        if op == "set":
            field = r.choice(["answer_id", "answer_id", "category", "answer", "type", "content"])
            value = r.choice([str(r.randrange(n_ids)), "x"]) if field == "answer_id" else r.choice(["question", "variant_9", "v"])
            log.append((seq, op, uid, field, value))
        elif op == "delete":
            log.append((seq, op, uid, None, None))
        else:
            log.append((seq, op, uid, None, str(r.randrange(n_ids))))
            known.append(-seq)
    return rows, log


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9))
def test_fold_equals_the_sequential_run(seed):
    r = random.Random(seed)
    rows, log = made(r, r.randint(1, 12), r.randint(0, 25), 5)
    number = lambda v: int(v) if v is not None and v.lstrip("-").isdigit() else 0
    done = edits.fold([{k: v for k, v in x.items() if k != "idx"} | {"place": [x["idx"]]} for x in rows], [{"seq": s, "op": o, "uid": u, "field": f, "value": v, "number": number(v)} for s, o, u, f, v in log])
    have = [{k: v for k, v in x.items() if k != "place"} for x in sorted(done, key=lambda x: x["place"])]
    assert have == [{k: v for k, v in x.items() if k != "idx"} for x in sequential(rows, log)]


def replayed(spark, rows, log):
    df = spark.createDataFrame([tuple(x[c] for c in ("uid", "idx", *edits.COLUMNS)) for x in rows], "uid long, idx long, answer_id long, category string, type string, content string, answer string").repartition(3)
    out = edits.replay(df, spark.createDataFrame(log, "seq long, op string, uid long, field string, value string").repartition(2))
    return [{c: x[c] for c in ("uid", *edits.COLUMNS)} for x in sorted(out.collect(), key=lambda x: x["place"])]


def test_ten_thousand_edits(spark):
    rows, log = made(random.Random(11), 4000, 10_000, 1500)
    # Few answer_ids are edited to others' ones, so that groups change hands without all of them becoming one set.
    log = [e if e[3] != "answer_id" or e[0] % 9 == 0 else (*e[:3], "content", e[4]) for e in log]
    assert replayed(spark, rows, log) == [{k: v for k, v in x.items() if k != "idx"} for x in sequential(rows, log)]


def test_edits_of_chained_groups_of_none_and_of_nulls(spark):
    rows = [{"uid": k, "idx": k, "answer_id": k, "category": "c", "type": "question", "content": "", "answer": "a"} for k in range(60)] + [{"uid": 90, "idx": 90, "answer_id": None, "category": None, "type": None, "content": None, "answer": None}]
    plain = [{k: v for k, v in x.items() if k != "idx"} for x in rows]
    assert replayed(spark, rows, []) == plain
    chain = [(k + 1, "set", k, "answer_id", str(k + 1)) for k in range(59)] + [(100, "set", 90, "content", "new"), (101, "delete", 59, None, None)]
    assert replayed(spark, rows, chain) == [{k: v for k, v in x.items() if k != "idx"} for x in sequential(rows, chain)]
    assert replayed(spark, [], []) == []


def test_sets_of_long_chains(spark):
    links = [(k, k + 1) for k in range(300)] + [(1000 + 2 * k, 1000) for k in range(50)] + [(5000, 5000)]
    found = {x["node"]: x["root"] for x in edits._sets(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(301)) and all(found[1000 + 2 * k] == 1000 for k in range(50)) and 5000 not in found
