from __future__ import annotations

import datetime
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern.operators import chatlog, rules
from quern.operators.users import creations, updates


def plain(text, own):
    out, at = "", 0
    while at < len(text):
        fit = [(len(raw), to) for raw, to in own.items() if text.startswith(raw, at)]
        n, to = max(fit) if fit else (1, text[at])
        out, at = out + to, at + n
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "raw string, normalized string, active boolean, rank int")


def test_five_thousand_rules_in_one_plan(spark):
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcé ") for _ in range(n))
    own = {word(r.randint(1, 9)): word(r.randint(0, 5)) for _ in range(5000)}
    texts = [word(r.randint(0, 80)) for _ in range(150)] + ["", "zzz"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "id int, t string")
    out = rules.rewrite(df, "t", table(spark, [(a, b, True, k) for k, (a, b) in enumerate(own.items())]))
    assert [x["t"] for x in out.orderBy("id").collect()] == [plain(t, own) for t in texts] + [None]
    few = rules.rewrite(df, "t", table(spark, [("a", "b", True, 1)]))
    lines = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert lines(out) == lines(few)


def test_rules_that_do_not_count(spark):
    df = spark.createDataFrame([("a b", "other")], "t string, raw string")
    rows = [("a", "first", True, 1), ("a", "second", True, 2), ("a", "last", True, None), ("b", None, True, 1), (" ", "off", False, 0), ("", "x", True, 1), (None, "x", True, 1), ("b", "x", None, 0)]
    assert rules.rewrite(df, "t", table(spark, rows)).first()["t"] == "first "
    assert rules.rewrite(df, "t", table(spark, [])).first()["t"] == "a b"


def test_too_many_rules_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(rules, "MOST", 1)
    with pytest.raises(ValueError, match="2 rules"):
        rules.active(table(spark, [("a", "", True, 1), ("b", "", True, 1)]))


def test_retention_leaves_kept_days_alone(spark, tmp_path):
    at = lambda d, h: datetime.datetime(2024, 3, d, h)
    rows = [(d, at(d, h)) for d in range(1, 11) for h in (3, 15)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp")
    path = tmp_path / "log"
    chatlog.store(df, str(path))
    seen = lambda: {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    before = seen()
    assert chatlog.trim_store(spark, str(path), at(10, 12), 5) == 5  # the first four days, and the one without time
    want = sorted(x["id"] for x in chatlog.retained(df, "timestamp", F.lit(at(10, 12)), 5).collect())
    after = seen()
    assert sorted(x["id"] for x in spark.read.parquet(str(path)).collect()) == want == [5, *[d for d in range(6, 11) for _ in range(2)]]
    kept = {p for p in before if any(f"day=2024-03-{d:02}" in str(p) for d in range(6, 11))}
    assert kept and all(after.get(p) == before[p] for p in kept)
    assert chatlog.trim_store(spark, str(path), at(10, 12), 5) == 0 and seen() == after
    assert chatlog.trim_store(spark, str(path), at(11, 16), 6) == 1  # the whole edge day
    with pytest.raises(ValueError, match="3650"):
        chatlog.trim_store(spark, str(path), at(10, 12), 0)


def test_user_forms(spark):
    users = spark.createDataFrame([("ann",), (None,)], "username string")
    forms = [(1, True, "bob", "p", "p", ""), (2, True, "bob", "q", "q", "B"), (3, True, "ann", "p", "p", "A"), (4, False, "cy", "p", "p", None), (5, True, "cy", "p", "x", "C"), (6, None, "d", "", "", ""), (7, True, "cy", None, "", "C"), (8, True, None, "p", "p", "N")]
    out = creations(spark.createDataFrame(forms, "form_id int, is_admin boolean, username string, password string, confirm string, full_name string"), users)
    got = {r["form_id"]: (r["full_name"], r["problem"]) for r in out.collect()}
    assert got == {1: (None, None), 2: ("B", "taken"), 3: ("A", "taken"), 4: (None, "forbidden"), 5: ("C", "mismatch"), 6: (None, "forbidden"), 7: ("C", None), 8: ("N", None)}
    changes = [(1, True, "root", 5, "ann", "", "ignored", "", False), (2, False, "ann", 5, "ann", "n", "n", "A", False), (3, False, "bob", 5, "ann", "n", "n", "A", True), (4, True, "root", 5, "ann", "n", "m", None, None), (5, None, None, 6, None, None, None, "x", True)]
    schema = "form_id int, is_admin boolean, by string, user_id int, username string, password string, confirm string, full_name string, is_active boolean"
    rows = {r["form_id"]: (r["full_name"], r["is_active"], r["password"], r["problem"]) for r in updates(spark.createDataFrame(changes, schema)).collect()}
    assert rows == {1: (None, False, None, None), 2: ("A", None, "n", None), 3: ("A", None, "n", "forbidden"), 4: (None, None, "n", "mismatch"), 5: ("x", None, None, None)}
