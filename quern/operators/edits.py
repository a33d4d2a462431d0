"""A log of edits to imported questions, replayed in order.

An edit may depend on all earlier ones: a question takes its group along to another
answer_id, and what is deleted or numbered next goes by the group as it is then. Yet an edit
only reaches rows whose answer_ids are joined by edits of that column. Those sets are found
first; each one replays its own edits, and rows that no edit can reach pass by. The plan
doesn't grow with the log.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import parse_int
from quern.storage import settled

COLUMNS = ("answer_id", "category", "type", "content", "answer")
#: What a question's edit passes on to its group.
CASCADE = ("answer_id", "category", "answer")
#: Rows that a task replays edits on, about; a set of rows that hang together isn't divided.
SHARE = 10_000
_OUT = "uid long, place array<long>, answer_id long, category string, type string, content string, answer string"


def _sets(links: DataFrame) -> DataFrame:
    """(node, root) for the ends of links (a, b): the least node that links lead to. Roots hook on to smaller neighbours and paths are halved, so rounds go by the logarithm of a chain."""
    both = settled(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    roots = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        least = both.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("m"))
        seen = roots.join(least, F.col("node") == F.col("a")).select("node", "root", "m").filter("m < root")
        hooks = seen.select("node", "m").union(seen.select("root", "m")).groupBy("node").agg(F.min("m").alias("m"))
        hooked = roots.join(hooks, "node", "left").select("node", F.least("root", F.coalesce("m", "root")).alias("root"))
        above = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        now = settled(hooked.join(above, "root", "left").select("node", F.least("root", F.coalesce("top", "root")).alias("root")))
        changed = now.alias("n").join(roots.alias("r"), "node").filter("n.root <> r.root").isEmpty()
        roots = now
        if changed:
            return roots


def _question(kind: str | None) -> bool:
    return kind is not None and kind.lower() == "question"


def fold(rows: list[dict], log: list[dict]) -> list[dict]:
    """rows after the edits of log, one by one. Both belong to one set; an edit of a row that is gone does nothing."""
    have = {r["uid"]: r for r in rows}
    groups: dict[int | None, set[int]] = {}
    for r in rows:
        groups.setdefault(r["answer_id"], set()).add(r["uid"])

    def put(row: dict, column: str, value) -> None:
        if column == "answer_id":
            groups[row["answer_id"]].discard(row["uid"])
            groups.setdefault(value, set()).add(row["uid"])
        row[column] = value

    for e in log:
        if e["op"] == "add":
            own = [have[u] for u in groups.get(e["number"], ())]
            parent = min((r for r in own if _question(r["type"])), key=lambda r: r["place"], default={})
            after = have.get(e["uid"])
            if after is None:
                continue
            new = {"uid": -e["seq"], "place": [*after["place"], -e["seq"]], "answer_id": e["number"], "category": parent.get("category") or "", "type": f"variant_{sum(not _question(r['type']) for r in own) + 1}", "content": "", "answer": parent.get("answer") or ""}
            have[new["uid"]] = new
            groups.setdefault(e["number"], set()).add(new["uid"])
            continue
        row = have.get(e["uid"])
        if row is None:
            continue
        whole = _question(row["type"])
        if e["op"] == "delete":
            gone = set(groups[row["answer_id"]]) if whole else {row["uid"]}
            groups[row["answer_id"]] -= gone
            for u in gone:
                del have[u]
            continue
        value = e["number"] if e["field"] == "answer_id" else e["value"]
        group = groups[row["answer_id"]]
        with_it = [have[u] for u in group if u != row["uid"] and not _question(have[u]["type"])] if whole and e["field"] in CASCADE else []
        for r in [row, *with_it]:
            put(r, e["field"], value)
    return list(have.values())


def replay(rows: DataFrame, log: DataFrame) -> DataFrame:
    """rows after all edits of the log, in the order of seq: (uid, place, answer_id, category, type, content, answer).

    rows: uid (of its own, not negative), idx (the order), and the other columns. log: seq
    (from 1, of its own), op, uid, field, value. ``set`` puts value into a cell (into
    answer_id as a whole number, 0 if it is none); ``delete`` takes a row, with a question
    all rows of its answer_id; ``add`` puts a variant of answer_id ``value`` after row uid,
    with uid -seq. A question's answer_id, category and answer go on to the rows, questions
    aside, that have its answer_id before the edit. Edits of unknown rows do nothing. Sort
    by place to get the rows in order. All edits that hang together are replayed by one
    task, with the rows they can reach: that is what their order means. A null answer_id is
    a group.
    """
    number = parse_int(F.col("value"), 0).cast("long")
    log = settled(log.select("seq", "op", "uid", "field", "value", number.alias("number")))
    none = F.lit(-(2**63))
    node = lambda c: F.coalesce(F.col(c), none)
    base = rows.select("uid", F.array(F.col("idx").cast("long")).alias("place"), F.col("answer_id").cast("long").alias("answer_id"), *COLUMNS[1:])
    adds = log.filter("op = 'add'")
    origin = base.select("uid", node("answer_id").alias("first")).union(adds.select(-F.col("seq"), node("number")))
    # What an edit touches: the first answer_id of its row, and the one it leads to.
    ends = settled(log.join(origin, "uid").select("seq", "first", F.when((F.col("field") == "answer_id") | (F.col("op") == "add"), node("number")).otherwise(F.col("first")).alias("then")))
    roots = settled(_sets(ends.select(F.col("first").alias("a"), F.col("then").alias("b"))))
    root_of = lambda df, c: df.join(roots.withColumnRenamed("node", c), c, "left").withColumn("root", F.coalesce("root", c))
    edits = settled(root_of(ends, "first").select("seq", "root").join(log, "seq"))
    keyed = root_of(base.withColumn("first", node("answer_id")), "first").drop("first")
    reached = edits.select("root").distinct()
    untouched = keyed.join(reached, "root", "left_anti").select("uid", "place", *COLUMNS)

    def run(own: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        plain = lambda df: [{k: (None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else list(v) if k == "place" else v) for k, v in r.items()} for r in df.astype(object).to_dict("records")]
        whole = lambda r: r | {k: int(r[k]) for k in ("answer_id", "number", "seq", "uid") if r.get(k) is not None}
        done = fold([whole(r) for r in plain(own.drop(columns="root"))], [whole(r) for r in plain(todo.sort_values("seq"))])
        out = pd.DataFrame(done, columns=["uid", "place", *COLUMNS])
        return out.astype({"answer_id": "Int64", "uid": "int64"})

    # Sets don't meet, so a task may replay many small ones as if they were one.
    touched = settled(keyed.join(reached, "root", "left_semi"))
    share = F.pmod(F.xxhash64("root"), F.lit(-(-touched.count() // SHARE) or 1))
    done = touched.withColumn("root", share).groupBy("root").cogroup(edits.withColumn("root", share).groupBy("root")).applyInPandas(run, _OUT)
    return untouched.unionByName(done)
