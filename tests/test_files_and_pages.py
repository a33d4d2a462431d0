from __future__ import annotations

import datetime
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern import schemas
from quern.functions import text
from quern.operators import access, chatlog, versions
from quern.plans import paging
from quern.sources import files


@pytest.fixture(autouse=True)
def apart(spark):
    """Small parts stay as they are, so that there are several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def bytes_of(folder) -> bytes:
    return b"".join(p.read_bytes() for p in sorted(Path(folder).glob("part-*")))


def test_export_is_one_text_over_many_files(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.choice(['say "hi"', "a,b", "é\r\nx", "", f"q{k}"]), r.choice(["answer", None]), r.choice([None, "x\ny"]), f"2024-03-{k % 28 + 1:02} 06:07:{k % 60:02}") for k in range(400)]
    df = spark.createDataFrame([(*x[:3], f"{x[3]}.{k:03}") for k, x in enumerate(rows)], schemas.CHAT["chat_log"]).repartition(5)
    chatlog.export(df, str(tmp_path / "log"), F.col("timestamp").desc())
    assert len(list((tmp_path / "log").glob("part-*"))) > 1
    assert bytes_of(tmp_path / "log").decode() == chatlog.csv_text(df, F.col("timestamp").desc())
    none = df.limit(0)
    chatlog.export(none, str(tmp_path / "none"), F.col("timestamp"))
    assert bytes_of(tmp_path / "none").decode() == chatlog.csv_text(none, F.col("timestamp"))


def test_pages_by_key(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(r.randint(0, 9), k) for k in range(137)], "n int, id long").repartition(4)
    sort = [("n", True), ("id", False)]
    placed = paging.placed(df, sort, 10)
    want = sorted(((x["n"], x["id"]) for x in df.collect()), key=lambda x: (-x[0], x[1]))
    first = paging.starts(placed, sort)
    for page in range(1, 15):
        rows = paging.page_rows(df, first, sort, page).collect()
        assert sorted(map(tuple, rows), key=lambda x: (-x[0], x[1])) == want[10 * page - 10 : 10 * page]
    assert paging.page_rows(df, first, sort, 15).collect() == [] and paging.page_rows(df, first, sort, 0).collect() == []
    assert paging.placed(df.limit(0), sort, 10).collect() == []


def test_pushed_key_range(spark, tmp_path):
    spark.range(1000).select((F.col("id") % 10).alias("n"), "id").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    sort = [("id", False)]
    out = paging.page_rows(df, paging.starts(paging.placed(df, sort, 100), sort), sort, 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,200)" in plan and "Sort" not in plan and out.count() == 100


def test_columns_of_requests(spark):
    given = ["3", " +4 ", "-2", "0", "1.5", "x", None, "", "1_000", "٣", "99999999999", "007"]
    got = [r[0] for r in spark.createDataFrame([(g,) for g in given], "t string").select(paging.page_of(F.col("t"))).collect()]
    assert got == [3, 4, 1, 1, 1, 1, 1, 1, 1, 1, 1, 7]
    assert [paging.page_number(g) for g in given[:10]] == got[:10]
    cases = [(v, s, p) for v in (*access.VERBS, "other", None) for s in (True, False, None) for p in (True, False, None)]
    out = [r[0] for r in spark.createDataFrame(cases, "v string, s boolean, p boolean").select(access.allowed(F.col("v"), F.col("s"), F.col("p"))).collect()]
    assert out == [access.may(v, "u" if s else None, bool(p)) if v in access.VERBS else bool(p) for v, s, p in cases]
    sized = spark.createDataFrame([(4, 20, 200), (4, 20, 20), (4, 20, 7), (4, 500, 20)], "p long, s long, t long").select(paging.resized(F.col("p"), F.col("s"), F.col("t")).alias("x")).collect()
    assert [tuple(r["x"]) for r in sized] == [(1, 200), (4, 20), (4, 20), (1, 20)]


def test_tokens(spark):
    html = ['<meta name="a" content=" v ">', "<META NAME='a' CONTENT='v'>", "<meta content=v name=a>", '<meta name="a" content="  "><meta name="a" content="w">', '<meta name="b" content="v">', '<metax name="a" content="v">', '<meta data-name="a" name="a" content="x > y">', None, '<meta name="a">']
    got = [r[0] for r in spark.createDataFrame([(h,) for h in html], "h string").select(text.meta_content(F.col("h"), "a")).collect()]
    assert got == ["v", "v", "v", None, None, None, "x > y", None, None]
    rows = spark.createDataFrame([("<meta name='csrf_token' content=m>", "csrf-token=c"), ("", "xsrf_token=last; csrf_token="), (None, None)], "h string, c string")
    assert [r[0] for r in rows.select(text.token(F.col("h"), F.col("c"))).collect()] == ["m", "last", None]


@pytest.mark.parametrize("n", [0, 1, 40])
def test_a_file_for_each_row_in_one_folder(spark, tmp_path, n):
    texts = [f'[{{"a":{k},\n"b":"x"}}]' for k in range(n)]
    files.write_each(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), str(tmp_path / "out"))
    own = [p.read_text().rstrip("\n") for p in (tmp_path / "out").glob("part-*") if p.stat().st_size]
    assert sorted(own) == sorted(texts) and not [p for p in (tmp_path / "out").iterdir() if p.is_dir()]
    assert n < 40 or len({p.name[:10] for p in (tmp_path / "out").glob("part-*") if p.stat().st_size}) > 1
    assert sorted(r["a"] for r in files.json_records(spark, str(tmp_path / "out"), "a long, b string").collect()) == list(range(n))


def quoted(r) -> str:
    cell = "".join(r.choice(['""', ",", "\n", "\r\n", "a", "é", " "]) for _ in range(r.randint(0, 12)))
    return f'"{cell}"'


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_large_csv_in_fifty_splits(spark, tmp_path, end):
    r = random.Random(7)
    lines = [" Answer_ID,TYPE,content,answer,more", *[f'{k},{r.choice(["question", quoted(r), ""])},c{k} {r.choice(["", "x"])},{r.choice([quoted(r), "plain", ""])},{quoted(r)}' for k in range(400)]]
    lines.insert(9, "")
    (tmp_path / "in").mkdir()
    raw = end.join(lines).encode()
    (tmp_path / "in" / "a.csv").write_bytes(raw)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(raw) // 50))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        read = files.faq_large(spark, str(tmp_path / "in"))
        n = spark.read.option("lineSep", "\n").text(str(tmp_path / "in")).rdd.getNumPartitions()
        have = [tuple(x)[2:] for x in sorted(read.collect(), key=lambda x: x["idx"])]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert n >= 50
    normal = lambda rows: [tuple(c.replace("\r\n", "\n") if isinstance(c, str) else c for c in x) for x in rows]
    want = [tuple(x) for x in files.faq_standard(spark, str(tmp_path / "in")).collect()]
    assert len(have) > 100 and normal(have) == normal(want)


def test_odd_csv_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "bom.csv").write_bytes('﻿answer_id,type,content\n1,question,a\n\n  \n2,question,"b\n\n""c"""\n'.encode())
    (tmp_path / "in" / "open.csv").write_text('type,answer_id,content,content\nq,3,x,y\nq,4,z,"open\nnever closed,1\n')
    (tmp_path / "in" / "head.csv").write_text("answer_id,type,content")
    (tmp_path / "in" / "none.csv").write_text("")
    out = sorted((Path(x["file"]).name, x["idx"], x["answer_id"], x["content"]) for x in files.faq_large(spark, str(tmp_path / "in")).collect())
    assert out[:2] == [("bom.csv", 1, 1, "a"), ("bom.csv", 2, 2, 'b\n\n"c"')] and out[2] == ("open.csv", 1, 3, "y") and len(out) <= 4


def test_versions_in_force(spark):
    r = random.Random(4)
    at = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=k)
    key = lambda: r.choice(["hot"] * 6 + ["a", "b", None])
    reads = [(k, key(), r.choice([None, *map(at, range(0, 200, 3))])) for k in range(500)]
    rows = [(key(), k, r.choice([None, *map(at, range(0, 200, 6))])) for k in range(120)] + [("only", 900, at(3))]
    out = versions.in_force(spark.createDataFrame(reads, "id long, doc string, t timestamp").repartition(3), spark.createDataFrame(rows, "doc string, v long, since timestamp"), "doc", "t", "since", "v")
    want = {}
    for k, doc, t in reads:
        held = [(s, v) for d, v, s in rows if d == doc and d is not None and s is not None and t is not None and s <= t]
        want[k] = max(held)[1] if held else None
    assert {x["id"]: x["version"] and x["version"]["v"] for x in out.collect()} == want
    assert versions.in_force(spark.createDataFrame(reads[:5], "id long, doc string, t timestamp"), spark.createDataFrame([], "doc string, v long, since timestamp"), "doc", "t", "since", "v").filter("version IS NOT NULL").count() == 0
