"""Small literal tables for what the test tables can't show."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from quern import schemas
from quern.functions import locale, text
from quern.operators import access, chatlog, faq, relations, versions
from quern.plans import paging
from quern.plans.find import Find, sites
from quern.sources import files
from quern.streaming import transcript


def values(spark, expr, rows, ddl):
    df = spark.createDataFrame([(k, *(r if isinstance(r, tuple) else (r,))) for k, r in enumerate(rows)], f"k int, {ddl}")
    return [r["x"] for r in df.select("k", expr.alias("x")).orderBy("k").collect()]


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_schemas_parse(spark):
    for name, ddl in {**schemas.COLLECTIONS, **schemas.CHAT}.items():
        assert spark.createDataFrame([], ddl).count() == 0, name
    assert all(column in schemas.COLLECTIONS[c] for c, column in schemas.ENUMS)


def test_every_site_read_runs(spark):
    now = datetime.datetime(2025, 1, 1)
    for name, (table, find) in sites("vi", now, "a", 2).items():
        df = spark.createDataFrame([], schemas.COLLECTIONS[table])
        assert find.run(df).columns == df.columns, name


def _news(spark, rows):
    return spark.createDataFrame(rows, "id string, slug string, lang string, tag string, publishedAt int, _status string")


def test_find(spark):
    df = _news(spark, [("a", "x", "en", "news", 1, "published"), ("b", "x", "vi", "workshop", 3, None), ("c", "y", "en", "seminar", 3, "draft"), ("d", "z", "en", "Short-Course A", 3, "published"), ("e", "z", "en", "news", 2, None)])
    ids = lambda f: [r["id"] for r in f.run(df).collect()]
    assert ids(Find({"lang": {"equals": "en"}}, "-publishedAt", 2, published=True)) == ["d", "e"]
    assert ids(Find({"lang": {"equals": "en"}}, "-publishedAt", 2, 2, published=True)) == ["a"]
    assert ids(Find({}, "-publishedAt", 3)) == ["b", "c", "d"]  # ties by id
    assert ids(Find({}, "-nowhere", 2)) == ["a", "b"]
    assert ids(Find({"tag": {"like": "course SHORT"}}, limit=9)) == ["d"]
    assert ids(Find({"tag": {"in": []}}, limit=9)) == []
    assert ids(Find({"tag": {"equals": ""}, "lang": {"equals": None}}, limit=9)) == list("abcde")
    assert ids(Find({"_status": {"equals": "published"}}, "publishedAt")) == ["a", "d"]  # here null is excluded
    with pytest.raises(ValueError, match="from 1"):
        Find({}, limit=3, page=0).run(df)
    with pytest.raises(ValueError, match="unknown"):
        Find({"lang": {"near": "x"}}).run(df)


def test_prefer_locale(spark):
    df = _news(spark, [("1", "a", "vi", "n", 1, None), ("2", "a", "en", "n", 1, None), ("3", "b", "vi", "n", 1, None), ("4", "c", "fr", "n", 1, None), ("5", "c", "vi", "n", 1, None), ("6", "c", "en", "n", 1, None)])
    assert sorted(r["id"] for r in locale.prefer(df, "en").collect()) == ["2", "3", "6"]
    assert values(spark, locale.resolve(F.col("c")), [None, "", "vi", "de"], "c string") == ["en", "en", "vi", "de"]
    assert values(spark, locale.catalogue(F.col("c")), [None, "vi", "de"], "c string") == ["en", "vi", "en"]
    messages = spark.createDataFrame([("vi", "hi", "Xin chào"), ("en", "hi", "Hello")], "locale string, key string, text string")
    keys = spark.createDataFrame([("hi",), ("bye",)], "key string")
    assert {tuple(r) for r in locale.translate(keys, messages, "vi").collect()} == {("hi", "Xin chào"), ("bye", "bye")}


def test_paging(spark):
    assert [paging.page_number(x) for x in ("3", "x", None, "0", "-2", "1.5")] == [3, 1, 1, 1, 1, 1]
    assert (paging.move(2, 3, 3), paging.move(2, 4, 3), paging.move(2, 0, 3)) == (3, 2, 2)
    pager = lambda n, p: one(spark, paging.pager(F.lit(n), p))
    assert (pager(9, 1), pager(9, 4), pager(9, 5), pager(9, 9), pager(0, 1)) == ([1, 2, 3, 4], [1, 2, 3, 4], [5, 6, 7, 8], [9], [])
    row = paging.envelope(spark.range(0), 1, 6).first()
    assert (row["total"], row["total_pages"], row["prev_page"], row["next_page"], row["pager"]) == (0, 0, None, None, [])


def test_text(spark):
    c = F.col("c")
    assert values(spark, text.trim(c), ["﻿\t a b \n", None, ""], "c string") == ["a b", None, ""]
    assert values(spark, text.parse_int(c, 20), ["12abc", "", "abc", "2x", "-5", "0", " 007", None, "1.9", "9007199254740993x", "99999999999999999999"], "c string") == [12, 20, 20, 2, -5, 20, 7, 20, 1, 9007199254740993, 20]
    assert values(spark, text.parse_float(c), ["1.5x", ".5", "x", "-2e3", None], "c string") == [1.5, 0.5, None, -2000.0, None]
    assert values(spark, text.slugify(c), ["Đổi mới Sáng tạo & AI", "  A--b ", "", None], "c string") == ["doi-moi-sang-tao-ai", "a-b", "", None]
    assert values(spark, text.slug_field(c, F.lit("The Title")), ["X y", None, ""], "c string") == ["x-y", "the-title", ""]
    assert values(spark, text.lab_title(c, F.lit("s")), ["AI  Lab", "Data La", "Lab", "Labs"], "c string") == ["AI", "Data", "s", "Labs"]
    assert values(spark, text.menu_title(c, F.lit(" s ")), [" T ", " ", None], "c string") == [" T ", "s", "s"]
    assert values(spark, text.moment(c), ["2024-03-05 06:07:08", "yesterday", None], "c string") == ["06:07:08 5/3/2024", "yesterday", None]
    assert values(spark, text.lines(c), [" a \n\n b\t\n"], "c string") == [["a", "b"]]
    assert values(spark, text.csv_field(c), ['a"b', None], "c string") == ['"a""b"', '""']
    assert values(spark, text.with_prefix(c, "/en"), ["http://x", "/a"], "c string") == ["http://x", "/en/a"]
    assert values(spark, text.plain_text(c), ['{"root":{"children":[{"text":"a \\"b\\""},{"type":"p","children":[{"text":"c"}]}]}}'], "c string") == ['a "b" c']
    assert values(spark, text.citation(F.lit("A"), c, F.lit(2020)), ["T"], "c string") == ['A, "T" (2020)']


def test_addresses(spark):
    embed = "https://www.youtube.com/embed/"
    urls = ["https://youtu.be/x", "https://www.youtube.com/watch?v=x&t=1", "https://M.youtube.com/shorts/x", "https://youtube.com/embed/x?a=b", "https://vimeo.com/1", "not a url", None, "https://youtu.be/", "https://youtube.com/watcher?v=x", "https://youtube.com/embed/x/y", "https://youtu.be/" + "z" * 600]
    assert values(spark, text.embed_url(F.col("u")), urls, "u string") == [embed + "x"] * 4 + [None] * 5 + [embed + "x/y", embed + "z" * 600]
    assert values(spark, text.host(F.col("u")), ["http://www.a.www.b/"], "u string") == ["a.www.b"]
    cookies = ["a=1; b=x=y; a=2", "b=%C3%A9+z", "bb=1", "b", None, "b=%zz"]
    assert values(spark, text.cookie(F.col("h"), "b"), cookies, "h string") == ["x=y", "é+z", None, None, None, None]
    bodies = ['{"detail":"no"}', '{"detail":[{"msg":"x"}]}', "{}", "oops", '{"detail":{"detail":"deep"}}', None]
    assert values(spark, text.error_detail(F.col("b"), "failed"), bodies, "b string") == ["no", "failed", "failed", "failed", "deep", "failed"]
    assert one(spark, text.query_string([("a", F.lit(1)), ("b", F.lit("")), ("c", F.lit("x y"))])) == "a=1&c=x+y"
    assert one(spark, text.set_parameter(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), "a", F.lit("9"))) == {"b": "2", "a": "9"}
    assert one(spark, text.preview_path(F.lit("news"), F.lit("s"), F.lit("k"))) == "/api/draft?slug=s&collection=news&path=%2Fnews%2Fs&previewSecret=k"
    assert one(spark, text.preview_path(F.lit("research-labs"), F.lit("s"), F.lit(""))) == "/api/draft?slug=s&collection=research-labs&path=%2Fresearch%2Fr%26d-labs%2Fs&previewSecret="
    cases = [(True, "/a", "news", "s", False, "u"), (False, "/a", "news", "s", False, "u"), (True, None, "news", "s", False, "u"), (True, "/a", None, "s", False, "u"), (True, "a", "news", "s", False, "u"), (True, "/a", "news", "s", True, "u"), (True, "/a", "news", "s", False, None)]
    expr = text.preview_status(*[F.col(x) for x in ("a", "b", "c", "d", "e", "f")])
    assert values(spark, expr, cases, "a boolean, b string, c string, d string, e boolean, f string") == [302, 403, 404, 404, 500, 403, 401]


def test_arrays(spark):
    a = F.array(F.lit("x"), F.lit("y"))
    assert (one(spark, text.toggled(a, "y")), one(spark, text.toggled(a, "z"))) == (["x"], ["x", "y", "z"])
    assert (one(spark, text.position(a, "y")), one(spark, text.position(a, "q"))) == (1, 0)
    assert one(spark, access.menu_active(F.lit("/news/1"), a, ["/news"])) is True


def _rows(spark):
    rows = [(0, 1, "c1", "Question", "q1", "a1"), (1, 1, "old", "variant_1", "v", "old"), (2, 1, "c1", "variant_3", "w", "a1"), (3, 2, "c2", "question", "q2", "a2"), (4, 1, "c1", None, "z", None)]
    return spark.createDataFrame(rows, schemas.CHAT["faq_csv"])


def test_faq_editing(spark):
    df = _rows(spark)
    flags = [r["last_of_run"] for r in faq.run_ends(df).orderBy("idx").collect()]
    assert flags == [False, False, True, True, True]
    for tasks in (1, 2, 9):
        assert [r["last_of_run"] for r in faq.run_ends(df, tasks=tasks).orderBy("idx").collect()] == flags
    assert faq.run_ends(df.limit(0)).collect() == []
    unknown = faq.add_variant(df, 4, 77).filter("idx = 5").first()
    assert (unknown["type"], unknown["category"], unknown["answer"]) == ("variant_1", "", "")
    bare = faq.add_variant(df.filter("type LIKE 'variant%'"), 1, 1).filter("content = ''").first()
    assert (bare["idx"], bare["type"], bare["category"], bare["answer"]) == (2, "variant_3", "", "")
    edited = faq.edit(df, 0, "answer_id", 9, old_id=1).orderBy("idx").collect()
    assert [r["answer_id"] for r in edited] == [9, 9, 9, 2, 9]
    assert [r["content"] for r in faq.edit(df, 0, "content", "new", old_id=1).orderBy("idx").collect()] == ["new", "v", "w", "q2", "z"]
    assert sorted(r["idx"] for r in faq.remove(df, 0, 1, True).collect()) == [3]
    assert sorted(r["idx"] for r in faq.remove(df, 1, 1, False).collect()) == [0, 2, 3, 4]
    added = {r["idx"]: r for r in faq.add_variant(df.filter("idx <> 4"), 0, 1).collect()}
    assert (added[1]["type"], added[1]["category"], added[1]["answer"], added[1]["content"]) == ("variant_3", "c1", "a1", "")  # count + 1 collides
    assert [added[k]["type"] for k in (0, 2, 3, 4)] == ["Question", "variant_1", "variant_3", "question"]
    assert {r["idx"]: r["answer"] for r in faq.inherit(df).collect()} == {0: "a1", 1: "a1", 2: "a1", 3: "a2", 4: "a1"}


def test_search_and_categories(spark):
    df = spark.createDataFrame([("Alpha q", None, "Đà"), (None, "has ALPHA", "alpha"), ("x", "y", "zeta"), ("x", "y", ""), ("x", "y", None), ("x", "y", "Alpha")], "question string, answer string, category string")
    assert faq.search(df, " alpha ").count() == 2 and faq.search(df, "  ").count() == 6
    assert [r[0] for r in faq.categories(df).collect()] == ["alpha", "Alpha", "Đà", "zeta"]


def test_validation_and_rewrite(spark):
    df = spark.createDataFrame([("a", "en"), ("", "xx"), (None, None)], "title string, lang string")
    assert [r["violations"] for r in faq.violations(df, ["title"], {"lang": ("en", "vi")}).collect()] == [[], ["title", "lang"], ["title"]]
    assert one(spark, faq.rewrite(F.lit("a.b"), [("a", "x"), (".", "-")])) == "x-b"
    assert versions.with_defaults(spark.createDataFrame([(None,), (3,)], "rank int"), {"rank": 100}).agg(F.sum("rank")).first()[0] == 103


def test_chat_log(spark):
    df = spark.createDataFrame([('say "hi", ok', "answer", None, "2024-03-05 06:07:08"), ("b\nc", "fallback", "x", "soon")], schemas.CHAT["chat_log"])
    want = '﻿"Câu hỏi","Loại quyết định","Trả lời","Thời gian"\r\n"b\nc","fallback","x","soon"\r\n"say ""hi"", ok","answer","","06:07:08 5/3/2024"'
    assert chatlog.csv_text(df, F.col("ask")) == want
    with pytest.raises(ValueError, match="3650"):
        chatlog.retained(df, "timestamp", F.current_timestamp(), 0)


def test_csv_files(spark, tmp_path):
    df = spark.createDataFrame([('a "b"', "answer", None, "t")], schemas.CHAT["chat_log"])
    chatlog.write_csv(df, str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), header=True, escape='"').collect()[0][0] == 'a "b"'
    content = '﻿ Answer_ID ,TYPE,content,category,answer,content\n1,question,x,c,"a, b",q\n\n2x,variant_1,x,"say ""no""",z,w,extra\nabc,question,x\n,question,,,,y\n3,,x,c,d,e\n'
    (tmp_path / "in").mkdir()
    (tmp_path / "in/f.csv").write_text(content)
    got = [tuple(r)[1:] for r in files.faq_import(spark, str(tmp_path / "in")).orderBy("idx").collect()]
    assert got == [(0, 1, "c", "question", "q", "a, b"), (1, 2, "say no", "variant_1", "w", "z"), (2, 0, "", "question", "y", "")]
    (tmp_path / "blank").mkdir()
    (tmp_path / "blank/f.csv").write_text('\ntype,content\nquestion,x\n')  # line 1 is the header, blank or not
    assert files.faq_import(spark, str(tmp_path / "blank")).count() == 0
    doc = 'type,content,answer\nquestion,a\rb,"un,closed\n'
    assert [(r["content"], r["answer"]) for r in one(spark, files.import_rows(F.lit(doc)))] == [("a\rb", "un,closed")]
    long = "y" * 200_000
    assert one(spark, F.element_at(files.cells(F.lit(f'a,"{long}"')), 2)) == long
    (tmp_path / "std").mkdir()
    (tmp_path / "std/f.csv").write_text('Answer_ID,type ,content,answer\n7,question,"two\nlines","say ""x"""\n8,,z,z\n')
    assert [tuple(r) for r in files.faq_standard(spark, str(tmp_path / "std")).collect()] == [(7, "", "question", "two\nlines", 'say "x"')]


def test_sources(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"title":"a","year":2020},\n{"title":"b"}]')
    assert [tuple(r) for r in files.json_records(spark, str(tmp_path / "p.json"), "title string, year int, img string").collect()] == [("a", 2020, None), ("b", None, None)]
    assert files.media_files(spark, str(tmp_path)).count() == 1
    rows = spark.createDataFrame([(1, "raw", "norm", True)], schemas.CHAT["rewrite"])
    rows.write.parquet(str(tmp_path / "rules"))
    assert files.collection(spark, str(tmp_path / "rules"), "rewrite").collect() == rows.collect()


def test_access(spark):
    users = spark.createDataFrame([("a", "ADMIN", ""), ("b", "user", None), ("c", None, "C")], "username string, role string, full_name string")
    assert access.visible_users(users, "b", True).count() == 3 and access.visible_users(users, None, True).count() == 3 and access.visible_users(users, None, False).count() == 0
    assert [r["username"] for r in access.visible_users(users, "b", False).collect()] == ["b"]
    got = {r["username"]: (r["can_edit"], r["can_delete"]) for r in access.permissions(users, "a", True).collect()}
    assert got == {"a": (True, True), "b": (True, True), "c": (True, True)}  # "ADMIN" isn't "admin"
    others = spark.createDataFrame([("a", "admin"), ("z", "admin"), (None, None)], "username string, role string")
    assert [tuple(r)[2:] for r in access.permissions(others, "a", True).orderBy("username").collect()] == [(True, True), (True, False), (True, False)]
    assert [tuple(r)[2:] for r in access.permissions(others, "a", False).orderBy("username").collect()] == [(False, False), (True, False), (False, False)]
    assert {r["full_name"] for r in access.masked(users).collect()} == {"-", "C"}
    assert (access.may("read", None), access.may("update", None), access.may("update", None, preview=True)) == (True, False, True)
    tabs = [("faq", "user"), ("rules", "user"), ("rules", "Admin"), ("nowhere", "admin"), ("config", None)]
    assert values(spark, access.tab_open(F.col("t"), F.col("r")), tabs, "t string, r string") == [True, False, True, False, False]


def test_versions(spark):
    df = spark.createDataFrame([("a", 1, "published"), ("a", 2, "published"), ("a", 3, "draft"), ("b", 1, "draft")], "id string, version int, _status string")
    assert [tuple(r)[:2] for r in versions.latest_published(df, "id", "version").collect()] == [("a", 2)]
    assert sorted(r["version"] for r in versions.newest(df, "id", ["version"], 2).filter("id = 'a'").collect()) == [2, 3]


def test_relations(spark):
    parents = spark.createDataFrame([(1,), (2,)], "answer_id long")
    children = spark.createDataFrame([(1, 5, "b"), (1, 4, "a")], "answer_id long, variant_id long, variant_text string")
    nested = relations.nested(parents, children, "answer_id", "variants", "variant_id")
    assert {r["answer_id"]: [v["variant_text"] for v in r["variants"]] for r in nested.collect()} == {1: ["a", "b"], 2: []}
    assert sorted((r["answer_id"], r["variant_id"]) for r in relations.spread(nested, "variants").collect() if r["variant_id"]) == [(1, 4), (1, 5)]
    slot = lambda n: [r["slot"] for r in relations.slots(spark.range(n), [F.col("id")], 4).orderBy("position").collect()]
    assert (slot(1), slot(3), slot(9)) == (["only"], ["item"] * 3, ["main", "sub", "sub", "sub"])


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "bot", "yo")], transcript.SCHEMA)
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        q = transcript.append(transcript.turns(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
        assert q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_entry_survives_without_the_training_data_part(spark, monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n.startswith("quern.llm") or n == "corpus_pipeline" else real(n, *a))
    assert set(entry.queries()) == set(entry.catalog.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
