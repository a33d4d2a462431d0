"""Named queries over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import locale, text
from quern.operators import access, chatlog, faq, relations, versions
from quern.plans import paging
from quern.plans.find import Find

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "q16_page"


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DOC = ("doc_id", "lang", "source", "n_chars")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 6 OFFSET 6")
def q16_page(spark, sf_dir):
    return Find({"lang": {"equals": "en"}}, "-n_chars", 6, 2, columns=_DOC, id_col="doc_id").run(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 3")
def q1_latest(spark, sf_dir):
    return Find({"lang": {"equals": "en"}}, "-n_chars", 3, columns=_DOC, id_col="doc_id").run(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE source IN ('src0', 'src3') AND lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 3")
def q8_latest_in(spark, sf_dir):
    return Find({"source": {"in": ["src0", "src3"]}, "lang": {"equals": "en"}}, "-n_chars", 3, columns=_DOC, id_col="doc_id").run(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE source IN ('src0', 'src3') AND lang = 'fr'")
def p2_in_list(spark, sf_dir):
    return Find({"source": {"in": ["src0", "src3"]}, "lang": {"equals": "fr"}}, columns=_DOC, id_col="doc_id").run(table(spark, sf_dir, "documents"))


@query("SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type), 'an') AND contains(lower(p_type), 't')")
def p3_like(spark, sf_dir):
    return Find({"p_type": {"like": "T AN"}}, columns=("p_partkey", "p_type"), id_col="p_partkey").run(table(spark, sf_dir, "part"))


@query("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def p4_after(spark, sf_dir):
    return Find({"ts": {"greater_than": F.lit("2024-01-15 00:00:00").cast("timestamp")}}, columns=("event_id", "ts"), id_col="event_id").run(table(spark, sf_dir, "events"))


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 4")
def o1_unknown_sort_key(spark, sf_dir):
    return Find({}, "-publishedAt", 4, columns=("doc_id", "lang"), id_col="doc_id").run(table(spark, sf_dir, "documents"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 4")
def q5_top(spark, sf_dir):
    return Find({}, "-o_totalprice", 4, columns=("o_orderkey", "o_totalprice"), id_col="o_orderkey").run(table(spark, sf_dir, "orders"))


@query("SELECT lang, count(*) AS total, CAST(ceil(count(*) / 6.0) AS BIGINT) AS total_pages FROM documents GROUP BY lang")
def a1_page_totals(spark, sf_dir):
    one = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("total"))
    return one.withColumn("total_pages", paging.pages_of(F.col("total"), 6))


@query(
    "SELECT count(*) AS total, CAST(5 AS INTEGER) AS page, CAST(6 AS INTEGER) AS page_size, CAST(ceil(count(*) / 6.0) AS BIGINT) AS total_pages, CAST(4 AS INTEGER) AS prev_page, CAST(6 AS INTEGER) AS next_page, '5,6,7,8' AS pager FROM documents WHERE lang = 'en'"
)
def w5_envelope(spark, sf_dir):
    docs = Find({"lang": {"equals": "en"}}).matching(table(spark, sf_dir, "documents"))
    return paging.envelope(docs, 5, 6).withColumn("pager", F.array_join(F.col("pager").cast("array<string>"), ","))


@query("SELECT slug, doc_id, lang FROM (SELECT doc_id % 200 AS slug, doc_id, lang, row_number() OVER (PARTITION BY doc_id % 200 ORDER BY CASE WHEN lang = 'fr' THEN 0 ELSE 1 END, doc_id) AS rn FROM documents) AS t WHERE rn = 1")
def f1_prefer_locale(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 200).alias("slug"), "doc_id", "lang")
    return locale.prefer(docs, "fr", id_col="doc_id")


@query("SELECT conv_id, turn, text FROM (SELECT * FROM conversations ORDER BY conv_id, turn LIMIT 60) AS t WHERE contains(lower(text), 'the')")
def p8_search_after_page(spark, sf_dir):
    page = table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").limit(60)
    return faq.search(page, "The", ("text",)).select("conv_id", "turn", "text")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND (contains(lower(coalesce(text, '')), 'tion') OR contains(lower(role), 'tion'))")
def p21_log_search(spark, sf_dir):
    logs = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("ask"), F.col("role").alias("answer"), F.col("role").alias("decistion_type"))
    return chatlog.matching(logs, "TION ", "user").select("conv_id", "turn")


@query("SELECT conv_id, turn, coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn) <> role, true) AS last_of_run FROM conversations")
def w1_run_ends(spark, sf_dir):
    return faq.run_ends(table(spark, sf_dir, "conversations"), "role", "turn", "conv_id").select("conv_id", "turn", "last_of_run")


_FAQ = "SELECT conv_id AS answer_id, turn AS idx, CASE WHEN role = 'user' THEN 'Question' ELSE 'variant' END AS type, text AS content, role AS category, text AS answer FROM conversations"


def _faq(spark, sf_dir):
    kind = F.when(F.col("role") == "user", "Question").otherwise("variant")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("idx"), kind.alias("type"), F.col("text").alias("content"), F.col("role").alias("category"), F.col("text").alias("answer"))


@query(f"SELECT answer_id, 'variant_' || CAST(sum(CASE WHEN type <> 'Question' THEN 1 ELSE 0 END) + 1 AS VARCHAR) AS next_type FROM ({_FAQ}) AS f GROUP BY answer_id")
def m7_variant_numbers(spark, sf_dir):
    return faq.variant_numbers(_faq(spark, sf_dir))


@query(
    f"WITH f AS ({_FAQ}), q AS (SELECT answer_id, answer FROM (SELECT answer_id, answer, row_number() OVER (PARTITION BY answer_id ORDER BY idx) AS rn FROM f WHERE type = 'Question') AS x WHERE rn = 1) SELECT f.answer_id, f.idx, CASE WHEN q.answer_id IS NULL THEN f.answer ELSE q.answer END AS answer FROM f LEFT JOIN q ON f.answer_id = q.answer_id"
)
def j6_inherit(spark, sf_dir):
    return faq.inherit(_faq(spark, sf_dir)).select("answer_id", "idx", "answer")


@query(f"SELECT answer_id, idx, CASE WHEN idx = 5000001 OR (answer_id = 5 AND type <> 'Question') THEN 'new' ELSE answer END AS answer FROM (SELECT answer_id, answer_id * 1000000 + idx AS idx, type, answer FROM ({_FAQ}) AS g) AS f")
def m5_cascade_edit(spark, sf_dir):
    rows = _faq(spark, sf_dir).withColumn("idx", F.col("answer_id") * 1_000_000 + F.col("idx"))
    return faq.edit(rows, 5_000_001, "answer", "new", 5).select("answer_id", "idx", "answer")


@query(f"SELECT answer_id, idx, CASE WHEN idx = 3000000 OR (answer_id = 3 AND type <> 'Question') THEN 'new' ELSE category END AS category FROM (SELECT answer_id, answer_id * 1000000 + idx AS idx, type, category FROM ({_FAQ}) AS g) AS f")
def m5_cascade_edit_all(spark, sf_dir):
    """The edit of m5_cascade_edit on the whole table: idx is one of its own for each row, so that only one row is edited by it."""
    rows = _faq(spark, sf_dir).withColumn("idx", F.col("answer_id") * 1_000_000 + F.col("idx"))
    return faq.edit(rows, 3_000_000, "category", "new", 3).select("answer_id", "idx", "category")


@query(f"SELECT answer_id, idx, type FROM ({_FAQ}) AS f WHERE answer_id <> 3")
def m6_cascade_delete(spark, sf_dir):
    return faq.remove(_faq(spark, sf_dir), 0, 3, True).select("answer_id", "idx", "type")


@query("SELECT doc_id, lang FROM documents AS d WHERE NOT EXISTS (SELECT 1 FROM labels AS l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def m6_group_delete(spark, sf_dir):
    return relations.without(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id").select("doc_id", "lang")


def _nations(spark, sf_dir):
    """One reference in five leads nowhere."""
    return table(spark, sf_dir, "nation").withColumn("n_regionkey", F.when(F.col("n_nationkey") % 5 == 0, -1).otherwise(F.col("n_regionkey")))


@query("SELECT n.n_nationkey, n.n_name, r.r_name AS media_url, r.r_name AS media_caption FROM nation AS n LEFT JOIN region AS r ON n.n_regionkey = r.r_regionkey AND n.n_nationkey % 5 <> 0")
def j1_left_lookup(spark, sf_dir):
    media = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("url"), F.col("r_name").alias("caption"))
    return relations.with_media(_nations(spark, sf_dir), media, "n_regionkey").select("n_nationkey", "n_name", "media_url", "media_caption")


@query("SELECT n.n_nationkey, coalesce(r.r_name, '') AS media_url, coalesce(r.r_name, n.n_name) AS media_caption FROM nation AS n LEFT JOIN region AS r ON n.n_regionkey = r.r_regionkey AND n.n_nationkey % 5 <> 0")
def j2_lookup_with_fallback(spark, sf_dir):
    media = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("url"), F.col("r_name").alias("caption"))
    return relations.with_media(_nations(spark, sf_dir), media, "n_regionkey", "n_name").select("n_nationkey", "media_url", "media_caption")


@query("SELECT r.r_regionkey, string_agg(n.n_name, ',' ORDER BY n.n_nationkey) AS nations FROM region AS r LEFT JOIN nation AS n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_regionkey")
def j4_nested(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey", "n_name")
    return relations.nested(table(spark, sf_dir, "region"), nations, "r_regionkey", "own", "n_nationkey").select("r_regionkey", F.array_join("own.n_name", ",").alias("nations"))


@query("SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good' END, d.source) AS source FROM documents AS d LEFT JOIN labels AS l ON l.doc_id = d.doc_id")
def j5_edited(spark, sf_dir):
    edits = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id", F.lit("good").alias("source"))
    return relations.edited(table(spark, sf_dir, "documents").select("doc_id", "source"), edits, "doc_id", "source")


@query("SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, d.lang, coalesce(l.quality, d.n_chars) AS n_chars FROM documents AS d FULL OUTER JOIN labels AS l ON l.doc_id = d.doc_id")
def m2_upsert(spark, sf_dir):
    changes = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("n_chars"))
    return relations.upsert(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), changes, "doc_id")


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN '/a' WHEN 1 THEN '/b' ELSE '/other' END AS prefix FROM nation")
def j8_dictionary(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", relations.lookup(F.col("n_regionkey").cast("string"), {"0": "/a", "1": "/b"}, "/other").alias("prefix"))


@query("SELECT DISTINCT year(o_orderdate) AS y FROM orders")
def a3_years(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("y")).distinct().orderBy(F.desc("y"))


@query("SELECT DISTINCT source AS category FROM documents WHERE source <> ''")
def a4_categories(spark, sf_dir):
    return faq.categories(table(spark, sf_dir, "documents").withColumnRenamed("source", "category"))


@query("SELECT sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::BIGINT AS success_count, sum(CASE WHEN quality = 1 THEN 0 ELSE 1 END)::BIGINT AS failure_count, string_agg(CASE WHEN quality = 1 THEN NULL ELSE CAST(doc_id AS VARCHAR) END, ',' ORDER BY doc_id) AS failed_ids FROM labels")
def a7_bulk_result(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("ok"), F.lit("low").alias("detail"))
    return faq.bulk_result(rows).select("success_count", "failure_count", F.array_join(F.col("failed_ids").cast("array<string>"), ",").alias("failed_ids"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) AS t WHERE rn <= 2")
def w4_newest_versions(spark, sf_dir):
    return versions.newest(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], 2).select("o_custkey", "o_orderkey")


@query(
    "SELECT source, doc_id, pos AS position, total, CASE WHEN total = 1 THEN 'only' WHEN total < 4 THEN 'item' WHEN pos = 1 THEN 'main' ELSE 'sub' END AS slot FROM (SELECT source, doc_id, pos, count(*) OVER (PARTITION BY source) AS total FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS pos FROM documents) AS a WHERE pos <= 4) AS t"
)
def w3_slots(spark, sf_dir):
    out = relations.slots(table(spark, sf_dir, "documents"), [F.desc("n_chars"), F.col("doc_id")], 4, "source")
    return out.select("source", "doc_id", F.col("position").cast("long").alias("position"), "total", "slot")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 7 DAY")
def c3_retention(spark, sf_dir):
    return chatlog.retained(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-30 12:00:00").cast("timestamp"), 7).select("event_id", "ts")


@query("""SELECT conv_id, turn, '"' || replace(coalesce(text, ''), '"', '""') || '"' AS cell FROM conversations""")
def f15_csv_cells(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.csv_field(F.col("text")).alias("cell"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day FROM orders")
def f6_day(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.day(F.col("o_orderdate")).alias("day"))


@query("SELECT page_id, replace(regexp_extract(lower(url), '://([^/?#]*)', 1), 'www.', '') AS host FROM pages")
def f17_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.host(F.col("url")).alias("host"))


@query("SELECT page_id, CASE WHEN regexp_matches(tail, '^[0-9]') AND CAST(regexp_extract(tail, '^[0-9]+') AS BIGINT) <> 0 THEN CAST(regexp_extract(tail, '^[0-9]+') AS BIGINT) ELSE 7 END AS n FROM (SELECT page_id, regexp_extract(url, '[^/]*$') AS tail FROM pages) AS t")
def f11_parse_int(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.parse_int(F.substring_index("url", "/", -1), 7).alias("n"))


@query("""SELECT o_orderkey, o_orderpriority || ', "' || o_orderstatus || '" (' || CAST(year(o_orderdate) AS VARCHAR) || ')' AS line FROM orders""")
def f28_citation(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.citation(F.col("o_orderpriority"), F.col("o_orderstatus"), F.year("o_orderdate")).alias("line"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'd' || CAST(doc_id AS VARCHAR) ELSE lang END AS title FROM documents")
def f3_menu(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    title = F.when(F.col("doc_id") % 3 == 0, F.lit(" \t")).otherwise(F.col("lang"))
    return docs.select("doc_id", text.menu_title(title, F.concat(F.lit(" d"), "doc_id", F.lit(" "))).alias("title"))


def _users(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("username"), F.when(F.col("c_mktsegment") == "BUILDING", "admin").when(F.col("c_mktsegment") == "MACHINERY", "Admin").otherwise(None).alias("role"))


@query("SELECT c_custkey, true AS can_edit, c_mktsegment <> 'BUILDING' AS can_delete FROM customer")
def p11_permissions(spark, sf_dir):
    return access.permissions(_users(spark, sf_dir), "7", True).select("c_custkey", "can_edit", "can_delete")


@query("SELECT c_custkey, c_custkey = 7 AS can_edit, false AS can_delete FROM customer")
def p11_own_permissions(spark, sf_dir):
    return access.permissions(_users(spark, sf_dir), "7", False).select("c_custkey", "can_edit", "can_delete")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000007' OR c_custkey = 7 AND c_name = 'Customer#7'")
def p10_visible(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_name").alias("username"))
    return access.visible_users(users, "Customer#000000007", False).select("c_custkey", "c_name")


@query("SELECT user_id, CASE WHEN best < 50 THEN 'fallback' WHEN best - second >= 5 OR second IS NULL THEN 'answer' ELSE 'ambiguity' END AS decision FROM (SELECT user_id, max(CASE WHEN rn = 1 THEN value END) AS best, max(CASE WHEN rn = 2 THEN value END) AS second FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS rn FROM events) AS a GROUP BY user_id) AS t")
def ext_decision(spark, sf_dir):
    scores = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("answer_id"), F.col("value").alias("score"))
    return faq.decide(scores, "user_id", 50.0, 5.0).select("user_id", "decision")
