"""Named queries for the smaller behaviours: functions, permissions, editing, lists; each with SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import locale, text
from quern.operators import access, chatlog, faq, ranks, relations, versions
from quern.plans import paging
from quern.plans.catalog import query, table
from quern.plans.find import Find
from quern.sources.files import import_rows
from quern.storage import shared
from quern.streaming import transcript

def _d() -> Column:
    return F.col("doc_id")


def _docs(spark, sf_dir, **columns):
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in columns.items()])


_PADDED = "CASE doc_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN chr(9) || ' s' || doc_id || ' ' WHEN 2 THEN 's' || doc_id END"


def _menu(spark, sf_dir):
    slug = F.when(_d() % 4 == 0, "  ").when(_d() % 4 == 1, F.concat(F.lit("\t s"), _d(), F.lit(" "))).when(_d() % 4 == 2, F.concat(F.lit("s"), _d()))
    title = F.when(_d() % 3 == 0, " T ").when(_d() % 3 == 1, "\n")
    return relations.menu(_docs(spark, sf_dir, slug=slug, title=title))


_MENU_SQL = f"SELECT trim(slug, ' ' || chr(9)) AS slug, CASE WHEN doc_id % 3 = 0 THEN ' T ' ELSE trim(slug, ' ' || chr(9)) END AS title FROM (SELECT doc_id, {_PADDED} AS slug FROM documents) AS t WHERE trim(coalesce(slug, ''), ' ' || chr(9)) <> ''"


_MENU_ROWS = f"SELECT doc_id, lang, source, n_chars, CASE WHEN doc_id % 9 = 0 THEN 'draft' END AS status, {_PADDED} AS slug, CASE doc_id % 3 WHEN 0 THEN ' T ' WHEN 1 THEN chr(10) END AS title FROM documents"
_MENU_DONE = "SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS place, trim(slug, ' ' || chr(9)) AS slug, CASE WHEN doc_id % 3 = 0 THEN ' T ' ELSE trim(slug, ' ' || chr(9)) END AS title FROM ({}) AS t WHERE lang = 'en' AND coalesce(status, 'published') = 'published' {} AND trim(coalesce(slug, ''), ' ' || chr(9)) <> ''"


def _menu_of(spark, sf_dir, find):
    """A menu as its address gives it: the find, in its order, then normalised; place is the order."""
    slug = F.when(_d() % 4 == 0, "  ").when(_d() % 4 == 1, F.concat(F.lit("\t s"), _d(), F.lit(" "))).when(_d() % 4 == 2, F.concat(F.lit("s"), _d()))
    title = F.when(_d() % 3 == 0, " T ").when(_d() % 3 == 1, "\n")
    rows = table(spark, sf_dir, "documents").select(_d().alias("id"), "lang", F.col("source").alias("tag"), F.col("n_chars").alias("publishedAt"), F.when(_d() % 9 == 0, "draft").alias("_status"), slug.alias("slug"), title.alias("title"))
    found = find.matching(rows).filter(text.trim(F.coalesce("slug", F.lit(""))) != "")
    placed = ranks.numbered(found, *find.order(found), name="place")
    return placed.select("place", text.trim(F.col("slug")).alias("slug"), text.menu_title(F.col("title"), F.col("slug")).alias("title"))


@query(_MENU_DONE.format(_MENU_ROWS, "AND source = 'src1'"))
def s2_course_menu_find(spark, sf_dir):
    return _menu_of(spark, sf_dir, Find({"lang": {"equals": "en"}, "tag": {"equals": "src1"}}, "-publishedAt", published=True))


@query(_MENU_DONE.format(_MENU_ROWS, ""))
def s3_lab_menu_find(spark, sf_dir):
    return _menu_of(spark, sf_dir, Find({"lang": {"equals": "en"}}, "-publishedAt", published=True))


@query(_MENU_SQL)
def s2_course_menu(spark, sf_dir):
    return _menu(spark, sf_dir)


@query(_MENU_SQL.replace(" FROM (SELECT", ", 1 AS n FROM (SELECT"))
def s3_lab_menu(spark, sf_dir):
    return _menu(spark, sf_dir).withColumn("n", F.lit(1))


@query(r"""SELECT conv_id, turn, CAST(conv_id AS BIGINT) AS answer_id, CASE WHEN trim(regexp_replace(text, '[",\s]+', ' ', 'g')) = '' THEN 'x' ELSE trim(regexp_replace(text, '[",\s]+', ' ', 'g')) END AS content, role || ',z' AS answer FROM conversations""")
def s7_csv_rows(spark, sf_dir):
    """Each turn as an import of one row: header, a blank line, a quoted comma, a cell too many."""
    plain = F.trim(F.regexp_replace("text", r'[",\s]+', " "))
    plain = F.when(plain == "", "x").otherwise(plain)
    doc = F.concat(F.lit(' Answer_ID,TYPE,content,answer\r\n\r\n"'), "conv_id", F.lit('x",turn,'), plain, F.lit(',"'), "role", F.lit(',z",more\n'))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(import_rows(doc)).alias("r"))
    return rows.select("conv_id", "turn", text.parse_int(F.col("r.answer_id"), 0).alias("answer_id"), "r.content", "r.answer")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_type), 'econ')")
def p5_contains(spark, sf_dir):
    return Find({"p_type": {"contains": "ECON"}}, id_col="p_partkey").run(table(spark, sf_dir, "part")).select("p_partkey")


@query("SELECT o_orderkey AS id, year(o_orderdate) AS year FROM orders WHERE year(o_orderdate) = 1995")
def p9_of_year(spark, sf_dir):
    return relations.of_year(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").cast("long").alias("year")), 1995)


@query("SELECT o_orderkey AS id, year(o_orderdate) AS year FROM orders")
def p9_all_years(spark, sf_dir):
    return relations.of_year(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").cast("long").alias("year")), "All")


@query("SELECT c_custkey, c_mktsegment = 'BUILDING' OR c_custkey % 3 = 0 AS open FROM customer")
def p13_tabs(spark, sf_dir):
    role = F.when(F.col("c_mktsegment") == "BUILDING", "Admin").otherwise("user")
    tab = F.when(F.col("c_custkey") % 3 == 0, "logs").otherwise("rules")
    return table(spark, sf_dir, "customer").select("c_custkey", access.tab_open(tab, role).alias("open"))


@query("SELECT c_custkey, c_custkey % 5 = 0 OR (verb <> 'other' AND (verb = 'read' OR c_acctbal > 0)) AS allowed FROM (SELECT c_custkey, c_acctbal, CASE c_custkey % 6 WHEN 0 THEN 'create' WHEN 1 THEN 'read' WHEN 2 THEN 'update' WHEN 3 THEN 'delete' WHEN 4 THEN 'read' ELSE 'other' END AS verb FROM customer) AS t")
def p14_p15_verbs(spark, sf_dir):
    """Requests of customers; one in five is a preview, and those with money are signed in."""
    verb = F.element_at(F.array(*[F.lit(v) for v in ("create", "read", "update", "delete", "read", "other")]), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", access.allowed(verb, F.col("c_acctbal") > 0, F.col("c_custkey") % 5 == 0).alias("allowed"))


@query("SELECT doc_id FROM documents WHERE source <> 'src0'")
def p16_not_equals(spark, sf_dir):
    return Find({"source": {"not_equals": "src0"}}, id_col="doc_id").run(table(spark, sf_dir, "documents")).select("doc_id")


@query("SELECT doc_id, source IN ('src1', 'src2') OR starts_with(source, 'src1') AS active FROM documents")
def p17_active(spark, sf_dir):
    return _docs(spark, sf_dir, active=access.menu_active(F.col("source"), F.array(F.lit("src1"), F.lit("src2")), ["src1"]))


@query("SELECT doc_id, lang IN ('en', 'fr') AS known FROM documents")
def p18_roles(spark, sf_dir):
    who = F.when(F.col("lang") == "en", "Student").when(F.col("lang") == "fr", "teacher").when(F.col("lang") == "de", "guest")
    return _docs(spark, sf_dir, known=access.known_role(who))


@query("SELECT doc_id FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 20 OFFSET 20")
def p20_listing(spark, sf_dir):
    return faq.listing(table(spark, sf_dir, "documents").withColumnRenamed("source", "category"), "src3", 2, id_col="doc_id").select("doc_id")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 20")
def p22_parameters_left_out(spark, sf_dir):
    return faq.listing(table(spark, sf_dir, "documents").withColumnRenamed("source", "category"), "", id_col="doc_id").select("doc_id")


_LOG = "SELECT event_id AS id, props AS ask, event_type AS decistion_type, ts AS timestamp FROM events"


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("ask"), F.lit(None).cast("string").alias("answer"), F.col("event_type").alias("decistion_type"), F.col("ts").alias("timestamp"))


@query(f"SELECT id FROM ({_LOG}) AS l WHERE contains(ask, '1') AND decistion_type = (SELECT min(event_type) FROM events) ORDER BY timestamp DESC, id LIMIT 20 OFFSET 20")
def p21_log_page(spark, sf_dir):
    log = _log(spark, sf_dir)
    return chatlog.listing(log, " 1", log.agg(F.min("decistion_type")).first()[0], page=2).select("id")


@query(f"SELECT id FROM ({_LOG}) AS l ORDER BY timestamp, id LIMIT 200")
def o9_oldest_first(spark, sf_dir):
    return chatlog.listing(_log(spark, sf_dir), newest_first=False, size=200).select("id")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url END AS videoFile, CASE WHEN page_id % 2 = 1 THEN url END AS externalUrl FROM pages")
def p23_by_source(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, "upload").otherwise("external").alias("source"), F.col("url").alias("videoFile"), F.col("url").alias("externalUrl"))
    return relations.by_source(pages).drop("source")


@query("SELECT page_id, CASE WHEN starts_with(url, 'http') THEN url ELSE '/en' || url END AS path, CASE WHEN starts_with(substr(url, 9), 'http') THEN substr(url, 9) ELSE '/en' || substr(url, 9) END AS rest FROM pages")
def p25_f27_prefixed(spark, sf_dir):
    rest = F.substring("url", 9, 1 << 30)
    return table(spark, sf_dir, "pages").select("page_id", text.with_prefix(F.col("url"), "/en").alias("path"), text.with_prefix(rest, "/en").alias("rest"))


@query("SELECT c_custkey, '******' AS password, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '-' END AS full_name FROM customer")
def p27_masked(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, "")
    return access.masked(table(spark, sf_dir, "customer").select("c_custkey", name.alias("full_name")))


@query("SELECT c_custkey AS id, c_name AS username, c_name AS full_name, true AS is_active, CAST(NULL AS TIMESTAMP) AS created_at, c_mktsegment AS role FROM customer")
def p28_own_row(spark, sf_dir):
    me = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.col("c_name").alias("full_name"), F.lit(True).alias("is_active"), F.col("c_mktsegment").alias("role"))
    return access.own_row(me)


@query("SELECT e.event_id, b.text AS answer, 'answer' AS decision FROM events AS e JOIN benchmark AS b ON e.user_id = b.item_id")
def j7_c4_select_answer(spark, sf_dir):
    picked = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("answer_id"))
    return faq.select_answer(picked, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("answer_id"), F.col("text").alias("answer"))).select("event_id", "answer", "decision")


@query("SELECT n.n_nationkey, coalesce(r.r_name, 'k' || n.n_regionkey) AS text FROM nation AS n LEFT JOIN region AS r ON n.n_regionkey = r.r_regionkey AND r.r_regionkey % 2 = 0")
def j9_messages(spark, sf_dir):
    messages = table(spark, sf_dir, "region").select(F.when(F.col("r_regionkey") % 2 == 0, "vi").otherwise("en").alias("locale"), F.concat(F.lit("k"), "r_regionkey").alias("key"), F.col("r_name").alias("text"))
    keys = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("k"), "n_regionkey").alias("key"))
    return locale.translate(keys, messages, "vi").select("n_nationkey", "text")


@query("SELECT r.r_regionkey, n.n_name FROM region AS r LEFT JOIN nation AS n ON n.n_regionkey = r.r_regionkey")
def j4_joined(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_name")
    return relations.joined(table(spark, sf_dir, "region").select("r_regionkey"), nations, "r_regionkey")


@query("SELECT event_id, coalesce(lead(event_type) OVER (ORDER BY event_id) <> event_type, true) AS last_of_run FROM events")
def w1_one_sequence(spark, sf_dir):
    return faq.run_ends(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id").select("event_id", "last_of_run")


@query("SELECT lang, CAST(ceil(count(*) / 8.0) AS BIGINT) AS pages FROM documents GROUP BY lang")
def a2_pages(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(paging.pages_of(F.count("*"), 8).alias("pages"))


@query("SELECT sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::BIGINT AS success_count, sum(CASE WHEN quality = 1 THEN 0 ELSE 1 END)::BIGINT AS failure_count FROM labels")
def a7_bulk_counts(spark, sf_dir):
    return faq.bulk_counts(_changes(spark, sf_dir))


@query("SELECT doc_id AS id, 'low' AS detail FROM labels WHERE quality <> 1")
def a7_bulk_failures(spark, sf_dir):
    return faq.bulk_failures(_changes(spark, sf_dir))


def _changes(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("ok"), F.lit("low").alias("detail"))


@query("SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 1 WHEN 1 THEN greatest(doc_id, 1) WHEN 2 THEN 1 WHEN 3 THEN doc_id ELSE 1 END::INTEGER AS page FROM documents")
def o5_page_numbers(spark, sf_dir):
    """The page numbers that addresses name: none, whole, negative, padded, zero, a fraction, with a word, too long."""
    n = _d().cast("string")
    given = F.when(_d() % 8 == 0, F.lit(None).cast("string")).when(_d() % 8 == 1, n).when(_d() % 8 == 2, F.concat(F.lit("-"), n)).when(_d() % 8 == 3, F.concat(F.lit(" +"), n, F.lit(" ")))
    given = given.when(_d() % 8 == 4, "0").when(_d() % 8 == 5, F.concat(n, F.lit(".5"))).when(_d() % 8 == 6, F.concat(n, F.lit("_0"))).otherwise(F.concat(n, F.lit("00000000000")))
    return _docs(spark, sf_dir, page=paging.page_of(given))


@query("""SELECT o_orderkey, CASE WHEN to_page BETWEEN 1 AND pages THEN to_page ELSE page END AS page,
CASE WHEN to_size IN (200, 500) THEN 1 ELSE page END AS sized_page, CASE WHEN to_size IN (200, 500) THEN to_size ELSE 20 END AS size
FROM (SELECT o_orderkey, 1 + o_custkey % 5 AS page, o_orderkey % 9 - 2 AS to_page, 5 AS pages, CASE o_orderkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 200 WHEN 2 THEN 500 ELSE 50 END AS to_size FROM orders) AS t""")
def o6_o7_moves(spark, sf_dir):
    """Steps from a page to another, of which some aren't there, and changes of the page size, of which some aren't offered."""
    page, key = F.col("o_custkey") % 5 + 1, F.col("o_orderkey")
    to_size = F.element_at(F.array(*[F.lit(n).cast("long") for n in (20, 200, 500, 50)]), (key % 4 + 1).cast("int"))
    sized = paging.resized(page, F.lit(20).cast("long"), to_size)
    return table(spark, sf_dir, "orders").select("o_orderkey", paging.moved(page, key % 9 - 2, F.lit(5)).alias("page"), sized["page"].alias("sized_page"), sized["size"].alias("size"))


_SORTED = [("n_chars", True), ("doc_id", False)]


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS place, (row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) // 20 + 1 AS page FROM documents")
def a1_o3_w5_every_page(spark, sf_dir):
    return paging.placed(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), _SORTED, 20).select("doc_id", "place", "page")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 60")
def a1_page_by_key(spark, sf_dir):
    """Page 4, by the first keys of the pages and no offset."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return paging.page_rows(docs, paging.starts(paging.placed(docs, _SORTED, 20), _SORTED), _SORTED, 4)


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS pos FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def o8_newest_first(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    return Find({}, "-at", 50).run(rows).select("id", F.monotonically_increasing_id().alias("pos"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) AS t WHERE rn BETWEEN 2 AND 4")
def o10_without_the_first(spark, sf_dir):
    out = relations.slots(table(spark, sf_dir, "documents"), [F.desc("n_chars"), _d()], 4, "source")
    return out.filter("position > 1").select("source", "doc_id")


@query("SELECT doc_id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def u2_appended(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'fr' WHEN lang = 'fr' THEN 'en' ELSE 'en,fr,' || lang END AS items FROM documents")
def u3_toggled(spark, sf_dir):
    return _docs(spark, sf_dir, items=F.array_join(text.toggled(F.array(F.lit("en"), F.lit("fr")), F.col("lang")), ","))


@query("SELECT doc_id, CASE WHEN lang = 'es' THEN 'en' ELSE lang END AS lang, CASE WHEN lang = 'fr' THEN 'vi' ELSE 'en' END AS messages FROM documents")
def f2_locale(spark, sf_dir):
    asked = F.when(F.col("lang") != "es", F.col("lang"))
    return _docs(spark, sf_dir, lang=locale.resolve(asked), messages=locale.catalogue(F.when(F.col("lang") == "fr", "vi").otherwise(asked)))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_type || ' #' || p_brand || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE WHEN p_size % 2 = 0 THEN trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') ELSE trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') END AS kept FROM part")
def f4_x1_slugs(spark, sf_dir):
    given = F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", text.slugify(F.concat("p_type", F.lit(" #"), "p_brand", F.lit("!"))).alias("slug"), text.slug_field(given, F.col("p_type")).alias("kept"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN 'x' || c_custkey ELSE 's' END AS title FROM customer")
def f5_lab_title(spark, sf_dir):
    k = F.col("c_custkey") % 3
    title = F.when(k == 0, F.concat("c_name", F.lit("  LAB"))).when(k == 1, F.concat(F.lit("x"), "c_custkey", F.lit(" La"))).otherwise("Lab")
    return table(spark, sf_dir, "customer").select("c_custkey", text.lab_title(title, F.lit("s")).alias("title"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'at ' || event_id ELSE strftime(ts, '%H:%M:%S %-d/%-m/%Y') END AS moment, CAST(epoch_us(ts) // 1000 AS VARCHAR) AS message FROM events")
def f7_f34_moments(spark, sf_dir):
    at = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("at "), "event_id")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", text.moment(at).alias("moment"), text.message_id(F.col("ts").cast("timestamp")).alias("message"))


@query("SELECT doc_id, source AS plain, upper(lang) AS upper, lower(upper(source)) AS lower FROM documents")
def f8_f9_f10_case(spark, sf_dir):
    padded = F.concat(F.lit("﻿\t  "), "source", F.lit(" \n　"))
    return _docs(spark, sf_dir, plain=text.trim(padded), upper=F.upper("lang"), lower=F.lower(F.upper("source")))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_retailprice END AS price FROM part")
def f12_parse_float(spark, sf_dir):
    given = F.when(F.col("p_size") % 4 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("p_retailprice").cast("string"), F.lit("x")))
    return table(spark, sf_dir, "part").select("p_partkey", text.parse_float(given).alias("price"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a' || doc_id WHEN doc_id % 3 = 1 THEN source ELSE 'none' END AS value FROM documents")
def f13_f19_first_filled(spark, sf_dir):
    a = F.when(_d() % 3 == 0, F.concat(F.lit("a"), _d())).when(_d() % 3 == 1, "")
    b = F.when(_d() % 3 == 1, F.col("source")).otherwise("")
    return _docs(spark, sf_dir, value=text.first_filled(a, b, F.lit("none")))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> ''))::INTEGER AS n, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')[1] IS NULL AS blank FROM documents")
def f14_lines(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", text.lines(F.col("text")).alias("l"))
    return own.select("doc_id", F.when(F.col("l").isNotNull(), F.size("l")).alias("n"), F.get("l", F.lit(0)).isNull().alias("blank"))


@query("""SELECT '"' || replace(props, '"', '""') || '","' || event_type || '","","' || strftime(ts, '%H:%M:%S %-d/%-m/%Y') || '"' AS line FROM events""")
def k1_k2_f16_export(spark, sf_dir):
    return chatlog.csv_lines(_log(spark, sf_dir).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")))


_TOP = """chr(65279) || '"Câu hỏi","Loại quyết định","Trả lời","Thời gian"'"""


@query(f"""SELECT {_TOP} AS line UNION ALL SELECT '"' || replace(props, '"', '""') || '","' || event_type || '","","' || strftime(ts, '%H:%M:%S %-d/%-m/%Y') || '"' FROM events""")
def k1_k2_whole_export(spark, sf_dir):
    """The log as files whose bytes together are one CSV text, read back a line at a time; that they are in order is a test's."""
    path = shared(spark, "export")
    log = _log(spark, sf_dir).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    chatlog.export(log, path, F.col("timestamp").desc(), F.col("ask"))
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\r\n", "").alias("value"))
    return files.select(F.explode(F.split("value", "\r\n")).alias("line"))


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 't' || page_id WHEN 1 THEN 'm' || page_id WHEN 2 THEN 'c=' || page_id WHEN 3 THEN 'x' || page_id END AS token FROM pages")
def s12_tokens(spark, sf_dir):
    """The token of a page with its cookies: in a meta tag, in another one because the first is blank, in a cookie, in a later cookie because the first is empty, nowhere."""
    k, n = F.col("page_id") % 5, F.col("page_id").cast("string")
    tag = (
        F.when(k == 0, F.concat(F.lit('<meta name="csrf-token" content=" t'), n, F.lit(' ">'))).when(k == 1, F.concat(F.lit("<meta name='csrf-token' content='  '/><META content=m"), n, F.lit(" name='csrf_token'>")))
        .otherwise('<meta name="csrf-token-x" content="no"><metal name="csrf-token" content="no">')
    )
    cookies = F.when(k == 2, F.concat(F.lit("a=b; csrf-token=c%3D"), n)).when(k == 3, F.concat(F.lit("csrf-token=; XSRF-TOKEN=x"), n)).otherwise("csrf-token")
    html = F.regexp_replace("html", "<head>", F.concat(F.lit("<head>"), tag))
    return table(spark, sf_dir, "pages").select("page_id", text.token(html, cookies).alias("token"))


_VIDEO = "CASE page_id % 6 WHEN 0 THEN 'x/' || page_id WHEN 1 THEN 'v' || page_id WHEN 2 THEN NULL WHEN 3 THEN 's/' || page_id WHEN 4 THEN 'e' || page_id ELSE NULL END"


@query(f"SELECT page_id, 'https://www.youtube.com/embed/' || {_VIDEO} AS player FROM pages")
def f17_players(spark, sf_dir):
    k, n = F.col("page_id") % 6, F.col("page_id").cast("string")
    url = (
        F.when(k == 0, F.concat(F.lit("https://youtu.be/x/"), n)).when(k == 1, F.concat(F.lit("https://www.youtube.com/watch?t=1&v=v"), n)).when(k == 2, F.concat(F.lit("https://youtube.com/watcher?v=v"), n))
        .when(k == 3, F.concat(F.lit("https://M.youtube.com/shorts/s/"), n)).when(k == 4, F.concat(F.lit("https://youtube.com/embed/e"), n)).otherwise(F.col("url"))
    )
    return table(spark, sf_dir, "pages").select("page_id", text.embed_url(url).alias("player"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || '=' || source END AS token FROM documents")
def f18_s12_cookies(spark, sf_dir):
    first = F.when(_d() % 3 == 0, F.concat(F.lit("tok="), "lang", F.lit("%3D"), "source", F.lit("; tok=no"))).when(_d() % 6 == 1, "tok").when(_d() % 6 == 4, "tok=; tok=no").otherwise("token=1")
    return _docs(spark, sf_dir, token=text.cookie(F.concat(F.lit("a=1; "), first), "tok"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'deep' ELSE 'failed' END AS detail FROM events")
def f20_error_detail(spark, sf_dir):
    k = F.col("event_id") % 4
    body = F.when(k == 0, F.concat(F.lit('{"detail":"'), "event_type", F.lit('"}'))).when(k == 1, '{"detail":{"detail":"deep"}}').when(k == 2, '{"detail":[1]}').otherwise("oops")
    return table(spark, sf_dir, "events").select("event_id", text.error_detail(body, "failed").alias("detail"))


@query("SELECT doc_id, '/api/draft?slug=s' || doc_id || '&collection=' || c || '&path=' || p || '%2Fs' || doc_id || '&previewSecret=' || s AS url FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'research-labs' ELSE 'news' END AS c, CASE WHEN doc_id % 2 = 0 THEN '%2Fresearch%2Fr%26d-labs' ELSE '%2Fnews' END AS p, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'k+1' END AS s FROM documents) AS t")
def f21_preview(spark, sf_dir):
    kind = F.when(_d() % 2 == 0, "research-labs").otherwise("news")
    return _docs(spark, sf_dir, url=text.preview_path(kind, F.concat(F.lit("s"), _d()), F.when(_d() % 3 != 0, "k 1")))


@query("SELECT doc_id, 'lang=' || lang || '&user=student' AS params FROM documents")
def f22_set_parameter(spark, sf_dir):
    had = F.create_map(F.lit("lang"), F.col("lang"), F.lit("user"), F.lit("teacher"))
    new = text.set_parameter(had, "user", F.lit("student"))
    return _docs(spark, sf_dir, params=F.array_join(F.transform(F.array_sort(F.map_entries(new)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'page=' || doc_id % 9 ELSE 'page=' || doc_id % 9 || '&category=a+' || lang END AS query FROM documents")
def f23_query_string(spark, sf_dir):
    return _docs(spark, sf_dir, query=text.query_string([("page", _d() % 9), ("category", F.when(F.col("lang") == "en", "").otherwise(F.concat(F.lit("a "), "lang")))]))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'https://a' WHEN 1 THEN 'https://p.q' ELSE 'http://localhost:3000' END AS server, CASE WHEN doc_id % 4 = 0 THEN 'https://h:80' WHEN doc_id % 4 = 1 THEN 'https://h' WHEN doc_id % 3 = 1 THEN 'https://p.q' WHEN doc_id % 3 = 0 THEN 'https://a' ELSE '' END AS client FROM documents")
def f24_addresses(spark, sf_dir):
    public, production = F.when(_d() % 3 == 0, "https://a").otherwise(""), F.when(_d() % 3 == 1, "p.q")
    host, port = F.when(_d() % 4 < 2, "h"), F.when(_d() % 4 == 0, "80").otherwise("")
    return _docs(spark, sf_dir, server=text.server_url(public, production), client=text.client_url(F.lit("https:"), host, port, production, public))


@query("SELECT doc_id, CAST([302, 403, 404, 404, 404, 500, 403, 401][CAST(doc_id % 8 + 1 AS INTEGER)] AS INTEGER) AS status FROM documents")
def f25_preview_status(spark, sf_dir):
    k = _d() % 8
    path = F.when(k == 2, None).when(k == 5, "news/a").otherwise("/news/a")
    status = text.preview_status(k != 1, path, F.when(k != 3, "news"), F.when(k == 4, "").otherwise("a"), k == 6, F.when(k != 7, "u"))
    return _docs(spark, sf_dir, status=status)


@query("SELECT n_nationkey, array_to_string(range(1, n_nationkey + 1), ',') AS numbers FROM nation")
def f26_numbers(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(paging.numbers(F.col("n_nationkey")).cast("array<string>"), ",").alias("numbers"))


@query("SELECT doc_id, '/news/s' || doc_id AS link FROM documents")
def f29_link(spark, sf_dir):
    return _docs(spark, sf_dir, link=text.detail_link("/news", F.concat(F.lit("s"), _d())))


@query("""SELECT doc_id, lang || ' "' || source || '"' AS plain FROM documents""")
def f30_x3_plain_text(spark, sf_dir):
    rich = F.concat(F.lit('{"root":{"children":[{"type":"p","children":[{"text":"'), "lang", F.lit('"}]},{"text":"\\"'), "source", F.lit('\\""}]}}'))
    return _docs(spark, sf_dir, plain=text.plain_text(rich))


@query("SELECT doc_id, CASE lang WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 0 END AS at FROM documents")
def f31_position(spark, sf_dir):
    return _docs(spark, sf_dir, at=text.position(F.array(F.lit("en"), F.lit("fr"), F.lit("de")), F.col("lang")).cast("int"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT l.doc_id, 'new' FROM labels AS l WHERE l.doc_id % 10 = 0 OR NOT EXISTS (SELECT 1 FROM documents AS d WHERE d.doc_id = l.doc_id)")
def m1_m3_m4_create_and_delete(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    left = relations.without(docs, docs.filter("doc_id % 10 = 0"), "doc_id")
    return relations.insert(left, table(spark, sf_dir, "labels").select("doc_id", F.lit("new").alias("lang")), "doc_id")


@query("SELECT conv_id * 1000 + turn AS idx, CAST(role AS VARCHAR) AS type, text AS content FROM conversations UNION ALL SELECT 1000000001, 'variant_' || (SELECT CAST(sum(CASE WHEN role <> 'user' THEN 1 ELSE 0 END) + 1 AS VARCHAR) FROM conversations WHERE conv_id = 3), '' UNION ALL SELECT 1000000001, 'variant_1', ''")
def m7_added_variants(spark, sf_dir):
    """A variant for a group that is there, and one for a group that isn't."""
    kind = F.when(F.col("role") == "user", "question").otherwise(F.col("role"))
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.col("conv_id").alias("answer_id"), F.lit("c").alias("category"), kind.alias("type"), F.col("text").alias("content"), F.lit("a").alias("answer"))
    new = faq.add_variant(rows, 1_000_000_000, -1).filter("idx = 1000000001")
    out = faq.add_variant(rows, 1_000_000_000, 3).union(new)
    return out.select("idx", F.when(F.col("type") == "question", "user").otherwise(F.col("type")).alias("type"), "content")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey = 7 THEN 'New' ELSE c_name END AS full_name, c_custkey <> 7 AS is_active FROM customer")
def m8_user_update(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.lit(True).alias("is_active"))
    return faq.user_update(faq.user_update(users, 7, True, "New", False), 8, False, "", False)


@query("SELECT 0.5::DOUBLE AS similarity_threshold, 0.2::DOUBLE AS margin_threshold, 30 AS log_retention_days, CAST(min(r_name) AS VARCHAR) AS support_email FROM region")
def m9_config(spark, sf_dir):
    one = table(spark, sf_dir, "region").agg(F.min("r_name").alias("support_email")).select(F.lit(0.9).alias("similarity_threshold"), F.lit(0.2).alias("margin_threshold"), F.lit(7).alias("log_retention_days"), "support_email")
    return faq.configured(one, similarity_threshold=0.5, margin_threshold=None, log_retention_days=30)


@query("SELECT 'q' AS kind, item_id AS id, CASE WHEN item_id = 5 THEN 'new' ELSE text END AS text FROM benchmark UNION ALL SELECT 'v', doc_id, CASE WHEN doc_id % 4 = 0 THEN 'edited' ELSE lang END FROM documents")
def m10_saved_edit(spark, sf_dir):
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("answer_id"), F.lit("c").alias("category"), F.col("text").alias("question"), F.lit("a").alias("answer"))
    variants = _docs(spark, sf_dir, variant_text=F.col("lang")).withColumnRenamed("doc_id", "variant_id")
    edits = variants.filter("variant_id % 4 = 0").withColumn("variant_text", F.lit("edited"))
    q, v = faq.save_edit(questions, variants, edits, 5, "", "new", "b")
    return q.select(F.lit("q").alias("kind"), F.col("answer_id").alias("id"), F.col("question").alias("text")).union(v.select(F.lit("v"), "variant_id", "variant_text"))


@query("SELECT l.doc_id, coalesce(CASE WHEN quality = 1 THEN 5 END, 100) AS rank, CASE WHEN quality = 1 THEN '' ELSE 'title' END || CASE WHEN toxic = 1 THEN ',lang' ELSE '' END AS violations FROM labels AS l")
def m12_m13_defaults_and_checks(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 5).alias("rank"), F.when(F.col("quality") == 1, "t").alias("title"), F.when(F.col("toxic") == 1, "xx").otherwise("en").alias("lang"))
    done = faq.violations(versions.with_defaults(rows, {"rank": 100}), ["title"], {"lang": ("en", "vi")})
    bad = F.concat(F.when(F.array_contains("violations", "title"), "title").otherwise(""), F.when(F.array_contains("violations", "lang"), ",lang").otherwise(""))
    return done.select("doc_id", "rank", bad.alias("violations"))


@query("SELECT doc_id, replace(replace(source, 'src', 'origin '), '1', 'one') AS text FROM documents")
def c2_rewritten(spark, sf_dir):
    return _docs(spark, sf_dir, text=faq.rewrite(F.col("source"), [("src", "origin "), ("1", "one")]))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def ext_t1_windowed_counts(spark, sf_dir):
    return transcript.counts(table(spark, sf_dir, "events"), "ts", "1 day", "1 hour").select(F.col("window.start").alias("day"), "event_type", "n")


@query("SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-12 00:00:00'")
def t2_due(spark, sf_dir):
    return versions.due(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-12 00:00:00").cast("timestamp")).select("event_id")


@query("SELECT c_custkey, max(o_orderkey) AS latest FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY c_custkey")
def w4_latest_published(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", "published").otherwise("draft").alias("_status"))
    return versions.latest_published(rows, "c_custkey", "o_orderkey").select("c_custkey", F.col("o_orderkey").alias("latest"))
