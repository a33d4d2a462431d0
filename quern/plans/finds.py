"""The site's 33 reads over the test tables, which stand for its collections; each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import locale
from quern.plans.catalog import ORACLE, QUERIES, table
from quern.plans.find import Find, sites

AS_OF, SLUG, PAGE, LANG = "2024-01-20 00:00:00", "17", 2, "fr"
TAGS = ("news", "workshop", "seminar", "hackathon", "ecotech", "hackday", "cyber-clinic")


def collections(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Documents are pages of all kinds, orders publications, customers members, web pages videos, events events."""
    d = F.col("doc_id")
    status = F.when(d % 5 == 0, "draft").when(d % 5 > 1, "published")
    own = table(spark, sf_dir, "documents").select(
        d.alias("id"), F.concat(F.lit("Title "), (d % 40)).alias("title"), (d % 200).cast("string").alias("slug"), F.when(F.col("lang") == "de", "vi").otherwise(F.col("lang")).alias("lang"),
        F.element_at(F.array(*[F.lit(t) for t in TAGS]), (d % 7 + 1).cast("int")).alias("tag"), F.col("n_chars").alias("publishedAt"), F.col("n_chars").alias("createdAt"), status.alias("_status"),
    )
    courses = own.drop("publishedAt").withColumn("tag", F.when(F.col("id") % 2 == 0, "short-course").otherwise("public-lecture"))
    videos = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 50).cast("string").alias("slug"), (F.col("page_id") * 37 % 101).alias("publishedAt"))
    return {
        "news": own, "solutions": own, "learning_materials": own, "research_labs": own, "courses": courses, "cyber_clinic_videos": videos,
        "publications": table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year")),
        "members": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("rank")),
        "upcoming_events": table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("time")),
    }


OWN = (
    "SELECT doc_id AS id, 'Title ' || (doc_id % 40) AS title, CAST(doc_id % 200 AS VARCHAR) AS slug, CASE WHEN lang = 'de' THEN 'vi' ELSE lang END AS lang, "
    "['news', 'workshop', 'seminar', 'hackathon', 'ecotech', 'hackday', 'cyber-clinic'][CAST(doc_id % 7 + 1 AS INTEGER)] AS tag, n_chars AS made, "
    "CASE WHEN doc_id % 5 = 0 THEN 'draft' WHEN doc_id % 5 > 1 THEN 'published' END AS status FROM documents"
)
COURSES = "SELECT doc_id AS id, CAST(doc_id % 200 AS VARCHAR) AS slug, CASE WHEN lang = 'de' THEN 'vi' ELSE lang END AS lang, CASE WHEN doc_id % 2 = 0 THEN 'short-course' ELSE 'public-lecture' END AS tag, CASE WHEN doc_id % 5 = 0 THEN 'draft' ELSE 'published' END AS status FROM documents"
VIDEOS = "SELECT page_id AS id, CAST(page_id % 50 AS VARCHAR) AS slug, page_id * 37 % 101 AS made FROM pages"
LIVE = "coalesce(status, 'published') = 'published'"


def _sql(source: str, where: str = "true", order: str = "id", cut: str = "") -> str:
    ranked = "row_number() OVER (ORDER BY " + order + ") - 1" if cut else "CAST(NULL AS BIGINT)"
    return f"SELECT id, {ranked} AS pos FROM (SELECT * FROM ({source}) AS s WHERE {where} ORDER BY {order} {cut}) AS t"


def _news(where: str = "true", cut: str = "LIMIT 3") -> str:
    return _sql(OWN, f"lang = 'fr' AND {LIVE} AND {where}", "made DESC, id", cut)


def _course(kind: str, cut: str = "") -> str:
    return _sql(COURSES, f"lang = 'fr' AND {LIVE} AND tag = '{kind}'", "id", cut)


def _detail(source: str, column: str, value: str) -> str:
    return f"SELECT id, CAST(NULL AS BIGINT) AS pos FROM (SELECT id, row_number() OVER (PARTITION BY {column} ORDER BY CASE WHEN lang = 'fr' THEN 0 ELSE 1 END, id) AS rn FROM ({source}) AS s WHERE {column} = '{value}' AND {LIVE}) AS t WHERE rn = 1"


_PAPERS, _PEOPLE = "SELECT o_orderkey AS id, year(o_orderdate) AS year FROM orders", "SELECT c_custkey AS id, c_nationkey AS rank FROM customer"
_PAGED = "LIMIT 6 OFFSET 6"
#: What each read asks for, by its own description. pos: the place in a page, from 0; null where a read has no end.
SQL = {
    "q1": _news(), "q2": _news(cut="LIMIT 4"), "q3": _course("short-course"), "q4": _course("public-lecture"), "q5": _sql(_PAPERS, order="year DESC, id", cut="LIMIT 4"),
    "q6": _course("short-course"), "q7": _course("public-lecture"), "q8": _news("tag IN ('seminar', 'workshop')"), "q9": _sql("SELECT event_id AS id, ts FROM events", f"ts > TIMESTAMP '{AS_OF}'"),
    "q10": _news("tag = 'workshop'"), "q11": _news("tag = 'hackathon'"), "q12": _course("public-lecture", "LIMIT 3"), "q13": _news("tag = 'workshop'"), "q14": _news("tag = 'hackathon'"),
    "q15": _course("public-lecture", "LIMIT 3"), "q16": _news(cut=_PAGED), "q17": _news("tag = 'ecotech'", _PAGED), "q18": _news("tag = 'workshop'", _PAGED), "q19": _news("tag = 'hackathon'", _PAGED),
    "q20": _sql(_PAPERS, order="year DESC, id", cut="LIMIT 1000"), "q21": _sql(_PEOPLE, order="rank, id", cut="LIMIT 100"), "q22": _detail(OWN, "slug", SLUG), "q23": _detail(COURSES, "slug", SLUG),
    "q24": _detail(OWN, "slug", SLUG), "q25": _detail(OWN, "title", f"Title {SLUG}"), "q26": _detail(OWN, "slug", SLUG), "q27": _sql(VIDEOS, f"slug = '{SLUG}'", cut="LIMIT 1"),
    "q28": _sql(OWN, f"tag = 'cyber-clinic' AND lang = 'vi' AND {LIVE}", "made DESC, id", "LIMIT 4"), "q29": _sql(VIDEOS), "q30": _sql(OWN, "status = 'published'", "made DESC, id", "LIMIT 4"),
    "q31": _sql(OWN, "status = 'published'"), "q32": _course("short-course"), "q33": _sql(OWN, f"lang = 'fr' AND {LIVE}"),
}


def _read(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        as_of = F.lit(AS_OF).cast("timestamp")
        kind, find = sites(LANG, as_of, f"Title {SLUG}" if name == "q25" else SLUG, PAGE)[name]
        out = find.run(collections(spark, sf_dir)[kind])
        if name in DETAILS:
            out = locale.prefer(out, LANG, "title" if name == "q25" else "slug")
        # A page is one task's, so its rows are counted in the order that they come out.
        return out.select("id", (F.monotonically_increasing_id() if find.limit else F.lit(None).cast("long")).alias("pos"))

    return run


DETAILS = ("q22", "q23", "q24", "q25", "q26")
for _name in SQL:
    QUERIES[f"find_{_name}"] = _read(_name)
    ORACLE[f"find_{_name}"] = SQL[_name]


def o4_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 2 of eight of the publications of one year."""
    return Find({"year": {"equals": 1995}}, "-year", 8, 2).run(collections(spark, sf_dir)["publications"]).select("id")


QUERIES["o4_slice"] = o4_slice
ORACLE["o4_slice"] = f"SELECT id FROM ({_PAPERS}) AS p WHERE year = 1995 ORDER BY id LIMIT 8 OFFSET 8"
