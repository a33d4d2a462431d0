"""Named queries that write a table's rows to new files, by the readers' formats, and read them back; and reads at a time, with SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quern.operators import chatlog, rules, versions
from quern.operators import users as users_forms
from quern.plans.catalog import query, table
from quern.sources import files
from quern.storage import shared


@query("SELECT CAST(conv_id AS BIGINT) AS answer_id, role AS type, text AS content, 'say \"no\",' || chr(10) || turn AS answer FROM conversations WHERE coalesce(text, '') <> '' AND coalesce(role, '') <> ''")
def s9_standard_import(spark, sf_dir):
    """Questions as CSV files by the standard, with commas, quotes and line ends inside cells, read by splits of the files."""
    path = shared(spark, "import")
    answer = F.concat(F.lit('say "no",\n'), "turn")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("Answer_ID"), F.col("role").alias("TYPE"), F.col("text").alias("content"), answer.alias("answer"))
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return files.faq_large(spark, path).select("answer_id", "type", "content", "answer")


@query("SELECT conv_id AS answer_id, idx, content FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, 'turn ' || turn AS content FROM conversations) AS t")
def s8_picked_files(spark, sf_dir):
    """A file for each conversation, as a person would pick them, read whole."""
    path = shared(spark, "picked")
    line = F.concat_ws(",", "conv_id", F.lit("question"), F.concat(F.lit("turn "), "turn"))
    gathered = F.concat_ws("\n", F.lit("answer_id,type,content"), F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]))
    files.write_each(table(spark, sf_dir, "conversations").groupBy("conv_id").agg(gathered.alias("text")).select("text"), path)
    return files.faq_import(spark, path).select("answer_id", F.col("idx").cast("long").alias("idx"), "content")


@query("SELECT conv_id, turn, role FROM conversations")
def s10_json_arrays(spark, sf_dir):
    """A file with one array of records for each conversation."""
    path = shared(spark, "json")
    own = F.to_json(F.collect_list(F.struct("conv_id", "turn", "role"))).alias("text")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("own"), "conv_id", "turn", "role")
    files.write_each(turns.groupBy("own").agg(own).select("text"), path)
    return files.json_records(spark, path, "conv_id long, turn long, role string")


@query("SELECT n_nationkey AS k, CAST(octet_length(encode(n_name)) + 1 AS BIGINT) AS length FROM nation")
def s13_media_files(spark, sf_dir):
    """A file for each name; names of files and lengths are read, contents are not."""
    path = shared(spark, "media")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.partitionBy("n_nationkey").text(path)
    found = files.media_files(spark, path).select(F.regexp_extract("path", "n_nationkey=([0-9]+)/", 1).cast("int").alias("k"), "length")
    return found.filter("k IS NOT NULL")


_VERSIONS = "SELECT o_custkey % 17 AS user_id, o_orderkey AS version, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(o_orderkey * 7 % 40000) AS since FROM orders WHERE o_orderstatus <> 'P'"


@query(f"""WITH v AS (SELECT user_id, since, max(version) AS version FROM ({_VERSIONS}) AS t GROUP BY user_id, since)
SELECT e.event_id, v.version FROM events AS e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.since""")
def w4_t2_in_force(spark, sf_dir):
    """Events with the version that was published at their time; drafts (status P) never are."""
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), F.col("o_orderkey") * 7 % 40000)
    rows = orders.select((F.col("o_custkey") % 17).alias("user_id"), F.col("o_orderkey").alias("version"), (F.lit("2024-01-01").cast("timestamp_ntz") + minutes).alias("since"))
    reads = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return versions.in_force(reads, rows, "user_id", "ts", "since", "version").select("event_id", "version.version")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-31 06:00:00' - INTERVAL 12 DAY")
def c3_stored_retention(spark, sf_dir):
    """The log laid out by day, cut back twice; the second cut finds nothing to do."""
    path = shared(spark, "log")
    chatlog.store(table(spark, sf_dir, "events").select("event_id", "ts"), path, "ts")
    for _ in range(2):
        chatlog.trim_store(spark, path, datetime(2024, 1, 31, 6), 12, "ts")
    return spark.read.parquet(path).select("event_id", "ts")


@query("SELECT doc_id, md5(replace(replace(replace(text, 'a', '<0>'), 'e', '<3>'), 'm', '<4>')) AS text FROM documents")
def c2_rules_from_table(spark, sf_dir):
    """One rule a region, for the small first letter of its name; three have the same letter, and the first counts."""
    table_of = table(spark, sf_dir, "region").select(F.lower(F.left("r_name", F.lit(1))).alias("raw"), F.concat(F.lit("<"), "r_regionkey", F.lit(">")).alias("normalized"), F.lit(True).alias("active"), F.col("r_regionkey").alias("rank"))
    done = rules.rewrite(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", table_of)
    return done.select("doc_id", F.md5("text").alias("text"))


_FORMS = "SELECT c_custkey AS form_id, c_custkey % 7 <> 0 AS is_admin, 'u' || c_custkey % 90 AS username, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'p' || c_custkey END AS password, CASE WHEN c_custkey % 5 = 0 THEN 'other' WHEN c_custkey % 4 = 0 THEN '' ELSE 'p' || c_custkey END AS confirm, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS full_name, c_custkey % 2 = 0 AS is_active FROM customer"


def _forms(spark, sf_dir):
    k = F.col("c_custkey")
    typed = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("p"), k))
    return table(spark, sf_dir, "customer").select(
        k.alias("form_id"), (k % 7 != 0).alias("is_admin"), F.concat(F.lit("u"), k % 90).alias("username"), typed.alias("password"), F.when(k % 5 == 0, "other").otherwise(typed).alias("confirm"),
        F.when(k % 3 == 0, "").otherwise(F.col("c_name")).alias("full_name"), (k % 2 == 0).alias("is_active"),
    )


@query(f"""WITH f AS ({_FORMS}), j AS (SELECT *, CASE WHEN NOT is_admin THEN 'forbidden' WHEN password <> confirm THEN 'mismatch' END AS problem FROM f),
g AS (SELECT *, min(CASE WHEN problem IS NULL THEN form_id END) OVER (PARTITION BY username) AS first FROM j)
SELECT form_id, username, password, nullif(full_name, '') AS full_name, coalesce(problem, CASE WHEN form_id > first OR username IN (SELECT 'u' || s_suppkey FROM supplier) THEN 'taken' END) AS problem FROM g""")
def m8_user_creations(spark, sf_dir):
    users = table(spark, sf_dir, "supplier").select(F.concat(F.lit("u"), "s_suppkey").alias("username"))
    return users_forms.creations(_forms(spark, sf_dir), users)


@query(f"""SELECT form_id, form_id AS user_id, nullif(full_name, '') AS full_name, CASE WHEN is_admin THEN is_active END AS is_active, nullif(password, '') AS password,
CASE WHEN NOT is_admin AND form_id % 14 <> 0 THEN 'forbidden' WHEN password <> '' AND password <> confirm THEN 'mismatch' END AS problem FROM ({_FORMS}) AS f""")
def m8_user_changes(spark, sf_dir):
    """Every second form of one who is no admin is of the own row."""
    by = F.when(F.col("form_id") % 14 == 0, F.col("username")).otherwise("somebody")
    return users_forms.updates(_forms(spark, sf_dir).withColumn("user_id", F.col("form_id")).withColumn("by", by))
