"""Named queries over trees and logs of edits that Spark makes of the tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import edits, richtext
from quern.plans.catalog import query, table

#: A document's tree in SQL that both engines read: a paragraph, a list as deep as its id says, uploads by id and in full; some are broken or null.
_TREE = r"""CASE WHEN doc_id % 17 = 3 THEN '{"root":' WHEN doc_id % 19 = 4 THEN NULL ELSE concat(
    '{"root":{"type":"root","children":[{"type":"paragraph","children":[{"type":"text","text":"', lang, '"},{"type":"linebreak"},{"type":"text","text":"', source, ' \"q\""}]},',
    repeat('{"type":"list","children":[{"type":"listitem","children":[', CAST(doc_id % 6 AS INT)),
    '{"type":"text","text":"deep"},{"type":"upload","relationTo":"media","value":', CAST(doc_id % 40 AS STRING), '}',
    repeat(']}]}', CAST(doc_id % 6 AS INT)),
    ',{"type":"upload","relationTo":"', CASE WHEN doc_id % 2 = 0 THEN 'media' ELSE 'news' END, '","value":{"caption":"c', CAST(doc_id AS STRING), '","url":"/u"}},7]}}') END"""
_WALK = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_TREE.replace("AS STRING", "AS VARCHAR")} AS j FROM documents),
n(r, doc_id, place, node) AS (
    SELECT r, doc_id, CAST([] AS INTEGER[]), json_extract(j, '$.root') FROM d WHERE json_valid(j)
    UNION ALL
    SELECT r, doc_id, list_append(place, CAST(i AS INTEGER)), json_extract(node, '$.children[' || i || ']') FROM (SELECT r, doc_id, place, node, unnest(range(CAST(json_array_length(node, '$.children') AS BIGINT))) AS i FROM n WHERE json_type(node) = 'OBJECT' AND json_type(node, '$.children') = 'ARRAY') AS t
)"""


def _tree(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_TREE.replace("\\", "\\\\")).alias("content"))
    return richtext.nodes(docs, "doc_id", "content")


@query(_WALK + """ SELECT doc_id, count(*) AS n_nodes, max(len(place)) AS depth, string_agg(node ->> '$.text', ' ' ORDER BY place) AS plain FROM n WHERE len(place) > 0 GROUP BY r, doc_id""")
def f30_x3_rich_text(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    size = tree.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.max(F.size("place")).cast("long").alias("depth"))
    return size.join(richtext.plain(tree, "doc_id"), "doc_id")


@query(_WALK + """, u AS (SELECT doc_id, place, json_extract(node, '$.value') AS v FROM n WHERE node ->> '$.type' = 'upload' AND node ->> '$.relationTo' = 'media')
SELECT doc_id, array_to_string(place, '.') AS place, v ->> '$.caption' AS caption, v ->> '$.url' AS url FROM u WHERE json_type(v) = 'OBJECT'
UNION ALL SELECT doc_id, array_to_string(place, '.'), n_name, 'n' || n_nationkey FROM u JOIN nation ON json_type(v) <> 'OBJECT' AND CAST(v AS VARCHAR) = CAST(n_nationkey AS VARCHAR)""")
def f30_j1_figures(spark, sf_dir):
    """Uploads that are shown; ids from 25 on lead nowhere."""
    media = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("caption"), F.concat(F.lit("n"), "n_nationkey").alias("url"))
    out = richtext.figures(_tree(spark, sf_dir), "doc_id", media)
    return out.select("doc_id", F.array_join(F.col("place").cast("array<string>"), ".").alias("place"), "caption", "url")


_BIG = 1_000_000


@query(f"""WITH c AS (SELECT conv_id, turn, conv_id * {_BIG} + turn AS uid, CASE WHEN role = 'user' THEN 'Question' ELSE 'variant_1' END AS type FROM conversations),
own AS (SELECT *, bool_or(turn = 0 AND type = 'Question') OVER (PARTITION BY conv_id) AS edited FROM c),
moved AS (SELECT *, edited AND (turn = 0 OR type <> 'Question') AS goes FROM own),
done AS (
    SELECT uid, conv_id, turn, type, goes, edited, CASE WHEN goes AND conv_id % 4 = 0 THEN conv_id + 1 + {_BIG} WHEN goes THEN conv_id + {_BIG} ELSE conv_id END AS answer_id, CASE WHEN goes THEN 'new' ELSE 'a' END AS answer FROM moved
),
gone AS (SELECT DISTINCT conv_id + {_BIG} AS answer_id FROM done WHERE edited AND conv_id % 4 = 1)
SELECT answer_id, type, answer, count(*) AS n FROM (
    SELECT answer_id, type, answer FROM done WHERE answer_id NOT IN (SELECT answer_id FROM gone)
    UNION ALL SELECT conv_id + {_BIG}, 'variant_' || (count(*) FILTER (type <> 'Question') + 1), 'new' FROM done WHERE edited AND conv_id % 4 = 2 GROUP BY conv_id
) AS t GROUP BY answer_id, type, answer""")
def m5_m6_m7_replayed(spark, sf_dir):
    """For each conversation that begins with a question: its answer is edited, the group gets another id, one in four then moves in with the next group, one in four is deleted by its question, one in four gets a variant."""
    turns = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "Question").otherwise("variant_1")
    rows = turns.select((F.col("conv_id") * _BIG + F.col("turn")).alias("uid"), F.col("conv_id").alias("answer_id"), F.lit("c").alias("category"), kind.alias("type"), F.col("text").alias("content"), F.lit("a").alias("answer"), "turn", "conv_id", "role").withColumn("idx", F.col("uid"))
    first = rows.filter("turn = 0 AND role = 'user'")
    step = lambda k, op, field, value, which: first.filter(which).select((F.lit(k * 10**12) + F.col("conv_id") + 1).alias("seq"), F.lit(op).alias("op"), "uid", F.lit(field).alias("field"), value.cast("string").alias("value"))
    new_id = F.col("conv_id") + _BIG
    log = (
        step(1, "set", "answer", F.lit("new"), "true").union(step(2, "set", "answer_id", new_id, "true")).union(step(3, "set", "answer_id", new_id + 1, "conv_id % 4 = 0"))
        .union(step(4, "delete", "", F.lit(""), "conv_id % 4 = 1")).union(step(5, "add", "", new_id, "conv_id % 4 = 2"))
    )
    return edits.replay(rows, log).groupBy("answer_id", "type", "answer").agg(F.count("*").alias("n"))
