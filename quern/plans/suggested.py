"""Named queries on suggestions, with SQL that compares every text with every other by their terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import suggest
from quern.plans.catalog import query, table

_BIG = 1_000_000
_SCORED = rf"""WITH q AS (
    SELECT conv_id AS answer_id, text FROM conversations
    UNION ALL SELECT conv_id + {_BIG}, array_to_string(string_split(text, ' ')[1:(len(string_split(text, ' ')) + 1) // 2], ' ') FROM conversations WHERE conv_id % 3 = 0
),
a AS (SELECT conv_id * {_BIG} + turn AS ask_id, array_to_string(string_split(text, ' ')[1:(len(string_split(text, ' ')) * (5 - conv_id % 5) + 4) // 5], ' ') AS text FROM conversations WHERE role = 'user'),
qt AS (SELECT DISTINCT answer_id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{N}}]+'))) AS t FROM q),
tr AS (SELECT ask_id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{N}}]+'))) AS t FROM a),
e AS (SELECT row_number() OVER () AS e, t FROM (SELECT DISTINCT t FROM qt WHERE len(t) > 0) AS d),
et AS MATERIALIZED (SELECT e, unnest(t) AS term FROM e),
v AS MATERIALIZED (SELECT term, length(bin((SELECT count(*) FROM e) // count(*))) AS w FROM et GROUP BY term),
ew AS (SELECT e, sum(w) AS w FROM et JOIN v USING (term) GROUP BY e),
aw AS MATERIALIZED (SELECT ask_id, term, coalesce(w, length(bin((SELECT count(*) FROM e)))) AS w FROM (SELECT ask_id, unnest(t) AS term FROM tr) AS x LEFT JOIN v USING (term)),
al AS (SELECT ask_id, sum(w) AS w FROM aw GROUP BY ask_id),
b AS (SELECT ask_id, e, sum(aw.w) AS w FROM aw JOIN et USING (term) GROUP BY ask_id, e),
s AS (SELECT ask_id, e, b.w AS shared, al.w + ew.w - b.w AS either FROM b JOIN al USING (ask_id) JOIN ew USING (e)),
r AS (SELECT ask_id, answer_id, max(CAST(shared AS DOUBLE) / CAST(either AS DOUBLE)) AS score FROM s JOIN e USING (e) JOIN qt ON qt.t = e.t WHERE shared * 1000 >= either * 300 GROUP BY ask_id, answer_id),
top AS (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY score DESC, answer_id) AS place FROM r)
"""


def _asked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """What users wrote, cut to between a fifth and all of its words; and every turn as a question, one conversation in three with half of its words under another answer too."""
    turns = table(spark, sf_dir, "conversations")
    words = F.split("text", " ", -1)
    cut = lambda n: F.array_join(F.slice(words, 1, n.cast("int")), " ").alias("text")
    asked = turns.filter("role = 'user'").select((F.col("conv_id") * _BIG + F.col("turn")).alias("ask_id"), cut(F.floor((F.size(words) * (5 - F.col("conv_id") % 5) + 4) / 5)))
    halves = turns.filter("conv_id % 3 = 0").select((F.col("conv_id") + _BIG).alias("answer_id"), cut(F.floor((F.size(words) + 1) / 2)))
    return asked, turns.select(F.col("conv_id").cast("long").alias("answer_id"), "text").unionByName(halves)


@query(_SCORED + "SELECT ask_id, answer_id, score, place FROM top WHERE place <= 2")
def c1_suggestions(spark, sf_dir):
    return suggest.suggestions(*_asked(spark, sf_dir))


@query(_SCORED + """, two AS (SELECT ask_id, max(CASE WHEN place = 1 THEN score END) AS best, max(CASE WHEN place = 2 THEN score END) AS second, max(CASE WHEN place = 1 THEN answer_id END) AS answer_id FROM top WHERE place <= 2 GROUP BY ask_id),
d AS (SELECT a.ask_id, CASE WHEN best IS NULL OR best < 0.6 THEN 'fallback' WHEN second IS NULL OR best - second >= 0.1 THEN 'answer' ELSE 'ambiguity' END AS decision, answer_id, best FROM (SELECT DISTINCT ask_id FROM a) AS a LEFT JOIN two USING (ask_id))
SELECT ask_id, decision, CASE WHEN decision = 'answer' THEN answer_id END AS answer_id, best FROM d""")
def c1_decisions(spark, sf_dir):
    """The decision on every question, from its scored suggestions."""
    asked, questions = _asked(spark, sf_dir)
    return suggest.decisions(asked, suggest.suggestions(asked, questions))
