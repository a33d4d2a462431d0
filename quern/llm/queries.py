"""One query for each operator, over the whole of its table, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, graph, infill, licences, lines, mixing, packing, passages, periods, simhash, suffixes, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels))


#: Of the URL filter: verdict, host and path.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query
def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES, table(spark, sf_dir, "labels"))


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), length=400)


@query
def op5_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), buckets=16, budget=8192)


@query
def op6_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, budget=4)


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_passages(table(spark, sf_dir, "documents"), length=35)


@query
def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.drop_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op9_decontaminate_cgk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op11_fim_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


@query
def op12_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.find(table(spark, sf_dir, "documents"), plant=True)


#: Every window of a text by its hash, the repeated ones, and what they cover; the texts are cut from what is left between.
ORACLE["op4_suffix_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS MATERIALIZED (SELECT r, i, md5(b[i:i + 399]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d) AS t),
s256 AS MATERIALIZED (SELECT r, i, md5(b[i:i + 255]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 254)) AS i FROM d) AS t),
twice AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
run AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM twice),
span AS (SELECT r, min(i) AS lo, max(i) + 400 AS hi FROM run GROUP BY r, g),
edge AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 1) AS was FROM span),
head AS (SELECT r, sum(hi - lo) AS n, count(*) AS k, max(hi) AS last, string_agg(hex(b[was:lo - 1]), '' ORDER BY lo) AS kept FROM edge JOIN d USING (r) GROUP BY r),
half AS (
    SELECT r, sum(least(256, coalesce(next - i, 256))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM s256 WHERE h IN (SELECT h FROM s256 GROUP BY h HAVING count(*) > 1)) AS t GROUP BY r
)
SELECT d.doc_id, octet_length(d.b) AS n_bytes, CAST(coalesce(h.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(h.k, 0) AS BIGINT) AS n_spans,
CASE WHEN h.r IS NULL THEN sha256(d.b) ELSE sha256(unhex(h.kept || hex(d.b[h.last:octet_length(d.b)]))) END AS kept_sha256, CAST(coalesce(half.n, 0) AS BIGINT) AS n_repeated
FROM d LEFT JOIN head AS h ON d.r = h.r LEFT JOIN half ON d.r = half.r
"""
ORACLE["op7_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT r, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM d) AS t),
twice AS (SELECT r, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, i + k AS i FROM twice, (SELECT unnest(range(35)) AS k) AS o),
kept AS (SELECT w.r, string_agg(w.word, ' ' ORDER BY w.i) AS text FROM (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d) AS w ANTI JOIN gone AS g ON w.r = g.r AND w.i = g.i GROUP BY w.r)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY r) AS g ON d.r = g.r LEFT JOIN kept ON d.r = kept.r
"""
#: All pairs, and reachability step by step.
ORACLE["op10_embedding_graph"] = r"""
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
ok AS (SELECT r, vec_id, v, sqrt(list_dot_product(v, v)) AS size FROM e WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
link AS MATERIALIZED (SELECT a.r, b.r AS other FROM ok AS a JOIN ok AS b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.95),
reach AS (SELECT r, r AS other FROM e UNION SELECT reach.r, link.other FROM reach JOIN link ON reach.other = link.r)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM e JOIN (SELECT reach.r, min(o.vec_id) AS component_id FROM reach JOIN e AS o ON reach.other = o.r GROUP BY reach.r) AS c ON e.r = c.r LEFT JOIN (SELECT r, count(*) AS n FROM link GROUP BY r) AS n ON e.r = n.r
"""

#: Offsets are the lengths of the first units, joined.
ORACLE["op11_fim_units"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT r, doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
f AS (
    SELECT r, doc_id, text, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS low, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
),
c AS (SELECT *, array_to_string(u[1:low], '') AS prefix, array_to_string(u[low + 1:high], '') AS middle, array_to_string(u[high + 1:n], '') AS suffix FROM f),
o AS (SELECT *, CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END AS output FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
sha256(output) AS output_sha256, sha256(CASE WHEN form = 'plain' THEN output ELSE prefix || middle || suffix END) AS restored_sha256 FROM o
"""
#: The rounds of clamping are a recursion over the words for a unit of weight; the place in the seeded order is a sum over a window.
ORACLE["op12_water_filling"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('1:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:16] AS key FROM documents),
s AS MATERIALIZED (SELECT source, source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
unit(k, u) AS (
    SELECT 0, CAST(0 AS DOUBLE)
    UNION ALL
    SELECT k + 1, (SELECT CAST(sum(source_size) - coalesce(sum(CASE WHEN weight * unit.u > 3 * source_size THEN 3 * source_size END), 0) AS DOUBLE) / CAST(sum(CASE WHEN NOT weight * unit.u > 3 * source_size THEN weight END) AS DOUBLE) FROM s)
    FROM unit WHERE k < (SELECT count(*) FROM s)
),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * (SELECT coalesce(max(u), 0) FROM unit)) AS target FROM s),
w AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
x AS (SELECT doc_id, size, source_size, target, whole, CAST(greatest(0, least(size, CAST(floor(target + 0.5) AS BIGINT) - whole * source_size - before)) AS BIGINT) AS part FROM p JOIN w ON p.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target, whole * size + part AS taken, whole, part FROM x
"""
#: A run's words stand again a period on, so its fives do: periods come from pairs of equal fives, runs from unbroken stretches of equal words.
ORACLE["op13_periodic_runs"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT) for i in range(8)]), lambda e, z: xor(e >> 1, CASE WHEN e & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))), CAST(4294967295 AS BIGINT)) AS h
    FROM documents
),
a AS (SELECT r, doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM d),
m AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM a),
t AS MATERIALIZED (SELECT r, unnest(w) AS word, unnest(range(n)) AS i FROM m),
five AS MATERIALIZED (SELECT r, i, md5(array_to_string(w[i + 1:i + 5], ' ')) AS f FROM (SELECT r, w, unnest(range(n - 4)) AS i FROM m) AS x),
twice AS MATERIALIZED (SELECT * FROM five SEMI JOIN (SELECT r, f FROM five GROUP BY r, f HAVING count(*) > 1) AS y USING (r, f)),
period AS MATERIALIZED (SELECT x.r, y.i - x.i AS q FROM twice AS x JOIN twice AS y ON x.r = y.r AND x.f = y.f AND x.i < y.i GROUP BY x.r, y.i - x.i HAVING count(*) >= greatest(6, 4 * q) - q - 4),
equal AS (SELECT x.r, p.q, x.i, x.i - row_number() OVER (PARTITION BY x.r, p.q ORDER BY x.i) AS g FROM period AS p JOIN t AS x ON p.r = x.r JOIN t AS y ON y.r = x.r AND y.i = x.i + p.q AND y.word = x.word),
stretch AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM equal GROUP BY r, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
run AS MATERIALIZED (SELECT r, start, length, min(q) AS q FROM stretch GROUP BY r, start, length),
s AS (SELECT r, count(*) AS n, arg_max({'s': start, 'l': length, 'q': q}, (length, -start, -q)) AS best, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM run),
kept AS (SELECT t.r, string_agg(word, ' ' ORDER BY t.i) AS text FROM t ANTI JOIN gone ON t.r = gone.r AND t.i = gone.i GROUP BY t.r)
SELECT m.doc_id, coalesce(s.n, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM m LEFT JOIN s ON m.r = s.r LEFT JOIN kept ON m.r = kept.r
"""


# The parts of op2, op3 and op5 that SQL can express, by the operators' own functions and over the same whole tables.


@query
def urls_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, path = urls.host_and_path(F.col("url"))
    split = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    rule = urls.rule_of(F.col("host"), F.col("path"), RULES)
    return split.select("page_id", "host", "path", rule["rule"].alias("rule"), rule["verdict"].alias("rule_verdict"))


ORACLE["urls_by_rule"] = """
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS v(verdict, name, start)),
fit AS (SELECT page_id, verdict, name || start AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(name || start) DESC) AS rn FROM p JOIN r ON (p.host = r.name OR ends_with(p.host, '.' || r.name)) AND starts_with(p.path, r.start))
SELECT p.page_id, p.host, p.path, fit.rule, fit.verdict AS rule_verdict FROM p LEFT JOIN fit ON p.page_id = fit.page_id AND fit.rn = 1
"""


@query
def licence_base_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


ORACLE["licence_base_phrases"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT * FROM (VALUES ('under the mit license', 4, 'mit'), ('apache license version 2', 4, 'apache-2'), ('cc by nc', 3, 'cc-by-nc')) AS v(phrase, n, label)),
hit AS (SELECT r, i - 1 AS pos, label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) AS t JOIN b ON t.w[i] = split_part(b.phrase, ' ', 1) AND array_to_string(t.w[i:i + n - 1], ' ') = b.phrase),
s AS (SELECT r, count(*) AS n, min(pos) AS first, max(pos) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(s.n, 0) AS n_base, s.first AS first_word, s.last AS last_word, coalesce(s.labels, '') AS base_labels FROM d LEFT JOIN s ON d.r = s.r
"""


@query
def packing_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", packing.tokens(F.col("text")).alias("n_tokens"))


ORACLE["packing_lengths"] = r"""
SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+|[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\s\p{Z}]')) AS BIGINT) AS n_tokens FROM documents
"""
