"""URL filter: host and path rules first, then a tree of path templates with labelled purity.

Each host has a tree. A node's children are the next path segments, digits masked. A child
with a fair share of its node's pages is a branch; the others are wildcards: one for those
whose labelled rate is significantly above the rest of the node, one for those below, one
for all else. Sibling branches whose labelled rates do not differ by a two-proportion test
are merged. The tree grows as deep as the paths go; a node that holds one shape of path or
too few pages for two branches ends there.
A leaf is a template; it is rejected if the share of unwanted pages among its labelled
ones, smoothed towards its host's share and that towards the share of all, is too high.

Pages with one path shape are counted together before anything is shuffled, so a host may
hold any part of the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Workspace

#: A branch holds so many pages and such a share of its node, so a node has at most 1 / SHARE branches and a wildcard.
LEAST, SHARE = 5, 0.02
#: Weight of the prior, in labelled pages; z below which two branches are alike; the share from which a template is rejected.
WEIGHT, ALIKE, REJECT = 4.0, 1.96, 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ://, A-Z in lower case, and path up to ? or #. Both empty if there is no ://."""
    cut = F.instr(url, "://")
    rest = F.when(cut > 0, F.substring(url, cut + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<verdict, rule> of the longest rule that fits, or null. rules: (verdict, host/path), in the plan: a short list."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, tail = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + tail)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def alike(seen: list[int], bad: list[int], names: list[str], least_z: float = ALIKE) -> list[str]:
    """For each branch, the name of the merged branch it goes into: neighbours by rate that a two-proportion test can't tell apart."""
    order = sorted(range(len(names)), key=lambda k: (bad[k] / seen[k] if seen[k] else -1.0, names[k]))
    out, held, n, x = [""] * len(names), [], 0, 0

    def close() -> None:
        name = "|".join(sorted(names[k] for k in held))
        for k in held:
            out[k] = name

    for k in order:
        if held:
            share = (x + bad[k]) / max(n + seen[k], 1)
            spread = np.sqrt(share * (1 - share) * (1 / n + 1 / seen[k])) if n and seen[k] else 0.0
            if spread and abs(x / n - bad[k] / seen[k]) > least_z * spread:
                close()
                held, n, x = [], 0, 0
        held.append(k)
        n, x = n + seen[k], x + bad[k]
    if held:
        close()
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _merged(seen: pd.Series, bad: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([alike(list(s), list(b), list(n)) for s, b, n in zip(seen, bad, names, strict=True)])


def unlike() -> Column:
    """z of a child's labelled rate (seen, bad) against that of the rest of its node (all_seen, all_bad); null where either has too few."""
    rest, share = F.col("all_seen") - F.col("seen"), F.col("all_bad") / F.col("all_seen")
    spread = F.sqrt(share * (1 - share) * (1 / F.col("seen") + 1 / rest))
    return F.when((F.col("seen") >= LEAST) & (rest > 0) & (share > 0) & (share < 1), (F.col("bad") / F.col("seen") - (F.col("all_bad") - F.col("bad")) / rest) / spread)


def grow(ws: Workspace, shapes: DataFrame) -> DataFrame:
    """shapes: shape, host, segs array<string>, n, seen, bad. (shape, host, template, seen, bad), template being the path from the root to a leaf."""
    out = ["shape", "host", "node", "seen", "bad"]
    now, done, d = ws.save(shapes.withColumn("node", F.lit(""))), None, 0
    while True:
        nodes = ws.save(now.groupBy("host", "node").agg(F.count("*").alias("shapes"), F.sum("n").alias("all"), F.sum("seen").alias("all_seen"), F.sum("bad").alias("all_bad")))
        placed = now.join(nodes.select("host", "node", "shapes", "all"), ["host", "node"])
        rest = F.concat(F.lit("/"), F.concat_ws("/", F.slice("segs", d + 1, F.greatest(F.size("segs") - d, F.lit(0)))))
        end = F.when(F.size("segs") <= d, F.col("node")).when(F.col("shapes") == 1, F.concat("node", rest)).when(F.col("all") < 2 * LEAST, F.concat("node", F.lit("/**")))
        placed = ws.save(placed.withColumn("end", end).drop("shapes", "all"))
        ended = placed.filter("end IS NOT NULL").withColumn("node", F.col("end")).select(*out)
        done = ended if done is None else done.union(ended)
        now_d = placed.filter("end IS NULL").drop("end").withColumn("seg", F.get("segs", F.lit(d)))
        counts = ws.save(now_d.groupBy("host", "node", "seg").agg(*[F.sum(c).alias(c) for c in ("n", "seen", "bad")]).join(nodes.drop("shapes"), ["host", "node"]))
        if counts.isEmpty():
            return done.withColumnRenamed("node", "template")
        large = (F.col("n") >= LEAST) & (F.col("n") >= SHARE * F.col("all"))
        # At most 1 / SHARE branches a node.
        lists = ws.save(counts.filter(large).groupBy("host", "node").agg(F.array_sort(F.collect_list(F.struct("seg", "seen", "bad"))).alias("b")))
        named = lists.select("host", "node", F.col("b.seg").alias("seg"), _merged(F.col("b.seen"), F.col("b.bad"), F.col("b.seg")).alias("name"))
        named = named.select("host", "node", F.explode(F.arrays_zip("seg", "name")).alias("x")).select("host", "node", "x.seg", "x.name")
        odd = counts.filter(~large & (F.abs(unlike()) > ALIKE)).select("host", "node", "seg", F.when(unlike() > 0, "*+").otherwise("*-").alias("name"))
        named = ws.save(named.union(odd))
        now = ws.save(now_d.join(named, ["host", "node", "seg"], "left").withColumn("node", F.concat("node", F.lit("/"), F.coalesce("name", F.lit("*")))).drop("seg", "name"))
        ws.drop(nodes, counts, lists, named)
        d += 1


def judge(
    pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", unwanted: str = "quality = 0"
) -> DataFrame:
    """One row for each row of pages: (id_col, host, path, rule, verdict, template, purity).

    A rule's verdict holds where one fits; elsewhere a page is blocked if its template's
    smoothed share of unwanted labelled pages is REJECT or more and any of its pages has a label. purity is 1 less that share.
    labels: label_id, and what ``unwanted`` tests; an id that comes twice is unwanted if any
    of its rows is; null ids and unknown tests label nothing. A null url, or one without
    ://, has an empty host and path and is judged like any other. Null ids and repeated rows
    stay. Paths of any depth and length are judged whole. Other columns are not read. Without any label nothing is rejected.
    """
    ws = Workspace(pages.sparkSession, "urls")
    plain = pages.select(F.col(id_col).cast("long").alias("_page"), F.col(url_col).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    base = plain.select("_page", host.alias("host"), path.alias("path"))
    segs = F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), lambda x: F.regexp_replace(x, "[0-9]+", "0"))
    base = base.withColumn("segs", segs).withColumn("shape", F.concat_ws("/", F.col("host"), F.concat_ws("/", "segs")))
    known = ws.save(labels.select(F.col(label_id).cast("long").alias("_page"), F.expr(unwanted).cast("int").alias("_bad")).filter("_page IS NOT NULL AND _bad IS NOT NULL").groupBy("_page").agg(F.max("_bad").alias("_bad")))
    marked = base.join(known, "_page", "left")
    shapes = ws.save(marked.groupBy("shape", "host", "segs").agg(F.count("*").alias("n"), F.count("_bad").alias("seen"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad")))
    leaves = ws.save(grow(ws, shapes))
    seen, bad = shapes.agg(F.sum("seen"), F.sum("bad")).first()
    overall = (bad or 0) / seen if seen else 0.0
    smooth = lambda prior: (F.col("bad") + WEIGHT * prior) / (F.col("seen") + WEIGHT)
    hosts = ws.save(leaves.groupBy("host").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad")).select("host", smooth(F.lit(overall)).alias("prior")))
    templates = ws.save(leaves.groupBy("host", "template").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad")))
    rated = ws.save(templates.join(hosts, "host").select("host", "template", "seen", smooth(F.col("prior")).alias("share")))
    by_shape = ws.save(leaves.drop("seen").join(rated, ["host", "template"]).select("shape", "template", (F.col("share") >= REJECT).alias("bad_enough"), "seen", "share"))
    out = base.join(by_shape, "shape").withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    return out.select(
        F.col("_page").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("bad_enough") & (F.col("seen") > 0), "block").otherwise("allow")).alias("verdict"), "template", (1 - F.col("share")).alias("purity"),
    )
