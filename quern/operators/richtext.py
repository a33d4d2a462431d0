"""Rich text kept as a JSON tree: its nodes in reading order, its text, its figures.

The tree is walked a level at a time: every node of a level that has children becomes a row
for each of them, so trees of any depth are walked in as many rounds as the deepest has
levels, whatever the number of texts. A node's place is the list of its ancestors' positions
and its own; lists compare in reading order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.storage import settled

#: Fixed value: the collection whose uploads are figures.
FIGURES_OF = "media"


def _get(node: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(node), path, kind)


def nodes(df: DataFrame, id_col: str, rich_col: str) -> DataFrame:
    """(id_col, place, type, text, relation, value): a row for each node below the root, null where a node has no such property; value is a variant.

    A null or broken document has no nodes, and neither has one without a root. Children
    that are no list are none; a child that is no object is a node without properties. A
    document that comes twice has its nodes twice, at the same places.
    """
    level = df.select(F.col(id_col), F.array().cast("array<int>").alias("place"), F.try_parse_json(rich_col).alias("node"))
    level = level.select(id_col, "place", _get("node", "$.root", "variant").alias("node"))
    found: list[DataFrame] = []
    while True:
        children = level.select(id_col, "place", F.posexplode(_get("node", "$.children", "array<variant>")).alias("at", "node"))
        level = settled(children.select(id_col, F.concat("place", F.array("at")).alias("place"), "node"))
        if found and level.isEmpty():
            break
        found.append(level)
    every = reduce(DataFrame.unionAll, found)
    return every.select(id_col, "place", _get("node", "$.type").alias("type"), _get("node", "$.text").alias("text"), _get("node", "$.relationTo").alias("relation"), _get("node", "$.value", "variant").alias("value"))


def plain(tree: DataFrame, id_col: str) -> DataFrame:
    """(id_col, plain): the texts of each document that has nodes, in reading order, joined by spaces. A document's texts are gathered in one row, as they were before."""
    texts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("place", "text"))))
    return tree.groupBy(id_col).agg(F.array_join(F.transform(texts, lambda x: x["text"]), " ").alias("plain"))


def figures(tree: DataFrame, id_col: str, media: DataFrame) -> DataFrame:
    """(id_col, place, caption, url): uploads that are shown. media: id, caption, url, each id once.

    An upload is a figure only if it relates to media and its value is resolved: an object
    in the tree itself, or an id that media has. A value that leads nowhere, and a null one,
    gives none.
    """
    uploads = tree.filter((F.col("type") == "upload") & (F.col("relation") == FIGURES_OF) & F.col("value").isNotNull())
    whole = F.schema_of_variant(F.col("value")).startswith("OBJECT")
    own = uploads.filter(whole).select(id_col, "place", _get("value", "$.caption").alias("caption"), _get("value", "$.url").alias("url"))
    named = uploads.filter(~whole).select(id_col, "place", _get("value", "$").alias("_media"))
    known = media.select(F.col("id").cast("string").alias("_media"), "caption", "url")
    return own.unionByName(named.join(known, "_media").drop("_media"))
