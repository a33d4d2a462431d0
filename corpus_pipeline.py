"""The corpus pipeline: toxicity, line and near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, lines, packing, simhash, toxicity
from quern.llm.common import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go. Null and empty texts are scored like others; null ids and repeated rows stay as they are."""
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    kept = toxicity.score(rows, model, keep=["row"]).filter("score < 0.5")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, whatever their share of a document; near copies count as one text. n_chars follows the text. Null texts stay null; rows that repeat are treated alike."""
    own = "_own_n_dropped"  # a column of that name is the table's own
    done = lines.drop_lines(docs.withColumnRenamed("n_dropped", own), copies=False)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", n_chars).select(*[F.col(own if c == "n_dropped" else f"`{c}`").alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, that of the least id, null first. Null and wordless texts are one group; rows that repeat are copies."""
    return simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or nearly, go. A null text holds none."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document, null ids and repeated rows too."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_boilerplate), ("SimHash near-dedup", drop_near_copies), ("benchmark decontamination", drop_leaks), ("packing", pack)]
#: The stages learn, embed and link; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
