"""Questions, their variants and answers: search, editing by row, groups and runs.

Rows of an import have an explicit index, because DataFrames have no order of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import contains_fold
from quern.operators import ranks
from quern.operators.relations import upsert
from quern.plans.find import Find
from quern.plans.paging import SIZES

#: Bounds of retention in days.
DAYS = (1, 3650)


def is_question(kind: Column) -> Column:
    """A missing type is no question."""
    return F.lower(kind).eqNullSafe(F.lit("question"))


def search(df: DataFrame, keyword: str, columns: tuple[str, ...] = ("question", "answer")) -> DataFrame:
    """Rows with the keyword in any column, in any case. A blank keyword passes all; null text is empty."""
    if not keyword.strip():
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | contains_fold(F.coalesce(F.col(c), F.lit("")), keyword.strip())
    return df.filter(hit)


def categories(df: DataFrame, column: str = "category") -> DataFrame:
    """Distinct non-empty values, in the order of the language's alphabet."""
    return df.select(column).filter(F.coalesce(F.col(column), F.lit("")) != "").distinct().orderBy(F.collate(F.col(column), "UNICODE"))


def run_ends(df: DataFrame, key: str = "answer_id", order: str = "idx", within: str | None = None, tasks: int = 0) -> DataFrame:
    """df with last_of_run: the next row's key differs, or there is none. A key that comes back starts another run.

    within: a column whose rows are edited together. Without it the table is one sequence,
    numbered by order (a unique number); Spark deals it out by range (into ``tasks`` parts, if
    given), and a part's last row looks at the first row of the next one, so no task holds the whole.
    """
    if within:
        cut, parts, at = df, [within], order
    else:
        cut = ranks.placed(df, [F.col(order)], tasks).withColumn("_part", ranks.part())
        parts, at = ["_part"], "_at"
    out = cut.withColumn("_next", F.lead(F.struct(F.col(key).alias("k"))).over(Window.partitionBy(*parts).orderBy(at)))
    if not within:  # a row for each part
        first = cut.groupBy("_part").agg(F.min_by(F.struct(F.col(key).alias("k")), "_at").alias("f"))
        after = first.select("_part", F.lead("f").over(Window.orderBy("_part")).alias("_after"))
        out = out.join(F.broadcast(after), "_part", "left").withColumn("_next", F.coalesce("_next", "_after"))
    last = F.col("_next").isNull() | ~F.col("_next.k").eqNullSafe(F.col(key))
    return out.withColumn("last_of_run", last).select(*df.columns, "last_of_run")


def first_questions(df: DataFrame) -> DataFrame:
    """For each answer_id its first question row: category and answer."""
    return df.filter(is_question(F.col("type"))).groupBy("answer_id").agg(F.min_by(F.struct("category", "answer"), "idx").alias("q")).select("answer_id", "q.category", "q.answer")


def inherit(df: DataFrame) -> DataFrame:
    """Every row with the category and answer of its group's first question row; its own where the group has none."""
    first = first_questions(df).select("answer_id", F.col("category").alias("_c"), F.col("answer").alias("_a"), F.lit(True).alias("_has"))
    out = df.join(first, "answer_id", "left")
    return out.withColumn("category", F.when(F.col("_has"), F.col("_c")).otherwise(F.col("category"))).withColumn("answer", F.when(F.col("_has"), F.col("_a")).otherwise(F.col("answer"))).select(*df.columns)


def edit(df: DataFrame, idx: int, column: str, value, old_id: int | None = None) -> DataFrame:
    """One cell changed. Of a question row, answer_id, category and answer also change in the rows, questions aside, of its old id."""
    cascade = F.lit(False)
    if old_id is not None and column in ("answer_id", "category", "answer"):
        cascade = (F.col("answer_id") == old_id) & ~is_question(F.col("type"))
    return df.withColumn(column, F.when((F.col("idx") == idx) | cascade, F.lit(value).cast(df.schema[column].dataType)).otherwise(F.col(column)))


def remove(df: DataFrame, idx: int, answer_id: int, question: bool) -> DataFrame:
    """A question goes with all rows of its id; another row goes alone."""
    return df.filter(~F.col("answer_id").eqNullSafe(F.lit(answer_id))) if question else df.filter(F.col("idx") != idx)


def variant_numbers(df: DataFrame) -> DataFrame:
    """For each answer_id the type of the next variant: one more than it has variants, which may be taken after a delete."""
    count = F.count_if(~is_question(F.col("type")))
    return df.groupBy("answer_id").agg(F.concat(F.lit("variant_"), count + 1).alias("next_type"))


def add_variant(df: DataFrame, idx: int, answer_id: int) -> DataFrame:
    """A blank variant of the group after row idx, with its question's category and answer or empty texts; later rows move down by one. An unknown group gets its first variant."""
    question = F.min_by(F.when(is_question(F.col("type")), F.struct("category", "answer")), F.when(is_question(F.col("type")), F.col("idx")))
    own = df.filter(F.col("answer_id") == answer_id).agg(F.count_if(~is_question(F.col("type"))).alias("n"), question.alias("q"))
    new = own.select(
        F.lit(idx + 1).alias("idx"), F.lit(answer_id).alias("answer_id"), F.coalesce("q.category", F.lit("")).alias("category"),
        F.concat(F.lit("variant_"), F.col("n") + 1).alias("type"), F.lit("").alias("content"), F.coalesce("q.answer", F.lit("")).alias("answer"),
    )
    moved = df.withColumn("idx", F.when(F.col("idx") > idx, F.col("idx") + 1).otherwise(F.col("idx")))
    return moved.unionByName(new.select(*[F.col(c).cast(df.schema[c].dataType) for c in df.columns]))


def bulk_counts(df: DataFrame) -> DataFrame:
    """df: id, ok, detail. One row: success_count, failure_count."""
    return df.agg(F.count_if("ok").alias("success_count"), F.count_if(~F.col("ok")).alias("failure_count"))


def bulk_failures(df: DataFrame) -> DataFrame:
    """The failed rows as a table (id, detail), for changes of any size."""
    return df.filter(~F.col("ok")).select("id", "detail")


def bulk_result(df: DataFrame) -> DataFrame:
    """df: id, ok, detail. One row: success_count, failure_count, failed_ids, failed_details.

    The answer to one request, whose failures fit a row; ``bulk_counts`` and ``bulk_failures`` have no such bound.
    """
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("id", "detail"))))
    return df.agg(F.count_if("ok").alias("success_count"), F.count_if(~F.col("ok")).alias("failure_count"), failed.alias("f")).select("success_count", "failure_count", F.col("f.id").alias("failed_ids"), F.col("f.detail").alias("failed_details"))


def listing(df: DataFrame, category: str | None = None, page: int = 1, size: int = SIZES[0], id_col: str = "answer_id") -> DataFrame:
    """A page of questions, of one category where that is given, by id."""
    return Find({"category": {"equals": category}}, id_col, size, page, id_col=id_col).run(df)


def select_answer(suggestions: DataFrame, faq: DataFrame, key: str = "answer_id") -> DataFrame:
    """Suggestions that were picked, with the decision and the text that their id stands for; unknown ids give none."""
    return suggestions.join(faq.select(key, "answer"), key).withColumn("decision", F.lit("answer"))


def save_edit(faq: DataFrame, variants: DataFrame, edits: DataFrame, answer_id: int, category: str | None, question: str, answer: str) -> tuple[DataFrame, DataFrame]:
    """(questions, variants) after an edit: the variants first, then the question itself; an empty category leaves the old one. The two are written one after the other, not as one."""
    change = {"category": category or None, "question": question, "answer": answer}
    own = F.col("answer_id") == answer_id
    done = faq.withColumns({c: F.when(own, F.coalesce(F.lit(v).cast("string"), F.col(c))).otherwise(F.col(c)) for c, v in change.items()})
    return done, upsert(variants, edits, "variant_id")


def configured(config: DataFrame, **changes) -> DataFrame:
    """The one row of settings with what is given; None leaves a setting as it is."""
    days = changes.get("log_retention_days")
    if days is not None and not DAYS[0] <= days <= DAYS[1]:
        raise ValueError(f"days must be {DAYS[0]} to {DAYS[1]}")
    return config.withColumns({c: F.lit(v).cast(config.schema[c].dataType) for c, v in changes.items() if v is not None})


def user_update(users: DataFrame, user_id: int, is_admin: bool, full_name: str = "", is_active: bool | None = None) -> DataFrame:
    """One user changed: an empty name leaves the old one, and only an admin sets is_active."""
    own = F.col("id") == user_id
    change = {"full_name": full_name or None, "is_active": is_active if is_admin else None}
    return users.withColumns({c: F.when(own, F.lit(v)).otherwise(F.col(c)) for c, v in change.items() if v is not None})


def violations(df: DataFrame, required: list[str], enums: dict[str, tuple[str, ...]]) -> DataFrame:
    """df with violations: names of required columns that are missing and of enumerated ones with another value."""
    tests = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", c) for c in required]
    tests += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*v), c) for c, v in enums.items()]
    return df.withColumn("violations", F.array_distinct(F.array_compact(F.array(*tests))))


def rewrite(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Literal replacement by active rules in their order. This engine's own design: the rules' semantics are not specified anywhere."""
    for raw, normalized in rules:
        text = F.replace(text, F.lit(raw), F.lit(normalized))
    return text


def decide(suggestions: DataFrame, key: str, similarity: float, margin: float) -> DataFrame:
    """For each key the decision on its scored suggestions: answer, ambiguity or fallback. This engine's own design.

    The best score decides if it reaches ``similarity`` and leads the next by ``margin``.
    """
    w = Window.partitionBy(key).orderBy(F.desc("score"), "answer_id")
    two = suggestions.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 2")  # each task keeps two a key before the shuffle
    pick = lambda k, c: F.max(F.when(F.col("_rn") == k, F.col(c)))
    top = two.groupBy(key).agg(pick(1, "answer_id").alias("answer_id"), pick(1, "score").alias("best"), pick(2, "score").alias("second"))
    sure = F.col("best") - F.coalesce("second", F.lit(float("-inf"))) >= margin
    decision = F.when(F.col("best") < similarity, "fallback").when(sure, "answer").otherwise("ambiguity")
    return top.select(key, decision.alias("decision"), F.when(decision == "answer", F.col("answer_id")).alias("answer_id"), "best")
