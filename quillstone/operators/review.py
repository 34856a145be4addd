"""What a reviewer reads: joined rows, counts, trees and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import x_y_w_h
from ..functions.numbers import half_up

KEY = "assessment_id"


def status(mapping_type: Column) -> Column:
    return F.when(mapping_type == "unanswered", "unanswered").when(mapping_type == "unmatched", "unmatched").otherwise("answered")


def correctness(score: Column, most: Column, method: Column) -> Column:
    """True at full marks, false at none, null between, without a grade, when skipped or out of 0."""
    graded = score.isNotNull() & (method != "skipped") & (most > 0)
    return F.when(graded & (score >= most), True).when(graded & (score <= 0), False)


def latest(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(*[F.col(o).desc() if isinstance(o, str) else o for o in order])
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def review_rows(mappings: DataFrame, questions: DataFrame, answers: DataFrame, grades: DataFrame) -> DataFrame:
    """Every mapping with its question, answer and grade; pages count from 0, boxes as x, y, w, h."""
    q = questions.select(KEY, "question_id", "display_number", "normalized_number", "parent_number", F.col("text").alias("question_text"), "max_marks", "order_index")
    a = answers.select(KEY, "answer_id", F.col("raw_text").alias("answer_text"), "detected_label")
    g = grades.select(KEY, "question_id", "score", "max_score", "method", "feedback")
    df = mappings.join(q, [KEY, "question_id"], "left").join(a, [KEY, "answer_id"], "left").join(g, [KEY, "question_id"], "left")
    shown = F.transform("regions", lambda r: F.struct((r["page"] - 1).alias("page"), x_y_w_h(r["bbox"]).alias("box")))
    return df.select(
        KEY, "question_id", "answer_id", status(F.col("mapping_type")).alias("status"), "mapping_type", "confidence", "review_status",
        F.coalesce("display_number", "detected_label").alias("number"), "parent_number", "normalized_number", "order_index", "question_text", "answer_text",
        "score", F.coalesce("max_score", "max_marks").alias("max_score"), correctness(F.col("score"), F.col("max_score"), F.col("method")).alias("is_correct"),
        "feedback", shown.alias("regions"), F.array_distinct(F.transform(shown, lambda r: r["page"])).alias("pages"),
    )


def result_counts(mappings: DataFrame, by: list[str]) -> DataFrame:
    kind = F.col("mapping_type")
    return mappings.groupBy(*by).agg(
        F.count(F.lit(1)).alias("mappings"),
        F.count_if(kind == "unanswered").alias("unanswered"),
        F.count_if(kind == "unmatched").alias("unmatched"),
        F.greatest(F.lit(0), F.count(F.lit(1)) - F.count_if(kind.isin("unanswered", "unmatched"))).alias("answered"),
        F.count_if(F.col("review_status") == "needs_review").alias("needs_review"),
        F.count_if(F.col("review_status") == "auto_accepted").alias("auto_accepted"),
    )


def answered_share(answered: Column, questions: Column) -> Column:
    return half_up(100.0 * answered / F.greatest(questions, F.lit(1)), 2)


def tree(rows: DataFrame, by: list[str], number: str, parent: str, order: str) -> DataFrame:
    """Adds ``group_key`` and ``is_child``; a row whose parent is missing stands at the top."""
    parents = rows.select(*by, F.col(number).alias(parent), F.lit(True).alias("is_child"), F.col(order).alias("__group_order")).distinct()
    df = rows.join(parents, [*by, parent], "left").withColumn("is_child", F.coalesce("is_child", F.lit(False)))
    return df.withColumn("group_key", F.when(F.col("is_child"), F.col(parent)).otherwise(F.col(number))).withColumn(
        "group_order", F.when(F.col("is_child"), F.col("__group_order")).otherwise(F.col(order))
    ).drop("__group_order")


def filter_tree(rows: DataFrame, by: list[str], matches: Column) -> DataFrame:
    """Groups where any row matches: a parent that matches keeps all its children, else
    the children that match are kept with it."""
    df = rows.withColumn("__hit", F.coalesce(matches, F.lit(False)))
    group = Window.partitionBy(*by, "group_key")
    any_hit = F.bool_or("__hit").over(group)
    parent_hit = F.bool_or(F.col("__hit") & ~F.col("is_child")).over(group)
    df = df.withColumn("__any", any_hit).withColumn("__parent", parent_hit)
    return df.filter("__any and (not is_child or __parent or __hit)").drop("__hit", "__any", "__parent")


def search(text: Column, number: Column, query: str) -> Column:
    """Whether a text holds the query, or it reads ``question N``; case does not matter."""
    needle = query.strip().lower()
    return F.lower(text).contains(needle) | F.lower(F.concat(F.lit("question "), number)).contains(needle)


def status_filter(wanted: str, is_correct: Column, row_status: Column, score: Column, most: Column) -> Column:
    return {
        "all": F.lit(True),
        "correct": F.coalesce(is_correct, F.lit(False)),
        "incorrect": F.coalesce(~is_correct, F.lit(False)),
        "partial": F.coalesce((score > 0) & (score < most), F.lit(False)),
        "unanswered": row_status == "unanswered",
    }[wanted]


def apply_corrections(mappings: DataFrame, corrections: DataFrame, answers: DataFrame) -> DataFrame:
    """A reviewer's changes by question: another answer of the same assessment makes the
    mapping human_corrected (and an unanswered one direct), else the status is set.
    Changes to unknown statuses or answers of other assessments are left out."""
    allowed = F.col("new_status").isNull() | F.col("new_status").isin("auto_accepted", "needs_review", "human_confirmed", "human_corrected")
    known = answers.select(KEY, F.col("answer_id").alias("new_answer"), F.lit(True).alias("known"), F.col("regions").alias("new_regions"))
    fixes = corrections.filter(allowed).join(known, [KEY, "new_answer"], "left").filter("new_answer is null or known")
    df = mappings.join(fixes, [KEY, "question_id"], "left")
    moved = F.col("new_answer").isNotNull()
    return df.select(
        KEY, "question_id", F.coalesce("new_answer", "answer_id").alias("answer_id"),
        F.when(moved & (F.col("mapping_type") == "unanswered"), "direct").otherwise(F.col("mapping_type")).alias("mapping_type"),
        "confidence",
        F.when(moved, "human_corrected").otherwise(F.coalesce("new_status", "review_status")).alias("review_status"),
        F.when(moved, F.col("new_regions")).otherwise(F.col("regions")).alias("regions"),
        "evidence", "corrected_by",
    )


def evaluate(truth: DataFrame, found: DataFrame, by: list[str], truth_col: str, found_col: str) -> DataFrame:
    """Precision, recall and F1 of predicted keys against true ones (0 where undefined)."""
    t = truth.select(*by, F.col(truth_col).alias("key")).distinct().withColumn("t", F.lit(1))
    f = found.select(*by, F.col(found_col).alias("key")).distinct().withColumn("f", F.lit(1))
    both = t.join(f, [*by, "key"], "full")
    sums = both.groupBy(*by).agg(F.count("t").alias("relevant"), F.count("f").alias("retrieved"), F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("hits"))

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    p, r = share(F.col("hits"), F.col("retrieved")), share(F.col("hits"), F.col("relevant"))
    return sums.withColumns({"precision": half_up(p, 4), "recall": half_up(r, 4), "f1": half_up(share(2 * p * r, p + r), 4)})
