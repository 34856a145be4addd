"""What the service's routes and its review screen read: wire rows, lookups, small projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import iou
from ..functions.numbers import half_up
from ..functions.similarity import levenshtein_share
from ..schemas import DEFAULTS, STAGE_PROGRESS, Params

#: Field names of the wire rows, by kind, and the columns that they show.
WIRE = {
    "assessment": {"id": "assessment_id", "title": "title", "status": "status", "question_doc_id": "question_doc_id", "answer_doc_id": "answer_doc_id"},
    "document": {"document_id": "document_id", "kind": "kind", "page_count": "page_count", "classification": "classification", "created": "created", "job_id": "job_id"},
    "job": {"job_id": "job_id", "assessment_id": "assessment_id", "stage": "stage", "status": "status", "progress": "progress", "error": "error"},
    "question": {
        "id": "question_id", "display_number": "display_number", "normalized_number": "normalized_number", "parent_id": "parent_id", "text": "text",
        "order_index": "order_index", "optional": "optional", "max_marks": "max_marks", "confidence": "confidence", "pages": "pages", "regions": "regions",
    },
    "answer": {
        "id": "answer_id", "raw_text": "raw_text", "normalized_text": "normalized_text", "detected_label": "detected_label", "confidence": "confidence",
        "extraction_method": "extraction_method", "is_continuation_of": "is_continuation_of", "pages": "page_numbers", "regions": "regions",
    },
    "mapping": {
        "id": "mapping_id", "question_id": "question_id", "answer_id": "answer_id", "mapping_type": "mapping_type", "confidence": "confidence",
        "review_status": "review_status", "evidence": "evidence", "regions": "regions",
    },
    "grade": {"id": "grade_id", "mapping_id": "mapping_id", "score": "score", "max_score": "max_score", "breakdown": "breakdown", "feedback": "feedback", "method": "method"},
    "results": {
        "assessment_id": "assessment_id", "mapping_count": "mappings", "needs_review": "needs_review", "unanswered": "unanswered", "unmatched": "unmatched",
        "total_score": "total_score", "max_score": "max_score", "percentage": "percentage",
    },
}
#: The stage that the progress screen shows for a job's stage.
SHOWN_STAGE = {
    "ingestion": "rendering-pages", "extraction": "rendering-pages", "question_extraction": "extracting-questions", "answer_extraction": "extracting-answers",
    "mapping": "mapping-grading", "grading": "mapping-grading", "done": "done",
}
#: Below this a line is flagged in a prompt; marks of a question without any.
PROMPT_FLAG, SHOWN_MARKS = 0.65, 5.0


def wire(rows: DataFrame, kind: str) -> DataFrame:
    """Rows under the names of their wire kind; columns that are not there are null."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(name) for name, c in WIRE[kind].items()])


def shown_stage(stage: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SHOWN_STAGE.items() for x in pair])
    return F.coalesce(F.try_element_at(known, stage), F.lit("rendering-pages"))


def internal_ids(rows: DataFrame, ids: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """``name``: the stored id of the outside id in ``column``, null where there is none.
    ``ids`` has ``by``, ``external_id`` (once) and ``id``."""
    told = ids.select(*by, F.col("external_id").alias(column), F.col("id").alias(name))
    return rows.join(told, [*by, column], "left")


def within(rows: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose parent exists."""
    return rows.join(parents.select(*key).distinct(), key, "left_semi")


def active_users(users: DataFrame, email: str) -> DataFrame:
    return users.filter((F.lower("email") == email.strip().lower()) & F.col("is_active"))


def page_uris(artifacts: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """The image of each artifact's page, null if it has none."""
    return artifacts.join(pages.select(*by, "page_number", "uri"), [*by, "page_number"], "left")


def unanswered_questions(questions: DataFrame, mappings: DataFrame, key: list[str]) -> DataFrame:
    """Questions without a mapping, and those whose mapping says so."""
    answered = mappings.filter("mapping_type <> 'unanswered'").select(*key).distinct()
    return questions.join(answered, key, "left_anti")


def score_options(most: Column) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(most).cast("int")))


def override_scores(rows: DataFrame, overrides: DataFrame, key: list[str]) -> DataFrame:
    """A reviewer's own scores: correct at full marks, incorrect at none, neither between;
    the status becomes human_corrected. Other rows stay as they are."""
    df = rows.join(overrides.select(*key, F.col("score").alias("__new")), key, "left")
    new, most = F.col("__new"), F.coalesce("max_score", F.lit(SHOWN_MARKS))
    correct = F.when(new == most, True).when(new == 0, False)
    return (
        df.withColumn("is_correct", F.when(new.isNotNull(), correct).otherwise(F.col("is_correct")))
        .withColumn("review_status", F.when(new.isNotNull(), "human_corrected").otherwise(F.col("review_status")))
        .withColumn("score", F.coalesce(new, F.col("score")))
        .drop("__new")
    )


def scored_total(score: Column, known: Column) -> Column:
    """Aggregate: the sum of the scores there are; without any, what is known already."""
    return F.coalesce(F.sum(score), F.max(known))


def size_mb(length: Column) -> Column:
    """Aggregate: all files in MB, two places."""
    return half_up(F.sum(length) / (1024.0 * 1024.0), 2)


def group_answered(row_status: Column) -> Column:
    """Aggregate: whether any row of a group is answered."""
    return F.bool_or(row_status == "answered")


def exists(rows: DataFrame, condition: Column) -> DataFrame:
    """One row ``found``; reading stops at the first hit."""
    return rows.filter(condition).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def same_length(asked: Column, reply: Column) -> Column:
    return F.coalesce(F.size(asked) == F.size(reply), F.lit(False))


def upload_problem(title: Column, files: Column) -> Column:
    return F.when(F.coalesce(F.trim(title), F.lit("")) == "", "title").when(F.coalesce(files, F.lit(0)) < 1, "files")


def still_low(flagged: DataFrame, answers: DataFrame, key: list[str], params: Params = DEFAULTS) -> DataFrame:
    """Flagged answers that no repair has lifted."""
    low = answers.filter(F.col("confidence") < params.repaired_confidence).select(*key)
    return flagged.select(*key).distinct().join(low, key, "left_semi")


def numbered_lines(rows: DataFrame, by: list[str], order: str, text: str, confidence: str) -> DataFrame:
    """``lines``: the numbered list of a page for a prompt, unsure lines flagged."""
    flag = F.when(F.coalesce(confidence, F.lit(1.0)) < PROMPT_FLAG, " [LOW CONFIDENCE]").otherwise("")
    sorted_rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"), flag.alias("f"))))
    numbered = F.transform(sorted_rows, lambda x, i: F.concat((i + 1).cast("string"), F.lit('. "'), x["t"], F.lit('"'), x["f"]))
    return rows.groupBy(*by).agg(F.array_join(numbered, "\n").alias("lines"))


def run_states(events: DataFrame, job: str, order: list[str]) -> DataFrame:
    """Jobs' events with the state after each: running with the stage's progress, which never
    falls, succeeded at done, failed from the first error on, after which nothing counts."""
    w = Window.partitionBy(job).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    progress = F.create_map(*[F.lit(x) for pair in STAGE_PROGRESS.items() for x in pair])
    failed = F.max(F.col("error").isNotNull().cast("int")).over(w) == 1
    before = F.coalesce(F.max(F.col("error").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    reached = F.max(F.when(F.col("error").isNull() & ~before, F.try_element_at(progress, "stage"))).over(w)
    state = F.when(failed, "failed").when(reached >= 1.0, "succeeded").when(F.col("stage") == "queued", "queued").otherwise("running")
    return events.withColumn("__before", before).withColumns({"state": state, "progress": F.coalesce(reached, F.lit(0.0))}).filter("not __before").drop("__before")


def accuracy_by_type(truth: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """For each mapping type found: questions, exact matches of the answer, their share, mean
    IoU of the first boxes with the share above 0.7, and the mean character error rate.

    ``truth`` and ``found`` have ``answer_id``, ``bbox`` and ``text``; ``found`` ``mapping_type`` too.
    """
    names = ["answer_id", "bbox", "text"]
    both = truth.select(*key, *[F.col(c).alias(f"t_{c}") for c in names]).join(found.select(*key, "mapping_type", *names), key)
    hit = F.coalesce(F.col("t_answer_id") == F.col("answer_id"), F.col("t_answer_id").isNull() & F.col("answer_id").isNull())
    both = both.withColumns({"hit": hit, "iou": iou(F.col("t_bbox"), F.col("bbox")), "cer": levenshtein_share(F.col("t_text"), F.col("text"))})
    return both.groupBy("mapping_type").agg(
        F.count(F.lit(1)).alias("questions"), F.count_if("hit").alias("hits"), half_up(F.avg(F.col("hit").cast("double")), 4).alias("accuracy"),
        half_up(F.avg("iou"), 4).alias("mean_iou"), half_up(F.avg((F.col("iou") > 0.7).cast("double")), 4).alias("good_iou"), half_up(F.avg("cer"), 4).alias("mean_cer"),
    )
