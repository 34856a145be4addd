"""Whole runs: blocks to questions and answers, mapping, grades, results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import grading, layout, mapping, review
from ..operators import questions as Q
from ..schemas import DEFAULTS, Params
from ..sources.shared import written


@dataclass(frozen=True)
class Run:
    """Tables of one run over any number of assessments."""

    questions: DataFrame
    ambiguities: DataFrame
    answers: DataFrame
    mappings: DataFrame
    grades: DataFrame
    summary: DataFrame

    def review(self) -> DataFrame:
        return review.review_rows(self.mappings, self.questions, self.answers, self.grades)

    def results(self) -> DataFrame:
        counts = review.result_counts(self.mappings, ["assessment_id"])
        return counts.join(self.summary, "assessment_id", "left")


def ingest(lines: DataFrame, pages: DataFrame, method: str, params: Params = DEFAULTS) -> DataFrame:
    """Ordered blocks of documents from their lines; the one exchange is by page."""
    blocks = layout.blocks_from_lines(lines, pages, method, params)
    return layout.ordered_blocks(layout.reading_order(blocks, params=params))


def process(
    blocks: DataFrame,
    params: Params = DEFAULTS,
    rubrics: DataFrame | None = None,
    verdicts: DataFrame | None = None,
    llm_grades: DataFrame | None = None,
    corrections: DataFrame | None = None,
) -> Run:
    """Extract, map and grade. ``blocks`` has ``assessment_id``, ``kind`` (question_paper
    or answer_sheet) and ``position``; replies of models are optional tables."""
    questions = written(Q.extract_questions(blocks.filter(F.col("kind") == "question_paper"), params), "questions")
    found = written(A.extract_answers(blocks.filter(F.col("kind") == "answer_sheet"), params), "answers")
    if corrections is not None:
        found = A.apply_corrections(found, corrections, params)
    return map_and_grade(questions, found, params, rubrics, verdicts, llm_grades)


def map_and_grade(
    questions: DataFrame,
    found: DataFrame,
    params: Params = DEFAULTS,
    rubrics: DataFrame | None = None,
    verdicts: DataFrame | None = None,
    llm_grades: DataFrame | None = None,
) -> Run:
    """The part of a run after extraction; also a remap, which drops earlier corrections.

    ``questions`` and ``found`` should be stored tables, as each is read several times.
    """
    whole = written(A.merge_continuations(found), "whole-answers")
    mappings = written(mapping.map_answers(questions, whole, params, verdicts), "mappings")
    grades = written(grading.grade(mappings, questions, whole, rubrics, llm_grades, params), "grades")
    summary = grading.summarise(grades, ["assessment_id"])
    return Run(questions, Q.ambiguities(questions, params), whole, mappings, grades, summary)
