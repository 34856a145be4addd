"""Schemas, enumerations and parameters of the assessment engine. Schemas are never inferred."""

from __future__ import annotations

from dataclasses import dataclass

BBOX = "struct<x1:double,y1:double,x2:double,y2:double>"
REGIONS = f"array<struct<page:int,bbox:{BBOX}>>"

WORDS = "document_id string, page_number int, page_width double, page_height double, text string, x1 double, y1 double, x2 double, y2 double, line_index int"
TEXT_ITEMS = "document_id string, page_number int, item int, text string, width double, tx array<double>, has_eol boolean"
OCR_LINES = "document_id string, page_number int, line_no int, text string, bbox array<double>, confidence double, script string"
EXAM_PAGES = "document_id string, page_number int, width double, height double, dpi int, classification string, extraction_method string"
BLOCKS = (
    "document_id string, kind string, page_number int, block_id string, text string, "
    f"bbox {BBOX}, confidence double, block_type string, reading_order int, low_confidence boolean, script string, script_score double"
)
QUESTIONS = (
    "assessment_id string, question_id string, display_number string, normalized_number string, parent_number string, text string, "
    f"pages array<int>, regions {REGIONS}, order_index int, optional boolean, max_marks double, confidence double, block_ids array<string>"
)
ANSWERS = (
    "assessment_id string, answer_id string, raw_text string, normalized_text string, detected_label string, detected_label_display string, "
    f"page_numbers array<int>, regions {REGIONS}, confidence double, extraction_method string, is_continuation_of string, block_ids array<string>"
)
RUBRICS = "assessment_id string, question_id string, criteria array<struct<name:string,weight:double,keywords:array<string>,max_marks:double>>"
VERDICTS = "assessment_id string, question_id string, answer_id string, reason string"
LLM_GRADES = "assessment_id string, question_id string, score double, feedback string, breakdown array<struct<name:string,awarded:double,max_marks:double,rationale:string>>"
PROPOSALS = "document_id string, display_number string, block_ids array<string>"
CORRECTIONS = "assessment_id string, answer_id string, text string"
JOB_EVENTS = "job_id string, assessment_id string, stage string, status string, progress double, error string, at timestamp"

#: Enumerations.
MAPPING_TYPES = ["direct", "semantic", "spatial", "unmatched", "unanswered"]
REVIEW_STATUSES = ["auto_accepted", "needs_review", "human_confirmed", "human_corrected"]
GRADE_METHODS = ["deterministic", "llm", "skipped", "provisional"]
JOB_STATUSES = ["queued", "running", "succeeded", "failed"]
HELD_METHODS = ["skipped", "provisional"]
#: Progress at the end of each stage of a run.
STAGE_PROGRESS = {"questions": 0.2, "answers": 0.5, "mapping": 0.75, "grading": 0.9, "done": 1.0}


@dataclass(frozen=True)
class Params:
    """Weights, thresholds and switches; the defaults are fixed values."""

    use_labels: bool = True
    use_spatial: bool = True
    use_semantic: bool = True
    weight_label: float = 0.55
    weight_spatial: float = 0.20
    weight_semantic: float = 0.25
    label_exact: float = 1.0
    label_parent: float = 0.55
    weak_signal: float = 0.05
    exact_confidence: float = 0.97
    unlabelled_factor: float = 0.85
    combined_cap: float = 0.99
    accept: float = 0.70
    review: float = 0.45
    ambiguous_margin: float = 0.10
    verdict_boost: float = 0.12
    verdict_cap: float = 0.98
    overlap_weight: float = 0.7
    fuzzy_weight: float = 0.3
    gap_factor: float = 2.5
    min_gap: float = 0.012
    indent_shift: float = 0.08
    break_factor: float = 2.0
    page_bottom: float = 0.88
    page_top: float = 0.18
    column_gap: float = 0.06
    column_min_boxes: int = 6
    block_confidence: float = 0.60
    question_confidence: float = 0.70
    answer_confidence: float = 0.65
    repaired_confidence: float = 0.90
    proposed_confidence: float = 0.75
    searchable_coverage: float = 0.02
    min_area: float = 1e-6
    fallback_multiplier: float = 1.5
    default_marks: float = 1.0
    max_upload_bytes: int = 50 * 1024 * 1024
    max_pages: int = 200
    render_dpi: int = 200
    render_long_edge: int = 2000
    calls_per_minute: int = 15
    quota_cooldown_s: int = 900
    unavailable_cooldown_s: int = 3600

    @classmethod
    def from_conf(cls, spark, prefix: str = "quillstone.") -> Params:
        """Defaults overridden by ``prefix + name`` settings; a value that does not parse keeps the default."""
        found = {}
        for name, field in cls.__dataclass_fields__.items():
            if (raw := spark.conf.get(prefix + name, None)) is None:
                continue
            kind = type(field.default)
            try:
                found[name] = raw.strip().lower() == "true" if kind is bool else kind(float(raw))
            except ValueError:
                continue
        return cls(**found)


DEFAULTS = Params()
