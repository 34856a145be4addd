"""Written answers from ordered blocks: noise, segments, scope, continuations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.numbers import half_up
from ..schemas import DEFAULTS, Params
from ..sources.shared import written
from .questions import regions

DISPLAY_LIMIT = 14
CUE_TAIL = 40


def page_spacing(blocks: DataFrame, by: list[str], order: str, params: Params = DEFAULTS) -> DataFrame:
    """Adds ``gap`` to the block above, and per page ``threshold`` and ``spacing``.

    They come from the positive gaps in order: the one at a quarter (times the factor,
    at least the least gap) and the one at half of their number, not interpolated.
    """
    above = Window.partitionBy(*by).orderBy(order)
    df = blocks.withColumn("gap", F.col("y1") - F.lag("y2").over(above))
    gaps = F.array_sort(F.collect_list(F.when(F.col("gap") > 0, F.col("gap"))))
    per_page = df.groupBy(*by).agg(gaps.alias("__gaps"))

    def at(share: int):
        return F.coalesce(F.get("__gaps", F.floor(F.size("__gaps") / share).cast("int")), F.lit(0.0))

    per_page = per_page.withColumn("threshold", F.greatest(F.lit(params.min_gap), at(4) * params.gap_factor)).withColumn("spacing", at(2))
    return df.join(per_page.drop("__gaps"), by).withColumn("gap", F.coalesce("gap", F.lit(0.0)))


def _family(top, sub, subsub, normalized) -> tuple[str, int] | None:
    """Family and ordinal of a label of one part only."""
    if "." in normalized:
        return None
    if top:
        return "top", int(top)
    if sub:
        return "sub", ord(sub) - ord("a")
    value = {"i": 1, "v": 5, "x": 10}
    total = most = 0
    for c in reversed(subsub):
        total += value[c] if value[c] >= most else -value[c]
        most = max(most, value[c])
    return "subsub", total - 1


class _Scope:
    """What one page hands on to the next: the last real label, the last point of a list."""

    def __init__(self) -> None:
        self.real: tuple[str, int] | None = None
        self.point: tuple[str, int] | None = None

    def accept(self, ordinal: tuple[str, int] | None) -> None:
        if ordinal:
            self.real = ordinal
            if ordinal[0] == "top":
                self.point = None

    def suspects(self, ordinal: tuple[str, int] | None, gap: float, threshold: float) -> bool:
        """Whether a label could be a point inside the answer above it."""
        if ordinal is None or self.real is None or gap > threshold:
            return False
        family, value = ordinal
        if family == "top":
            return self.real[0] == "top" and value < self.real[1]
        return value == 0 or self.point == (family, value - 1)


def real_labels(ordinals: list, labelled: list[bool], gaps: list[float], threshold: float, scope: _Scope) -> list[bool]:
    """Which labels of a page start answers; the others are points of a list inside one.

    A suspect is a point if the labels after it (unlabelled blocks between them aside)
    go on counting in its family at line spacing; then all of that run are points.
    """
    places = [i for i, x in enumerate(labelled) if x]
    real = [False] * len(labelled)
    at = 0
    while at < len(places):
        i = places[at]
        ordinal = ordinals[i]
        end = at + 1
        if scope.suspects(ordinal, gaps[i], threshold):
            family, value = ordinal
            while end < len(places) and gaps[places[end]] <= threshold and ordinals[places[end]] == (family, value + end - at):
                end += 1
        if end - at >= 2:
            scope.point = (ordinal[0], ordinal[1] + end - at - 1)
        else:
            real[i] = True
            scope.accept(ordinal)
        at = end
    return real


def _segments(pdf: pd.DataFrame, params: Params) -> pd.DataFrame:
    """Numbers the segments of one document and marks the block that gives each its label."""
    scope = _Scope()
    starts, heads = [], []
    pdf = pdf.sort_values("position")
    for _, page in pdf.groupby("page_number", sort=True):
        rows = page.to_dict("records")
        short = [r["normalized"] is not None and len(r["display"]) <= DISPLAY_LIMIT for r in rows]
        ordinals = [_family(r["top"], r["sub"], r["subsub"], r["normalized"]) if s else None for r, s in zip(rows, short, strict=True)]
        threshold, spacing = rows[0]["threshold"], rows[0]["spacing"]
        real = real_labels(ordinals, short, [r["gap"] for r in rows], threshold, scope)
        labelled = False
        for i, r in enumerate(rows):
            begins = real[i]
            if not short[i] and i:
                shift = abs(r["x1"] - rows[i - 1]["x1"])
                if labelled:
                    begins = r["gap"] > max(threshold, spacing * params.break_factor)
                else:
                    begins = r["gap"] > threshold or (r["gap"] > params.min_gap and shift > params.indent_shift)
            head = begins and r["normalized"] is not None
            labelled = head or (labelled and not begins)
            starts.append(begins or not i)
            heads.append(head)
    out = pdf[["assessment_id", "document_id", "position"]].copy()
    out["segment"] = pd.Series(starts, index=out.index, dtype=bool).cumsum() - 1
    out["head"] = heads
    return out


def extract_answers(blocks: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Answers of every document from blocks with ``position`` and ``assessment_id``.

    Whether a label starts an answer or is a point in one depends on labels before it,
    over pages, and on those after it; that walk runs per document. Everything else
    (noise, labels, spacing, scope, joining, continuations) is relational.
    """
    by = ["assessment_id", "document_id"]
    clean = blocks.filter(~T.is_noise(F.col("text"), F.col("confidence"))).withColumns({n: F.col(f"bbox.{n}") for n in ("x1", "y1", "y2")})
    labelled = T.with_answer_label(clean, "text", "label")
    spaced = page_spacing(labelled, [*by, "page_number"], "position", params)
    fields = ["display", "normalized", "top", "sub", "subsub"]
    narrow = spaced.select(*by, "position", "page_number", "x1", "gap", "threshold", "spacing", *[F.col(f"label.{f}").alias(f) for f in fields])
    kinds = ", ".join(f"{c} {narrow.schema[c].dataType.simpleString()}" for c in [*by, "position"])
    walked = narrow.groupBy(*by).applyInPandas(lambda pdf: _segments(pdf, params), f"{kinds}, segment int, head boolean")

    rows = spaced.join(walked, [*by, "position"])
    # a number in scope qualifies the bare parts after it
    label = F.when(F.col("head"), F.col("label"))
    until = Window.partitionBy(*by).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    scope = F.last(F.when(F.col("head"), F.col("label.top")), ignorenulls=True).over(until)
    qualified = F.when(label["top"].isNull() & label["sub"].isNotNull() & scope.isNotNull(), T.normalize_parts(scope, label["sub"], label["subsub"]))
    rows = rows.withColumn("named", F.when(F.col("head"), F.coalesce(qualified, label["normalized"])))
    text = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda t: t["text"])
    ids = F.transform(F.array_sort(F.collect_list(F.struct("position", "block_id"))), lambda t: t["block_id"])
    key = [*by, "segment"]
    grouped = rows.groupBy(*key).agg(
        F.min("page_number").alias("page"),
        F.min("named").alias("detected_label"),
        F.min(F.when(F.col("head"), F.col("label.display"))).alias("detected_label_display"),
        T.trim_all(F.array_join(text, " ")).alias("raw_text"),
        half_up(F.avg("confidence"), 4).alias("confidence"),
        F.coalesce(F.min_by("extraction_method", F.when(F.col("extraction_method").isNotNull(), F.col("position"))), F.lit("ocr")).alias("extraction_method"),
        ids.alias("block_ids"),
    )
    out = grouped.join(regions(rows, key, params), key).select(
        "assessment_id",
        F.format_string("a-%d-%d", "page", "segment").alias("answer_id"),
        "segment",
        "page",
        "raw_text",
        T.normalize_text(F.col("raw_text")).alias("normalized_text"),
        "detected_label",
        "detected_label_display",
        F.array("page").alias("page_numbers"),
        "regions",
        "confidence",
        "extraction_method",
        "block_ids",
    )
    return continuations(out, params)


def continuations(answers: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Adds ``is_continuation_of`` to unlabelled answers and raises their confidence on a cue.

    On one page the answer before must end in a cue and share the margin; over pages it
    must reach the bottom of the page before and this one start at the top.
    """
    key = "assessment_id"
    on_page = Window.partitionBy(key, "page").orderBy("segment")
    mark = F.struct(
        "answer_id",
        F.substring("raw_text", -CUE_TAIL, CUE_TAIL).rlike(T.CONTINUATION_CUE).alias("cue"),
        F.try_element_at("regions", F.lit(-1))["bbox"].alias("bbox"),
    )
    df = answers.withColumn("__mark", mark).withColumn("__before", F.lag("__mark").over(on_page)).withColumn("__first", F.row_number().over(on_page) == 1)
    last = df.groupBy(key, "page").agg(F.max_by("__mark", "segment").alias("__last"))
    df = df.join(last.withColumn("page", F.col("page") + 1), [key, "page"], "left")
    own = F.get("regions", F.lit(0))["bbox"]
    bare = F.col("detected_label").isNull()
    same = bare & F.col("__before.cue") & (F.abs(own["x1"] - F.col("__before.bbox.x1")) <= params.indent_shift)
    over = bare & F.col("__first") & (F.col("__last.bbox.y2") >= params.page_bottom) & (own["y1"] <= params.page_top)
    raised = half_up(F.least(F.lit(1.0), F.col("confidence") + 0.05), 4)
    return (
        df.withColumn("is_continuation_of", F.when(same, F.col("__before.answer_id")).when(over, F.col("__last.answer_id")))
        .withColumn("confidence", F.when(same | (over & F.col("__last.cue")), raised).otherwise(F.col("confidence")))
        .drop("__mark", "__before", "__first", "__last")
    )


def closure(spark: SparkSession, links: DataFrame, node: str, parent: str, by: str) -> DataFrame:
    """``by, node, root, depth`` of every node under the node it descends from; links to
    unknown parents are roots, and nodes that descend from themselves have no row.

    Pointer doubling over written tables: each round joins the nodes whose root is not yet
    known with the row of the node they point to, so that a chain of any length takes as
    many rounds as the logarithm of its links.
    """
    known = links.select(F.col(by).alias("g"), F.col(node).alias("n"), F.col(parent).alias("p"))
    parents = known.select(F.col("g"), F.col("n").alias("p"), F.lit(True).alias("known"))
    known = written(known.join(parents, ["g", "p"], "left").select("g", "n", F.when(F.col("known"), F.col("p")).alias("p")), "links")
    found = known.filter("p IS NULL").select("g", "n", F.col("n").alias("to"), F.lit(0).alias("depth"), F.lit(True).alias("done"))
    walk = known.filter("p IS NOT NULL").select("g", "n", F.col("p").alias("to"), F.lit(1).alias("depth"), F.lit(False).alias("done"))
    left, reach = walk.count(), 1
    most = left
    while left and reach <= 2 * most:
        at = found.union(walk).select("g", F.col("n").alias("to"), F.col("to").alias("__to"), F.col("depth").alias("__depth"), F.col("done").alias("__done"))
        step = walk.drop("done").join(at, ["g", "to"]).select("g", "n", F.col("__to").alias("to"), (F.col("depth") + F.col("__depth")).alias("depth"), F.col("__done").alias("done"))
        step = written(step, "closure")
        found, walk, reach = found.union(step.filter("done")), step.filter("NOT done"), 2 * reach
        left = walk.count()
    return found.select(F.col("g").alias(by), F.col("n").alias(node), F.col("to").alias("root"), "depth")


def merge_continuations(answers: DataFrame) -> DataFrame:
    """Answers with all that descends from them folded in: text and blocks in order,
    regions of all, the least confidence."""
    tree = closure(answers.sparkSession, answers, "answer_id", "is_continuation_of", "assessment_id")
    rows = answers.join(tree, ["assessment_id", "answer_id"])
    part = F.struct("depth", "segment", "raw_text", "regions", "block_ids")
    grouped = rows.groupBy("assessment_id", F.col("root").alias("answer_id")).agg(
        F.array_sort(F.collect_list(part)).alias("parts"), F.min("confidence").alias("__least")
    )
    raw = T.trim_all(F.array_join(F.transform("parts", lambda p: p["raw_text"]), " "))
    all_regions = F.flatten(F.transform("parts", lambda p: p["regions"]))
    merged = answers.join(grouped, ["assessment_id", "answer_id"]).withColumn("raw_text", raw)
    return (
        merged.withColumn("normalized_text", F.when(F.size("parts") > 1, T.normalize_text(F.col("raw_text"))).otherwise(F.col("normalized_text")))
        .withColumn("regions", all_regions)
        .withColumn("page_numbers", F.array_sort(F.array_distinct(F.transform("regions", lambda r: r["page"]))))
        .withColumn("block_ids", F.flatten(F.transform("parts", lambda p: p["block_ids"])))
        .withColumn("confidence", half_up(F.col("__least"), 4))
        .drop("parts", "__least")
    )


def apply_corrections(answers: DataFrame, corrections: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Repaired transcriptions by answer id: text replaced, confidence at least the
    repaired one, a label only ever gained."""
    key = ["assessment_id", "answer_id"]
    new = corrections.select(*key, F.col("text").alias("__new"))
    df = T.with_answer_label(answers.join(new, key, "left").withColumn("__text", F.coalesce("__new", F.lit(""))), "__text", "__label")
    fixed = F.col("__new").isNotNull() & (T.trim_all(F.col("__new")) != "")
    return (
        df.withColumn("raw_text", F.when(fixed, F.col("__new")).otherwise(F.col("raw_text")))
        .withColumn("normalized_text", F.when(fixed, T.normalize_text(F.col("__new"))).otherwise(F.col("normalized_text")))
        .withColumn("confidence", F.when(fixed, F.greatest("confidence", F.lit(params.repaired_confidence))).otherwise(F.col("confidence")))
        .withColumn("detected_label", F.coalesce("detected_label", F.when(fixed, F.col("__label.normalized"))))
        .drop("__new", "__text", "__label")
    )


def low_confidence(answers: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    return answers.filter(F.col("confidence") < params.answer_confidence).select("assessment_id", "answer_id")
