"""Numbered questions from ordered blocks: labels, bodies, hierarchy, ambiguities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import text as T
from ..functions.numbers import half_up
from ..schemas import DEFAULTS, Params

DISPLAY_LIMIT = 12


def regions(blocks: DataFrame, by: list[str], params: Params = DEFAULTS) -> DataFrame:
    """One region per page for each key: the box around its blocks, pages in order."""
    pages = blocks.groupBy(*by, F.col("page_number").alias("page")).agg(G.union_agg(F.col("bbox")).alias("bbox"))
    return pages.filter(G.is_valid(F.col("bbox"), params)).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("page", "bbox"))).alias("regions"))


def body_spans(blocks: DataFrame, by: list[str], is_head: Column, order: list[str]) -> DataFrame:
    """Adds ``span``: how many heads there are up to each row; 0 is the preamble."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("span", F.sum(F.when(is_head, 1).otherwise(0)).over(w))


def labelled_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks`` (with position) and their label where its display is short enough for a head."""
    df = T.with_label(blocks, "text", "label")
    short = F.length("label.display") <= DISPLAY_LIMIT
    return df.withColumn("label", F.when(short, F.col("label")))


def extract_questions(blocks: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Questions of every document from blocks with ``position`` and ``assessment_id``.

    A head is a block that starts with a short label; its body runs to the next head.
    Marks printed alone in a column set the marks and leave the body, section headings
    leave it too. Numbers get their stems and duplicate suffixes (see hierarchy).
    """
    by = ["assessment_id", "document_id"]
    spans = body_spans(labelled_blocks(blocks), by, F.col("label").isNotNull(), ["position"]).filter("span > 0")
    head = F.col("label").isNotNull()
    marks_alone = F.regexp_extract("text", T.spaced(T.MARKS_ONLY), 1)
    furniture = ~head & ((marks_alone != "") | F.col("text").rlike(T.spaced(T.SECTION_HEADER)))
    spans = spans.withColumn("column_marks", F.when(~head & (marks_alone != ""), marks_alone.cast("double"))).withColumn("content", ~furniture)
    part = F.when(head, F.col("label.remainder")).otherwise(F.col("text"))
    kept = F.col("content")
    grouped = spans.groupBy(*by, "span").agg(
        F.min(F.when(head, F.col("label"))).alias("label"),
        F.array_sort(F.collect_list(F.when(kept & (part != ""), F.struct("position", part.alias("t"))))).alias("parts"),
        F.array_sort(F.collect_list(F.when(kept, F.struct("position", "block_id")))).alias("ids"),
        F.array_sort(F.collect_set(F.when(kept, F.col("page_number")))).alias("pages"),
        F.max_by("column_marks", F.when(F.col("column_marks").isNotNull(), F.col("position"))).alias("column_marks"),
        F.avg(F.when(kept, F.col("confidence"))).alias("confidence"),
    )
    text = T.trim_all(F.array_join(F.transform("parts", lambda p: p["t"]), " "))
    rows = grouped.join(regions(spans.filter(kept), [*by, "span"], params), [*by, "span"], "left").withColumn("text", text)
    rows = rows.select(
        *by,
        T.tidy_display(F.col("label.display")).alias("display_number"),
        F.col("label.normalized").alias("label"),
        "text",
        "pages",
        F.coalesce("regions", F.array().cast(f"array<struct<page:int,bbox:{_BBOX}>>")).alias("regions"),
        (F.col("span") - 1).cast("int").alias("order_index"),
        T.is_optional(F.col("text")).alias("optional"),
        F.coalesce(T.detect_marks(F.col("text")), F.col("column_marks")).alias("max_marks"),
        half_up(F.least(F.lit(1.0), F.coalesce("confidence", F.lit(1.0))), 4).alias("confidence"),
        F.transform("ids", lambda i: i["block_id"]).alias("block_ids"),
    )
    numbered = hierarchy(rows, by, "label", "order_index")
    return rows.join(numbered, [*by, "order_index"]).select(
        "assessment_id",
        F.concat(F.lit("q-"), "normalized_number").alias("question_id"),
        "display_number",
        "normalized_number",
        "parent_number",
        *("text", "pages", "regions", "order_index", "optional", "max_marks", "confidence", "block_ids"),
    )


_BBOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def stem_numbers(labels: list[str]) -> list[str]:
    """Labels of one paper, in order, with the stems they stand under.

    A number opens a new scope, and its letter (if any) the scope's sub-part. Any other
    label stands under the number in scope: a roman under the sub-part if there is one,
    anything else directly, becoming the sub-part itself. Without a number in scope
    labels stay as they are. A number used before gets .2, .3 and so on.
    """
    top = sub = None
    used: set[str] = set()
    out = []
    for label in labels:
        parts = label.split(".")
        if parts[0].isdigit():
            top, sub = parts[0], parts[1] if len(parts) > 1 else None
            number = label
        elif top is None:
            number = label
        elif sub is not None and all(c in "ivx" for c in parts[0]):
            number = ".".join([top, sub, *parts])
        else:
            number = ".".join([top, *parts])
            sub = parts[0]
        again, base = 2, number
        while number in used:
            number = f"{base}.{again}"
            again += 1
        used.add(number)
        out.append(number)
    return out


def hierarchy(rows: DataFrame, by: list[str], label: str, order: str) -> DataFrame:
    """``normalized_number`` and ``parent_number`` per row of each paper.

    The sub-part in scope depends on numbers given before, which no window can say, so
    each paper (some hundred labels) is walked in one group.
    """
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*by, order])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        numbers = stem_numbers(pdf[label].tolist())
        parents = [n.rpartition(".")[0] or None for n in numbers]
        return pdf[[*by, order]].assign(normalized_number=numbers, parent_number=parents)

    return rows.select(*by, order, label).groupBy(*by).applyInPandas(walk, f"{kinds}, normalized_number string, parent_number string")


def deduplicate_numbers(rows: DataFrame, by: list[str], number: str, order: str) -> DataFrame:
    """Second and later rows of one number get .2, .3 and so on."""
    n = F.row_number().over(Window.partitionBy(*by, number).orderBy(order))
    return rows.withColumn(number, F.when(n > 1, F.concat(F.col(number), F.lit("."), n.cast("string"))).otherwise(F.col(number)))


def preamble(blocks: DataFrame) -> DataFrame:
    """Block ids before the first head; all blocks of a document without any."""
    spans = body_spans(labelled_blocks(blocks), ["document_id"], F.col("label").isNotNull(), ["position"])
    return spans.filter("span = 0").select("document_id", "block_id", "position")


def ambiguities(questions: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Issues of each paper in order: falling numbers, gaps between numbers, empty bodies
    of questions without parts, low confidence."""
    key = "assessment_id"
    tops = questions.withColumn("top", T.top_int(F.col("normalized_number"))).filter("top is not null")
    by_order = Window.partitionBy(key).orderBy("order_index")
    falls = tops.withColumn("falls", F.col("top") < F.lag("top").over(by_order)).groupBy(key).agg(F.bool_or("falls").alias("falls"))
    falls = falls.filter("falls").select(key, F.lit(0).alias("part"), F.lit(0).alias("at"), F.lit("non_monotonic_numbering").alias("issue"))
    by_top = Window.partitionBy(key).orderBy("top")
    gaps = tops.select(key, "top").distinct().withColumn("before", F.lag("top").over(by_top)).filter("top - before > 1")
    gaps = gaps.select(key, F.lit(1).alias("part"), F.col("before").alias("at"), F.format_string("gap_between_%d_and_%d", "before", "top").alias("issue"))
    stems = F.expr("transform(sequence(1, size(parts) - 1), i -> array_join(slice(parts, 1, i), '.'))")
    ancestors = questions.withColumn("parts", F.split("normalized_number", r"\.")).filter("size(parts) > 1")
    ancestors = ancestors.select(key, F.explode(stems).alias("normalized_number")).distinct().withColumn("has_parts", F.lit(True))
    rows = questions.join(ancestors, [key, "normalized_number"], "left")
    empty = rows.filter((T.trim_all(F.col("text")) == "") & F.col("has_parts").isNull())
    empty = empty.select(key, F.lit(2).alias("part"), (2 * F.col("order_index")).alias("at"), F.concat(F.lit("empty_body:"), "normalized_number").alias("issue"))
    low = questions.filter(F.col("confidence") < params.question_confidence)
    low = low.select(key, F.lit(2).alias("part"), (2 * F.col("order_index") + 1).alias("at"), F.concat(F.lit("low_confidence:"), "normalized_number").alias("issue"))
    every = falls.union(gaps).union(empty).union(low)
    return every.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "at", "issue"))), lambda x: x["issue"]).alias("ambiguities"))


def apply_proposals(blocks: DataFrame, proposals: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Questions from proposed block groups: unknown blocks are left out, and groups without any."""
    ids = proposals.select("document_id", "display_number", F.posexplode("block_ids").alias("at", "block_id"))
    found = ids.join(blocks, ["document_id", "block_id"])
    text = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda t: t["text"])
    by = ["document_id", "display_number"]
    grouped = found.groupBy(*by).agg(
        T.trim_all(F.array_join(text, " ")).alias("text"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", "block_id"))), lambda t: t["block_id"]).alias("block_ids"),
    )
    out = grouped.join(regions(found, by, params), by, "left")
    return T.with_label(out, "display_number", "label").select(
        *by, F.col("label.normalized").alias("normalized_number"), "text", "regions", "block_ids",
        T.detect_marks(F.col("text")).alias("max_marks"), T.is_optional(F.col("text")).alias("optional"),
        F.lit(params.proposed_confidence).alias("confidence"),
    )


def limit_blocks(blocks: DataFrame, most: int = 120) -> DataFrame:
    """The first blocks of each document, for a model's prompt."""
    w = Window.partitionBy("document_id").orderBy("page_number", "reading_order")
    return blocks.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")
