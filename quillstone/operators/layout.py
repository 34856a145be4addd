"""From recognised words to ordered blocks: lines, page classes, columns, reading order, markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions.numbers import half_up
from ..functions.text import trim_all
from ..schemas import DEFAULTS, Params

PAGE = ["document_id", "page_number"]


def render_size(width: Column, height: Column, params: Params = DEFAULTS) -> Column:
    """Zoom and dpi of a page whose longer edge is kept within the limit, and its size in pixels."""
    wanted = F.lit(params.render_dpi / 72.0)
    longest = F.greatest(width, height) * wanted
    zoom = F.when(longest > params.render_long_edge, wanted * params.render_long_edge / longest).otherwise(wanted)
    return F.struct(zoom.alias("zoom"), half_up(zoom * 72.0).cast("int").alias("dpi"), (width * zoom).alias("width"), (height * zoom).alias("height"))


def native_words(items: DataFrame) -> DataFrame:
    """Text items with their composed transform ``tx`` to words: boxes from font height
    (0.8 above and 0.25 below the base line), line numbers from ends of line before."""
    before = Window.partitionBy(*PAGE).orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    tx = F.col("tx")
    height = F.hypot(tx[2], tx[3])
    stretch = F.hypot(tx[0], tx[1])
    width = F.col("width") * F.when(stretch == 0, 1.0).otherwise(stretch)
    return (
        items.withColumn("line_index", F.coalesce(F.sum(F.col("has_eol").cast("int")).over(before), F.lit(0)).cast("int"))
        .filter(trim_all(F.col("text")) != "")
        .select(
            *PAGE, "item", "text", tx[4].alias("x1"), (tx[5] - 0.8 * height).alias("y1"),
            (tx[4] + width).alias("x2"), (tx[5] + 0.25 * height).alias("y2"), "line_index",
        )
    )


def classify_pages(pages: DataFrame, words: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``classification``: searchable where words cover more than the limit of the page."""
    covered = F.greatest(F.lit(0.0), F.col("x2") - F.col("x1")) * F.greatest(F.lit(0.0), F.col("y2") - F.col("y1"))
    area = words.groupBy(*PAGE).agg(F.sum(covered).alias("__covered"))
    share = F.coalesce(F.col("__covered"), F.lit(0.0)) / F.nullif(F.col("width") * F.col("height"), F.lit(0.0))
    out = pages.join(area, PAGE, "left")
    return out.withColumn("classification", F.when(share > params.searchable_coverage, "searchable").otherwise("scanned")).drop("__covered")


def document_class(pages: DataFrame) -> DataFrame:
    """One class where all pages agree, else ``mixed``."""
    kinds = F.collect_set("classification")
    return pages.groupBy("document_id").agg(F.when(F.size(kinds) == 1, kinds[0]).otherwise("mixed").alias("classification"))


def words_to_lines(words: DataFrame) -> DataFrame:
    """Words of one line index joined left to right, with the box around them."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x1", "text"))), lambda w: w["text"]), " ")
    lines = words.groupBy(*PAGE, "line_index").agg(
        text.alias("text"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")
    )
    return lines.withColumn("text", trim_all(F.col("text"))).filter("text <> ''")


def blocks_from_lines(lines: DataFrame, pages: DataFrame, method: str, params: Params = DEFAULTS) -> DataFrame:
    """Blocks with page-fraction boxes; unsound boxes go, and a page left without lines
    gets one empty block over the whole page with confidence 0.

    ``lines`` has ``line_no``, page-unit corners, ``confidence`` and ``script``.
    """
    sizes = pages.select(*PAGE, "width", "height")
    bbox = G.normalize(*[F.col(n) for n in G.SIDES], F.col("width"), F.col("height"), params)
    found = lines.join(sizes, PAGE).withColumn("bbox", bbox).filter("bbox is not null")
    found = found.select(*PAGE, "line_no", "text", "bbox", "confidence", "script")
    full = G.box(*map(F.lit, (0.0, 0.0, 1.0, 1.0)))
    empty = sizes.join(found.select(*PAGE).distinct(), PAGE, "left_anti").select(
        *PAGE, F.lit(0).alias("line_no"), F.lit("").alias("text"), full.alias("bbox"), F.lit(0.0).alias("confidence"), F.lit("unknown").alias("script")
    )
    rows = found.unionByName(empty)
    return rows.select(
        *PAGE,
        F.format_string("p%d-b%d", "page_number", "line_no").alias("block_id"),
        "text",
        "bbox",
        "confidence",
        F.lit("line").alias("block_type"),
        (F.col("confidence") < params.block_confidence).alias("low_confidence"),
        "script",
        G.script_score(F.col("script")).alias("script_score"),
        F.lit(method).alias("extraction_method"),
    )


def columns(boxes: DataFrame, by: list[str], params: Params = DEFAULTS) -> DataFrame:
    """Runs of boxes whose x-spans touch within the column gap: ``column, left, right, n``.

    Groups with fewer boxes than the minimum, or in one run, are one column.
    """
    order = Window.partitionBy(*by).orderBy("x1", "x2")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.max("x2").over(before).isNull() | (F.col("x1") > F.max("x2").over(before) + params.column_gap)
    enough = F.count(F.lit(1)).over(Window.partitionBy(*by)) >= params.column_min_boxes
    start = F.when(enough & fresh, 1).otherwise(0)
    runs = boxes.withColumn("__start", start).withColumn("column", F.sum("__start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "column").agg(F.min("x1").alias("left"), F.max("x2").alias("right"), F.count(F.lit(1)).alias("n"))


def reading_order(blocks: DataFrame, by: list[str] | None = None, position: str = "block_id", params: Params = DEFAULTS) -> DataFrame:
    """Adds ``reading_order`` from 0 by column, then top to 3 places, left edge and input place.

    Columns hold at least max(2, a tenth of the boxes), else the page is one column. A
    box belongs to the column that holds its middle, or to the nearest.
    """
    by = by or PAGE
    flat = blocks.withColumns({n: F.col(f"bbox.{n}") for n in G.SIDES}) if "bbox" in blocks.columns else blocks
    spans = columns(flat, by, params)
    total = Window.partitionBy(*by)
    least = F.greatest(F.lit(2), F.floor(F.sum("n").over(total) / 10))
    spans = spans.withColumn("ok", (F.count(F.lit(1)).over(total) >= 2) & (F.min("n").over(total) >= least))
    ranges = spans.groupBy(*by).agg(
        F.first("ok").alias("__ok"), F.array_sort(F.collect_list(F.struct("left", "right"))).alias("__ranges")
    )
    middle = (F.col("x1") + F.col("x2")) / 2
    away = F.transform("__ranges", lambda r, i: F.struct(F.greatest(r["left"] - middle, middle - r["right"], F.lit(0.0)).alias("d"), i.alias("i")))
    joined = flat.join(ranges, by).withColumn("__column", F.when(F.col("__ok"), F.array_min(away)["i"]).otherwise(0))
    order = Window.partitionBy(*by).orderBy("__column", half_up(F.col("y1"), 3), "x1", position)
    out = joined.withColumn("reading_order", (F.row_number().over(order) - 1).cast("int"))
    return out.select(*[c for c in blocks.columns if c != "reading_order"], "reading_order")


def ordered_blocks(blocks: DataFrame) -> DataFrame:
    """Adds ``position`` from 0 in document order."""
    order = Window.partitionBy("document_id").orderBy("page_number", "reading_order")
    return blocks.withColumn("position", (F.row_number().over(order) - 1).cast("int"))


def markdown(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """A readable rendering of each document: a heading and a comment per page, a line per block."""
    line = F.concat("text", F.when(F.col("low_confidence"), " <!-- low-confidence -->").otherwise(""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", line.alias("line")))), lambda b: b["line"]), "\n")
    per_page = pages.join(blocks.groupBy(*PAGE).agg(body.alias("body")), PAGE, "left")
    head = F.concat(
        F.format_string("## Page %d\n", "page_number"),
        F.concat(F.lit("<!-- extraction_method="), "extraction_method", F.lit(" classification="), "classification", F.lit(" size=")),
        F.concat(half_up(F.col("width")).cast("long").cast("string"), F.lit("x"), half_up(F.col("height")).cast("long").cast("string"), F.lit(" -->\n\n")),
    )
    text = F.concat(head, F.when(F.col("body").isNotNull(), F.concat("body", F.lit("\n"))).otherwise(""))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_number", text.alias("t")))), lambda p: p["t"])
    whole = F.concat(F.lit("# Document "), "document_id", F.lit("\n\n"), F.array_join(F.col("parts"), "\n"))
    return per_page.groupBy("document_id").agg(parts.alias("parts")).select(
        "document_id", F.concat(F.regexp_replace(whole, r"\s+$", ""), F.lit("\n")).alias("markdown")
    )
