"""Exam-shaped inputs made from the driver's tables, so that whole runs can be queried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..sources import shared
from ..streaming import jobs
from . import assessment

PER_PAGE = 12


def blocks(conversations: DataFrame) -> DataFrame:
    """Each conversation as an assessment: its user turns make the question paper and its
    assistant turns the answer sheet.

    A user turn is a numbered question (its lines are blocks), an assistant turn the
    answer under the same number; every third answer drops its number, so that place
    and wording must find its question.
    """
    turns = conversations.filter(F.col("role").isin("user", "assistant"))
    place = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    paper = F.col("role") == "user"
    turns = turns.select("conv_id", "turn", "text", place.alias("number"), F.when(paper, "question_paper").otherwise("answer_sheet").alias("kind"))
    lines = turns.select("*", F.posexplode(F.split("text", "\n", -1)).alias("line", "line_text"))
    named = (F.col("line") == 0) & ((F.col("kind") == "question_paper") | (F.col("number") % 3 != 0))
    marks = F.when((F.col("kind") == "question_paper") & (F.col("line") == 0), F.format_string(" (%d marks)", F.col("number") % 5 + 1)).otherwise("")
    text = F.concat(F.when(named, F.concat(F.col("number").cast("string"), F.lit(". "))).otherwise(""), "line_text", marks)
    order = Window.partitionBy("conv_id", "kind").orderBy("turn", "line")
    rows = lines.withColumn("text", text).withColumn("position", F.row_number().over(order) - 1)
    slot = F.col("position") % PER_PAGE
    top = 0.05 + slot * 0.075
    height = F.when(F.col("line") == 0, 0.04).otherwise(0.07)
    return rows.select(
        F.col("conv_id").cast("string").alias("assessment_id"),
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), "kind").alias("document_id"),
        "kind",
        (F.floor(F.col("position") / PER_PAGE) + 1).cast("int").alias("page_number"),
        F.format_string("b%d", "position").alias("block_id"),
        "text",
        G.box(F.lit(0.1), top, F.lit(0.9), top + height).alias("bbox"),
        F.lit(0.9).alias("confidence"),
        slot.cast("int").alias("reading_order"),
        F.lit("native").alias("extraction_method"),
        F.col("position").cast("int").alias("position"),
    )


def run(conversations: DataFrame) -> assessment.Run:
    return assessment.process(blocks(conversations))


def deduplicated_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Events read as a file stream, doubled, and written once by id."""
    out = shared.scratch_path(spark, "stream")
    spark.read.parquet(path).write.parquet(f"{out}/incoming")
    stream = spark.readStream.schema(schema).parquet(f"{out}/incoming")
    twice = stream.union(stream).withColumn("ts", F.col("ts").cast("timestamp"))
    first = jobs.first_uploads(twice, ["event_id"], "ts", "60 days").select("event_id", "user_id")
    query = first.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows")
