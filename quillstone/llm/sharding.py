"""Proportional stratified interleaving of documents into shards (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, prefix_counts, zlib_crc32

#: Ranges of the shuffle key within a source, and of the fractional rank over all
#: sources. A range holds n / RANGES rows, which is what one task sorts at a time.
RANGES = 1024
MAX_RANGES = 65536


def stratified_shards(
    docs: DataFrame,
    shards: int = 8,
    seed: str = "shards-1",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Deal rows into ``shards`` whose sizes in rows differ by at most one and whose
    mixture of sources matches the whole table's.

    Rows are shuffled within their source by a seeded digest, get the fractional rank
    (2 r - 1) / 2 n there, and are sorted by it over all sources; ``shards`` contiguous
    cuts follow. A cut of any length holds each source in proportion, to within a row
    or so. Ranks come from counts per key range plus a row number inside a range, so
    that a source with a third of the rows is sorted by many tasks.

    Returns: the id, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``law`` ('rows'),
    ``shard``, ``slot`` (gapless from 0), ``grown_shard`` (null under this law).
    A null text counts as empty; a null source is a source of its own; null and
    repeated ids are rows like others (equal rows are interchangeable); fewer rows
    than shards leave the last shards empty; an empty table gives no rows. Columns
    besides the three named are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = scratch.write(
        docs.select(
            F.col(id_col).alias("id"),
            (F.length(data) + 1).cast("long").alias("size"),
            zlib_crc32(data).alias("crc"),
            F.when(F.col(source_col).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(source_col).cast("string"))).alias("src"),
            F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("-"))).cast("binary")).alias("h"),
        ),
        "rows",
    )
    n = rows.count()
    ranges = min(MAX_RANGES, max(RANGES, n // 100_000))
    rows = rows.withColumn("rng", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * ranges / F.lit(2**32)))

    before = prefix_counts(rows, ["src"], "rng", "before")
    per_source = rows.groupBy("src").agg(F.count(F.lit(1)).alias("n_src"))
    inside = Window.partitionBy("src", "rng").orderBy("h", "id", "size", "crc")
    ranked = (
        rows.withColumn("rn", F.row_number().over(inside))
        .join(before.join(per_source, "src"), ["src", "rng"])
        .withColumn("frac", (2 * (F.col("before") + F.col("rn")) - 1) / (2.0 * F.col("n_src")))
        .select("id", "size", "crc", "src", "h", "frac", F.floor(F.col("frac") * ranges).alias("cut"))
    )
    ranked = scratch.write(ranked, "ranked")

    # at most MAX_RANGES rows, so one task may sum them and every executor hold them
    offsets = F.broadcast(prefix_counts(ranked, [], "cut", "before"))
    here = Window.partitionBy("cut").orderBy("frac", "src", "h", "id", "size", "crc")
    pos = F.col("before") + F.col("rn") - 1
    low, extra = n // shards, n % shards
    head = extra * (low + 1)
    placed = ranked.withColumn("rn", F.row_number().over(here)).join(offsets, "cut").withColumn("pos", pos)
    tail = F.col("pos") - head
    in_head = F.col("pos") < head
    return placed.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.when(in_head, F.floor(F.col("pos") / (low + 1))).otherwise(extra + F.floor(tail / max(low, 1))).cast("int").alias("shard"),
        F.when(in_head, F.col("pos") % (low + 1)).otherwise(tail % max(low, 1)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
