"""Uploads, keyed tables and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import DEFAULTS, Params


def scoped(rows: DataFrame, organization_id: str, order: list[str] | None = None, **conditions) -> DataFrame:
    """Rows of one organisation that equal every given condition; a condition of None is
    no condition. An absent organisation is an error."""
    if not organization_id:
        raise ValueError("a read needs an organization")
    rows = rows.filter(F.col("organization_id") == organization_id)
    for name, value in conditions.items():
        if value is not None:
            rows = rows.filter(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return rows.orderBy(*order) if order else rows


def get_or_raise(rows: DataFrame, organization_id: str, **conditions) -> DataFrame:
    """The scoped rows; reading them fails where there are none."""
    found = scoped(rows, organization_id, **conditions)
    seen = found.groupBy().agg(F.count(F.lit(1)).alias("__n"))
    check = F.when(F.col("__n") == 0, F.raise_error(F.lit(f"not found: {conditions}"))).otherwise(F.lit(True))
    return found.join(F.broadcast(seen), F.lit(True), "right").filter(check).drop("__n")


def children(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files as ``path, modificationTime, length, content``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def sniff(content: Column) -> Column:
    """Mime type by the first bytes; null for any other."""
    starts = {"application/pdf": "255044462D", "image/png": "89504E470D0A1A0A", "image/jpeg": "FFD8FF"}
    out = F.lit(None).cast("string")
    for mime, head in starts.items():
        out = F.when(F.hex(F.substring(content, 1, len(head) // 2)) == head, mime).otherwise(out)
    return out


def validate_uploads(files: DataFrame, by: list[str], params: Params = DEFAULTS) -> DataFrame:
    """Adds ``mime``, ``checksum`` and ``problem`` (null for a sound file).

    An upload is one PDF or any number of images, each non-empty and within the limits.
    Digests and counts are made first, so that contents are not sorted; they come back
    by ``path`` where the files have one.
    """
    narrow = "path" in files.columns
    df = files.withColumn("mime", sniff(F.col("content"))).withColumn("checksum", F.sha2("content", 256)).withColumn("__size", F.length("content"))
    df = df.drop("content") if narrow else df
    group = Window.partitionBy(*by)
    pdfs = F.count_if(F.col("mime") == "application/pdf").over(group)
    n = F.count(F.lit(1)).over(group)
    size = F.col("__size")
    pages = F.col("page_count") if "page_count" in files.columns else F.lit(None).cast("int")
    problem = (
        F.when(size == 0, "empty")
        .when(size > params.max_upload_bytes, "too large")
        .when(F.col("mime").isNull(), "unsupported type")
        .when((pdfs > 1) | ((pdfs == 1) & (n > 1)), "one PDF or images only")
        .when(pages > params.max_pages, "too many pages")
    )
    out = df.withColumn("problem", problem).drop("__size")
    return out.join(files.select("path", "content"), "path") if narrow else out


def new_documents(batch: DataFrame, existing: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the batch that is not there yet."""
    w = Window.partitionBy(*key).orderBy(*order)
    first = batch.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
    return first.join(existing.select(*key).distinct(), key, "left_anti")


def upsert(existing: DataFrame, changes: DataFrame, key: list[str], deletes: DataFrame | None = None, stamp: Column | None = None) -> DataFrame:
    """Existing rows with changed ones replaced and new ones added; the last change of a
    key (by ``seq``) wins. Rows equal to what is there keep their ``updated_at``."""
    body = [c for c in existing.columns if c not in (*key, "updated_at")]
    w = Window.partitionBy(*key).orderBy(F.desc("seq"))
    last = changes.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1")
    last = last.select(*key, F.struct(*body).alias("__new"))
    old = existing.select(*key, F.struct(*body).alias("__old"), "updated_at")
    if deletes is not None:
        old = old.join(deletes.select(*key).distinct(), key, "left_anti")
    df = old.join(last, key, "full")
    changed = F.col("__new").isNotNull() & ~F.to_json("__new").eqNullSafe(F.to_json("__old"))
    body_now = F.coalesce("__new", "__old")
    now = stamp if stamp is not None else F.current_timestamp()
    return df.select(*key, *[body_now[c].alias(c) for c in body], F.when(changed, now).otherwise(F.col("updated_at")).alias("updated_at")).select(existing.columns)


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that break a uniqueness rule, with how often they occur."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def replace_by_key(rows: DataFrame, path: str, partition: str = "assessment_id") -> None:
    """Replace all rows of the partitions present in ``rows`` and leave others alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def without_orphans(rows: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(parents.select(*key).distinct(), key, "left_semi")


def remove_organizations(rows: DataFrame, organizations: DataFrame) -> DataFrame:
    return rows.join(organizations.select("organization_id").distinct(), "organization_id", "left_anti")


def nest(parents: DataFrame, kids: DataFrame, key: list[str], item: list[str], out: str) -> DataFrame:
    """Parents with their children as an array in the children's own order; none is empty."""
    kind = ", ".join(f"`{c}`: {kids.schema[c].dataType.simpleString()}" for c in item)
    lists = kids.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*item))).alias(out))
    empty = F.array().cast(f"array<struct<{kind}>>")
    return parents.join(lists, key, "left").withColumn(out, F.coalesce(out, empty))


def wire_json(rows: DataFrame, columns: dict[str, str | Column]) -> DataFrame:
    """One JSON text per row under the given names, nulls written out."""
    fields = [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    return rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def write_markdown(documents: DataFrame, path: str) -> None:
    documents.select("document_id", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("document_id").text(path, lineSep="\x00")


def write_ir(blocks: DataFrame, path: str) -> None:
    """One JSON object per document with its blocks in order."""
    fields = [c for c in blocks.columns if c != "document_id"]
    order = F.struct("page_number", "reading_order", *[c for c in fields if c not in ("page_number", "reading_order")])
    blocks.groupBy("document_id").agg(F.array_sort(F.collect_list(order)).alias("blocks")).write.mode("overwrite").json(path)


def read_ir(spark: SparkSession, path: str, block_schema: str) -> DataFrame:
    """Blocks again from write_ir's files; ``block_schema`` lists a block's columns as DDL."""
    docs = spark.read.schema(f"document_id string, blocks array<struct<{block_schema}>>").json(path)
    return docs.select("document_id", F.explode("blocks").alias("b")).select("document_id", "b.*")


def classify_error(status: Column, message: Column) -> Column:
    """quota, unavailable or other, by status code or message."""
    text = F.lower(F.coalesce(message, F.lit("")))
    quota = (status == 429) | text.contains("quota") | text.contains("rate limit") | text.contains("resource_exhausted")
    down = status.isin(404, 503) | text.contains("unavailable") | text.contains("overloaded") | text.contains("not found")
    return F.when(F.coalesce(quota, F.lit(False)), "quota").when(F.coalesce(down, F.lit(False)), "unavailable").otherwise("other")
