"""Content-addressed web archive: payload bytes once by digest, record headers apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, utf8

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four groups of 40 bits give 8 digits each."""
    digest = F.sha1(data)
    digits = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page/"), F.coalesce(page_id.cast("string"), F.lit("-"))).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")


def _field(name: str) -> Column:
    """A header's value, null where the header block lacks the line."""
    return F.nullif(F.regexp_extract("header", rf"(?md)^{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def write_archive(
    pages: DataFrame,
    scratch: Scratch,
    min_bytes: int = 0,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
) -> None:
    """Write one WARC/1.1 record per row as two tables under ``scratch``.

    ``payloads`` holds each distinct payload once under its SHA-256; ``headers`` holds
    every record's exact header block and the digest of its payload. Among equal
    payloads of at least ``min_bytes`` bytes, rows with the largest id are responses
    and the others revisit them; smaller payloads are all responses. Rows equal in id
    and payload are the same record, so that repeats of the largest id are all
    responses. A null payload is empty; a null url has no target line; a null id sorts
    below all others. Line breaks in a url are escaped, so headers stay one line each.
    """
    data = utf8(F.col(payload_col))
    keyed = pages.select(
        F.col(id_col).alias("id"),
        F.regexp_replace(F.regexp_replace(F.col(url_col).cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"),
        data.alias("payload"),
        F.sha2(data, 256).alias("sha256"),
    )
    narrow = scratch.write(
        keyed.select("id", "url", "sha256", base32_sha1(F.col("payload")).alias("sha1"), F.length("payload").cast("long").alias("bytes")),
        "keys",
    )
    # one row per digest and map task passes the rank limit below the exchange
    first = Window.partitionBy("sha256").orderBy(F.col("id").desc_nulls_last())
    scratch.write(
        keyed.select("id", "sha256", "payload").withColumn("rn", F.row_number().over(first)).filter("rn = 1").select("sha256", "payload"),
        "payloads",
    )
    latest = narrow.groupBy("sha256").agg(F.max("id").alias("top"))
    same = F.col("id").eqNullSafe(F.col("top")) | (F.col("bytes") < min_bytes)
    rows = narrow.join(latest, "sha256").withColumn("response", same)
    kind = F.when(F.col("response"), "response").otherwise("revisit")
    revisit = ~F.col("response")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", record_id(F.col("id"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(revisit, record_id(F.col("top")))),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _line("X-Page-ID", F.col("id").cast("string")),
        _line("X-Refers-To-Page-ID", F.when(revisit, F.col("top").cast("string"))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
    )
    scratch.write(rows.select(F.encode(header, "UTF-8").alias("header"), "sha256"), "headers")
    scratch.drop("keys")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record again: parsed header fields, payload, and the record's own bytes.

    Stored payloads are hashed anew and must match the digest they lie under; a
    mismatch ends the job. ``payload``, ``payload_bytes`` and ``payload_digest`` are
    those of the full payload, also for revisits; ``record`` is the exact WARC record
    (a revisit's block is empty). Reading only the narrow columns leaves the payload
    bytes out of the join.
    """
    store = spark.read.parquet(f"{path}/payloads")
    sound = F.sha2("payload", 256) == F.col("sha256")
    store = store.select(
        F.when(sound, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "sha256"))).alias("sha256"),
        "payload",
        F.length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
    )
    headers = spark.read.parquet(f"{path}/headers").withColumn("header", F.decode("header", "UTF-8"))
    fields = headers.select(
        "sha256",
        "header",
        _field("X-Page-ID").cast("long").alias("page_id"),
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Record-ID").alias("record_id"),
        _field("X-Refers-To-Page-ID").cast("long").alias("refers_to"),
        F.substring_index(_field("WARC-Payload-Digest"), ":", -1).alias("declared_digest"),
    )
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return fields.join(store, "sha256").withColumn(
        "record", F.concat(F.encode("header", "UTF-8"), block, F.lit(b"\r\n\r\n"))
    )
