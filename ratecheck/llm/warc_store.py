"""Content-addressed WARC archive: payload bytes stored once, record headers kept apart.

The archive is two tables in one folder. ``payloads`` holds each distinct payload under its
SHA-256; ``headers`` holds, for every record, its exact header bytes and the digest of its
payload. Original records come back by a join on the digest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ratecheck.llm.common import shared_folder, stage

# The alphabets of conv() in base 32 and of RFC 4648 base 32.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
URN = "urn:page:"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four digits for every five hexadecimal ones."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), CONV_DIGITS, BASE32_DIGITS)


def record_id(page: Column, record: Column) -> Column:
    return F.concat(F.lit(f"<{URN}"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"),
                    record.cast("string"), F.lit(">"))


def header_line(name: str, value: Column) -> Column:
    """One header line; nothing for a null. Control characters cannot end a line early."""
    safe = F.regexp_replace(value, r"[\x00-\x1F\x7F]", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def entries(pages: DataFrame, id_column: str, url_column: str, body_column: str) -> DataFrame:
    """One narrow row per page: a record number, digests and length of the payload."""
    body = F.coalesce(F.col(body_column).cast("string"), F.lit("")).cast("binary")
    return pages.select(
        F.monotonically_increasing_id().alias("record"), F.col(id_column).alias("page_id"),
        F.col(url_column).cast("string").alias("url"), F.sha2(body, 256).alias("digest"),
        base32_sha1(body).alias("sha1"), F.octet_length(body).cast("long").alias("n_bytes"))


def typed(records: DataFrame, least_bytes: int) -> DataFrame:
    """Name the response of each payload: the record with the largest page id.

    Null ids come last; of repeated ids the larger record number wins. Digests are reduced to
    one narrow row each before they meet the records again.
    """
    chosen = records.filter(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(
        F.max(F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", "record"))
        .alias("first"))
    joined = records.join(chosen, "digest", "left")
    again = F.col("first").isNotNull() & (F.col("first.record") != F.col("record"))
    return joined.select(
        *records.columns, F.when(again, "revisit").otherwise("response").alias("type"),
        F.when(again, record_id(F.col("first.page_id"), F.col("first.record"))).alias("refers"))


def headers(records: DataFrame, date: str) -> DataFrame:
    """The exact WARC and HTTP header bytes of every record."""
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
        header_line("Content-Length", F.col("n_bytes").cast("string")), F.lit(CRLF))
    length = F.octet_length(http) + F.when(F.col("type") == "response", F.col("n_bytes")
                                           ).otherwise(0)
    warc = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), header_line("WARC-Type", F.col("type")),
        header_line("WARC-Record-ID", record_id(F.col("page_id"), F.col("record"))),
        header_line("WARC-Date", F.lit(date)), header_line("WARC-Target-URI", F.col("url")),
        header_line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        header_line("WARC-Refers-To", F.col("refers")),
        header_line("WARC-Profile", F.when(
            F.col("type") == "revisit",
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        header_line("Content-Type", F.lit("application/http; msgtype=response")),
        header_line("Content-Length", length.cast("string")), F.lit(CRLF))
    return records.select("record", "digest", warc.cast("binary").alias("warc_header"),
                          http.cast("binary").alias("http_header"))


def write_archive(pages: DataFrame, folder: str | None = None, id_column: str = "page_id",
                  url_column: str = "url", body_column: str = "html", least_bytes: int = 0,
                  date: str = "2024-01-01T00:00:00Z") -> str:
    """Write a WARC record for every row of a table; returns the archive's folder.

    The payload is the body in UTF-8, empty for null. Of records with equal payloads of at least
    ``least_bytes`` the one with the largest id is the response, the others revisit it. Null
    ids are smaller than any; of rows that repeat an id and payload one is the response. A
    null URL leaves out its header line. An empty table gives an empty archive. Other columns
    are not read. Copies of a payload are dropped before the shuffle as well as after it.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/llm-warc-{uuid.uuid4().hex}"
    records = stage(entries(pages, id_column, url_column, body_column), "warc-entries")
    headers(typed(records, least_bytes), date).write.parquet(f"{folder}/headers")
    body = F.coalesce(F.col(body_column).cast("string"), F.lit("")).cast("binary")
    stored = pages.select(F.sha2(body, 256).alias("digest"), body.alias("payload"))
    stored.groupBy("digest").agg(F.any_value("payload").alias("payload")).write.parquet(
        f"{folder}/payloads")
    return folder


def field(header: Column, name: str) -> Column:
    """The value of a header line, null if the line is absent."""
    value = F.regexp_extract(header, rf"\n{name}: ([^\r\n]*)\r\n", 1)
    return F.nullif(value, F.lit(""))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """Read the archive back: one row per record from its header and its stored payload.

    Returns ``record, page_id, payload_bytes, payload_digest, record_type, refers_to``. Length
    and digest are computed from the stored bytes. A payload that does not have its key's
    digest, or a record whose header states another, is an error. Payload bytes are digested
    where they are read; only digests are shuffled.
    """
    payloads = spark.read.parquet(f"{folder}/payloads").select(
        "digest", (F.sha2("payload", 256) == F.col("digest")).alias("sound"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"))
    read = spark.read.parquet(f"{folder}/headers").select(
        "record", "digest", F.col("warc_header").cast("string").alias("header"))
    read = read.join(payloads, "digest", "left")
    good = (F.col("sound") & (field(F.col("header"), "WARC-Payload-Digest")
                              == F.concat(F.lit("sha1:"), F.col("payload_digest"))))

    def page(name: str) -> Column:
        found = F.regexp_extract(field(F.col("header"), name), rf"^<{URN}([^:]*):", 1)
        return F.nullif(found, F.lit("")).cast("long")

    return read.select(
        "record", page("WARC-Record-ID").alias("page_id"),
        F.when(F.coalesce(good, F.lit(False)), F.col("payload_bytes")).otherwise(
            F.raise_error(F.lit("payload does not match its digest")).cast("long"))
        .alias("payload_bytes"),
        "payload_digest", field(F.col("header"), "WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"))


def read_records(spark: SparkSession, folder: str, originals: bool = False) -> DataFrame:
    """Rebuild the records: ``record, content`` with the exact bytes of each WARC record.

    A revisit has no payload in its block. With ``originals`` the column ``payload`` holds the
    payload of every record, revisits included.
    """
    read = spark.read.parquet(f"{folder}/headers").join(
        spark.read.parquet(f"{folder}/payloads"), "digest")
    response = F.col("warc_header").cast("string").rlike(r"\nWARC-Type: response\r\n")
    block = F.when(response, F.col("payload")).otherwise(F.lit(b""))
    content = F.concat("warc_header", "http_header", block, F.lit(b"\r\n\r\n"))
    extra = ["payload"] if originals else []
    return read.select("record", content.alias("content"), *extra)
