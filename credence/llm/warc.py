"""A content-addressed WARC archive in two tables, payloads and records.

Payload bytes are stored once for each SHA-256 digest, record headers exactly as they stand in
the file. Records are rebuilt by joining the two; what is read back is checked against the
digest it was stored under and the one in its header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_folder

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 digest in upper-case base32: each 5 bytes are 8 digits of 5 bits."""
    digest = F.sha1(payload)
    fives = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*fives)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(name: str, value: Column) -> Column:
    """A header line; line breaks in a value would begin another one, so they are percent-encoded."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n"))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) as ``path``/payloads and ``path``/records.

    Of the records with equal payloads of ``least_bytes`` or more, the one with the largest
    page_id is a response and the others revisit it; smaller payloads are all responses. Null
    html is an empty payload and a null url an empty one; a null page_id is smaller than
    others, and a response if its payload has no others. Equal rows each give a record. Other
    columns are ignored. Groups of copies are combined before they are shuffled.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    digest = F.sha2("payload", 256)
    named = rows.select("page_id", "url", digest.alias("sha256"), base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    first = named.groupBy("sha256").agg(F.max("page_id").alias("response_id"))
    # Copies have the same bytes, so any of them is stored; each task sends one at most.
    stored = rows.select(digest.alias("sha256"), "payload").groupBy("sha256").agg(F.first("payload").alias("payload"))
    stored.write.parquet(f"{path}/payloads")

    records = named.join(first, "sha256")
    revisit = (F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("payload_bytes"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("revisit"), F.concat(
            _line("WARC-Refers-To", _record_id(F.col("response_id"))), _line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), _line("Content-Length", block.cast("string")), F.lit("\r\n"))
    records = records.withColumn("revisit", revisit).withColumn("http", http)
    records.select("page_id", "sha256", F.concat(header, F.col("http")).cast("binary").alias("header")).write.parquet(f"{path}/records")


def _field(name: str) -> Column:
    return F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def parsed(records: DataFrame) -> DataFrame:
    """The records with what their headers say: record_type, refers_to, header_digest, url."""
    target = F.regexp_extract(_field("WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1)
    return records.select(
        "*", _field("WARC-Type").alias("record_type"), F.when(target != "", target.cast("long")).alias("refers_to"),
        F.substring_index(_field("WARC-Payload-Digest"), ":", -1).alias("header_digest"), _field("WARC-Target-URI").alias("url"))


def verified(payloads: DataFrame) -> DataFrame:
    """The stored payloads with payload_bytes and payload_digest; fails where bytes don't have their digest."""
    wrong = F.raise_error(F.concat(F.lit("payload does not have the digest "), F.col("sha256")))
    payload = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(wrong.cast("binary"))
    return payloads.select("sha256", payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))


def read_archive(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url of each record, checked.

    The digests are those of the stored payloads, computed once for each; payloads do not move.
    """
    checked = verified(spark.read.parquet(f"{path}/payloads")).drop("payload")
    both = parsed(spark.read.parquet(f"{path}/records")).join(checked, "sha256")
    wrong = F.raise_error(F.concat(F.lit("header and payload differ in record "), _record_id(F.col("page_id"))))
    digest = F.when(F.col("header_digest") == F.col("payload_digest"), F.col("payload_digest")).otherwise(wrong.cast("string"))
    return both.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to", "url")


def rebuilt_records(spark, path: str) -> DataFrame:
    """page_id, record (the exact bytes of the WARC record) and payload (also of revisits)."""
    both = parsed(spark.read.parquet(f"{path}/records")).join(verified(spark.read.parquet(f"{path}/payloads")), "sha256")
    end = F.lit(bytearray(b"\r\n\r\n"))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(bytearray()))
    return both.select("page_id", F.concat("header", body, end).alias("record"), "payload")


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` archived in the shared folder and read back."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    archive(pages, path, least_bytes)
    return read_archive(spark, path)
