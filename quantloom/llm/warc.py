"""WARC archives whose repeated payloads are revisit records.

Headers are shuffled by payload digest, with the digest's count and largest page kept per task first; only the
digests that come more than once are joined to the records. Where these fit a bound that is counted, they go to
the records, and no payload crosses the shuffle; beyond it the records go to them, by a join that Spark may split
where one digest has many. The archives are written anew, with fresh headers: each file is one gzip stream of
WARC/1.1 records. They are read as a stream, so that no file is ever held as a whole.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, stored, table

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes: 4 times 40 bits, each as 8 digits to base 32."""
    digest = F.sha1(text.cast("binary"))
    part = lambda i: F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0")
    digits, letters = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return F.translate(F.concat(*map(part, range(4))), digits, letters)


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> page_id, url, payload, payload_bytes, payload_digest; null html is empty."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        "page_id",
        F.regexp_replace("url", r"[\s\p{Cntrl}]", "").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        base32_sha1(payload).alias("payload_digest"),
    )


def resolve(records: DataFrame, min_bytes: int = 0, broadcast_digests: int = 200_000) -> DataFrame:
    """Adds refers_to: the largest page_id with the same payload, for all other records of at least min_bytes."""
    keys = ["payload_digest", "payload_bytes"]
    originals = (
        records.where(F.col("payload_bytes") >= min_bytes)
        .groupBy(*keys)
        .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    originals = stored(originals, "originals")
    # at 32 letters and two numbers a row, so many rows are under 20 MB
    few = originals.limit(broadcast_digests + 1).count() <= broadcast_digests
    other = F.coalesce(F.col("original") != F.col("page_id"), F.col("page_id").isNull())
    return records.join(F.broadcast(originals) if few else originals.hint("merge"), keys, "left").select(
        *records.columns, F.when(other, F.col("original")).alias("refers_to")
    )


def write_archives(records: DataFrame, path: str, records_per_file: int = 100_000) -> None:
    """Writes headers() with refers_to as WARC records; revisit records carry the response's headers only."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"),
        line("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit("\r\n"),
    )
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", uri(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", uri(F.col("refers_to"))))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        http,
        F.when(revisit, "").otherwise(F.col("payload")),
    )
    # the separator that the text writer puts after each value is the one that ends a WARC record
    writer = records.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    writer.option("maxRecordsPerFile", records_per_file).text(path)


_END = b"\r\n\r\n"


def parse(chunks):
    """(headers, block) of the records of a file whose bytes come in chunks; no more than a record is held."""
    held, at, chunks = bytearray(), 0, iter(chunks)

    def more() -> bool:
        nonlocal at
        chunk = next(chunks, None)
        if chunk is not None:
            if at:
                del held[:at]
                at = 0
            held.extend(chunk)
        return chunk is not None

    while True:
        seen = 0
        while (end := held.find(_END, at + max(0, seen - 3))) < 0:
            seen = len(held) - at
            if not more():
                if bytes(held[at:]).strip():
                    raise ValueError("a WARC record breaks off")
                return
        if not bytes(held[at:end]).strip():  # a file whose last payload ends in a line break ends in more of them
            at = end + 4
            continue
        first, *rest = bytes(held[at:end]).decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        fields = dict(x.split(": ", 1) for x in rest)
        at, size = end + 4, int(fields["Content-Length"])
        while len(held) - at < size + 4:
            if not more():
                raise ValueError("a WARC record breaks off")
        yield fields, bytes(held[at : at + size])
        at += size + 4


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in a folder; with payloads, their bytes too, null for revisit records. Digests
    and sizes of responses are taken anew from their payloads; a digest that differs from its header is an error.

    The text reader unpacks a file and cuts it at what ends a record, and a payload may hold that too: a file's
    pieces come in order to one task, are put together again, and are cut by the records' own lengths."""

    def page(uri: str | None):
        text = (uri or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text not in ("", "null") else None

    def run(batches):
        pieces = ((f, p.as_buffer()) for batch in batches for f, p in zip(batch.column(0).to_pylist(), batch.column(1)))
        rows, held = [], 0
        for _, of_file in groupby(pieces, key=lambda x: x[0]):
            for fields, block in parse(x for _, p in of_file for x in (memoryview(p), _END)):
                head, _, payload = block.partition(_END)
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                http = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
                n = int(http["Content-Length"])
                if kind == "response":
                    n, own = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if own != digest:
                        raise ValueError(f"{fields['WARC-Record-ID']}: digest {own}, header {digest}")
                row = (page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), n, digest, kind, page(fields.get("WARC-Refers-To")))
                rows.append((*row, payload if kind == "response" else None) if payloads else row)
                held += len(payload) if payloads else 0
                if len(rows) == 512 or held > 1 << 25:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names[: len(rows[0])])

    files = spark.read.option("lineSep", _END.decode()).option("pathGlobFilter", "*.gz").text(path)
    files = files.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    return files.mapInArrow(run, schema + (", payload binary" if payloads else ""))


def archive(pages: DataFrame, path: str, min_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """Writes pages(page_id, url, html, ...) to deduplicated archives at path, and returns what they hold, with
    payloads or without.

    A null html is an empty payload, a null url leaves its header out, white space and control characters in
    a url are left out. Repeated rows of a group's largest page_id are all responses, with one record id. A
    row with a null page_id revisits its group's response if that has a page_id, else it is a response.
    """
    write_archives(resolve(headers(pages), min_bytes), path)
    return read_archives(pages.sparkSession, path, payloads)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive(table(spark, sf_dir, "pages"), new_path(spark, "warc"), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((('0x' || substr(hex, 1 + 10 * CAST(i // 8 AS INTEGER), 10))::BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS INTEGER), 1)), '') AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original <> page_id THEN original END AS refers_to
FROM m
"""
