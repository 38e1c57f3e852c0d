"""WARC archives: write records, read them back, and replace repeated payloads by revisit records.

Only headers (ids, digest, size) are shuffled by payload digest, at any number of digests: a grouped minimum, combined before the
shuffle, finds the original of every payload, so copies that hold most records don't meet in one task. Few originals are
broadcast to where the payloads are read. Of more, the headers are joined with their originals first, and each record
then gets its verdict by its own id: payloads never meet by digest, so the payload that most records hold isn't a hot key.

Archives are written by Spark's text writer as gzip files of bounded numbers of records, each record followed by two line ends. They
are read as a stream, by the lengths that the headers state, so payloads may hold anything, and a task holds a record and not a file.

Edge cases: null payloads are empty; null or empty addresses are written as urn:page:<id>; line ends in addresses are
percent-encoded; ties: rows with the same page_id and payload are all responses; a record without page_id is never an original
and revisits one that has an id; an empty table gives an empty archive, which reads as an empty result; further columns
are ignored; payloads of any length up to Spark's 2 GB of a value are written whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS

#: Fixed values of the formats.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
BASE32_DIGITS, BASE32_LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


@dataclass(frozen=True)
class WarcParams:
    """min_bytes: smaller payloads are never revisits; records_per_file bounds an archive file; date: WARC-Date of the fresh headers."""

    min_bytes: int = 0
    records_per_file: int = 2048
    date: str = "2024-01-01T00:00:00Z"


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text's UTF-8 bytes: five hex digits make four letters."""
    hexes = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexes, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), BASE32_DIGITS, BASE32_LETTERS)


def record_id(page_id: Column, url: Column) -> Column:
    """A name-based record id."""
    h = F.md5(F.concat_ws(" ", F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit(""))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def page_records(pages: DataFrame) -> DataFrame:
    """Records of page_id, url, html: page_id, uri, record_id, payload, payload_digest, payload_bytes."""
    page_id, url = F.col("page_id").cast("long"), F.col("url").cast("string")
    uri = F.when(F.coalesce(url, F.lit("")) == "", F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")))).otherwise(F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")))
    rows = pages.select(page_id.alias("page_id"), uri.alias("uri"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    return rows.select("page_id", "uri", record_id(F.col("page_id"), F.col("uri")).alias("record_id"), "payload", payload_digest(F.col("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))


def resolve(records: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """Adds record_type, refers_to (record id) and refers_to_uri: of equal payloads the one with the smallest page_id is the response.

    A record whose payload is null is a revisit already; it stays one and refers to the original of its digest, if there is any.
    """
    headers = records.select("page_id", "record_id", "uri", "payload_digest", "payload_bytes", F.col("payload").isNull().alias("_bare"))
    own = ~F.col("_bare") & F.col("page_id").isNotNull() & (F.col("payload_bytes") >= params.min_bytes)
    first = F.min(F.when(own, F.struct("page_id", "record_id", "uri", "payload_bytes"))).alias("original")
    repeated = headers.groupBy("payload_digest").agg(first, F.count("*").alias("n")).filter("n > 1 AND original IS NOT NULL").drop("n")
    if repeated.count() <= MAX_BROADCAST_ROWS // 4:
        joined = records.join(F.broadcast(repeated), "payload_digest", "left")
    else:
        # what a record is dealt by only spreads a digest's records over tasks; records without an id have one by their page
        keys, dealt = ["_dealt", "payload_digest"], F.coalesce("record_id", record_id(F.col("page_id"), F.col("uri")))
        found = headers.withColumn("_dealt", dealt).join(repeated, "payload_digest").select(*keys, "original").dropDuplicates(keys)
        joined = records.withColumn("_dealt", dealt).join(found, keys, "left").drop("_dealt")
    revisit = F.col("payload").isNull() | (F.col("original").isNotNull() & (F.col("payload_bytes") >= params.min_bytes) & ~F.col("page_id").eqNullSafe(F.col("original.page_id")))
    joined = joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
    joined = joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "original.payload_bytes"))
    refers = {"refers_to": F.col("original.record_id"), "refers_to_uri": F.col("original.uri")}
    return joined.withColumns({k: F.when(F.col("record_type") == "revisit", v) for k, v in refers.items()}).drop("original")


def record_text(params: WarcParams = WarcParams()) -> Column:
    """The record with fresh headers, without the line ends that close it."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(HTTP), F.coalesce("payload_bytes", F.lit(0)).cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.coalesce("payload", F.lit(""))))

    def field(name, value):
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))

    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\n"),
        field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Date", F.lit(params.date)),
        field("WARC-Target-URI", F.col("uri")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        field("WARC-Refers-To", F.col("refers_to")),
        field("WARC-Refers-To-Target-URI", F.col("refers_to_uri")),
        field("Page-ID", F.col("page_id")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
        block,
    )


def write_archives(resolved: DataFrame, path: str, params: WarcParams = WarcParams()) -> None:
    """Gzip WARC files of resolved records."""
    text = resolved.select(record_text(params).alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", params.records_per_file).text(path)


def parse_records(parts: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of bytes that come in parts; line ends before a record are skipped."""
    source, held = iter(parts), bytearray()

    def more() -> bool:
        held.extend(part := next(source, b""))
        return bool(part)

    while True:
        while not held.strip(b"\r\n"):
            held.clear()
            if not more():
                return
        del held[: len(held) - len(held.lstrip(b"\r\n"))]
        while (end := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        head, *lines = bytes(held[: max(end, 0)]).split(b"\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {bytes(held[:40])!r}")
        fields = {}
        for line in lines:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        length = int(fields["content-length"])
        while len(held) < end + 4 + length:
            if not more():
                raise ValueError(f"record {fields.get('warc-record-id')} ends before its {length} bytes")
        yield fields, bytes(held[end + 4 : end + 4 + length])
        del held[: end + 4 + length]


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of gzip WARC files: page_id, uri, record_id, record_type, refers_to, payload_digest, payload_bytes and, if asked for, payload (null in revisits).

    Digest and size are computed from the payload that was read; those of revisits, which hold none, are what the header says and null.
    A record whose header has no id gets one by its file and place in what a task reads. Spark's text reader cuts a file at double line ends, which are put back: gzip files aren't split, so a file's parts come in order.
    """

    def rows_of(h: dict[str, str], block: bytes, place: str) -> dict:
        revisit, body = h["warc-type"] == "revisit", None
        h.setdefault("warc-record-id", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>")
        if not revisit:
            body = block[block.index(b"\r\n\r\n") + 4 :] if h.get("content-type", "").startswith("application/http") else block
        digest = h.get("warc-payload-digest", "").rpartition(":")[2] if revisit else base64.b32encode(hashlib.sha1(body).digest()).decode()
        row = {"page_id": int(h["page-id"]) if h.get("page-id") else None, "uri": h.get("warc-target-uri"), "record_id": h.get("warc-record-id"), "record_type": h["warc-type"], "refers_to": h.get("warc-refers-to"), "payload_digest": digest, "payload_bytes": None if revisit else len(body)}
        return row | ({"payload": None if revisit else body.decode("utf-8", "replace")} if payloads else {})

    def parse(batches):
        file = [""]

        def parts():
            for batch in batches:
                for part, path in zip(batch.column("value"), batch.column("file"), strict=True):
                    file[0] = path
                    yield part.as_py() + b"\r\n\r\n"

        rows, size = [], 0
        for k, (h, block) in enumerate(parse_records(parts())):
            rows.append(rows_of(h, block, f"{file[0]}#{k}"))
            size += len(block) if payloads else 0
            if len(rows) == 1024 or size >= 1 << 23:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    names = ["uri", "record_id", "record_type", "refers_to", "payload_digest"]
    arrow = pa.schema([("page_id", pa.int64()), *((n, pa.string()) for n in names), ("payload_bytes", pa.int64())] + [("payload", pa.string())] * payloads)
    schema = "page_id long, " + ", ".join(f"{n} string" for n in names) + ", payload_bytes long" + ", payload string" * payloads
    lines = spark.read.option("pathGlobFilter", "*.gz").text(path, lineSep="\r\n\r\n")
    return lines.select(F.col("value").cast("binary").alias("value"), F.input_file_name().alias("file")).mapInArrow(parse, schema)


def deduplicate_archives(spark: SparkSession, source: str, target: str, params: WarcParams = WarcParams()) -> None:
    """Reads archives and writes them again with every repeated payload as a revisit record and fresh headers."""
    write_archives(resolve(read_archives(spark, source).drop("record_type", "refers_to"), params), target, params)


def originals(records: DataFrame) -> DataFrame:
    """Joins revisit records to the responses they refer to: page_id, payload_bytes, payload_digest, record_type, refers_to (page_id)."""
    responses = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("original"), F.col("payload_bytes").alias("original_bytes")).dropDuplicates(["refers_to"])
    own = records.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = records.filter("record_type = 'revisit'").join(responses, "refers_to", "left")
    return own.unionByName(revisits.select("page_id", F.col("original_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("original").alias("refers_to")))
