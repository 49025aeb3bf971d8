"""WARC archives of pages: equal payloads are stored once, later copies are revisit records.

Headers, not payloads, decide: they are shuffled by payload digest, the first of each digest is the original, and the
others are joined to it. Archives are written by Spark's text sink, lines ending in CRLF as the format wants, one gzip
stream a file; they are read back by lines, and records are put together by their Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.llm import rows

CRLF = "\r\n"
#: Version line, revisit profile, the digits of Spark's base 32 and those of RFC 4648.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RADIX_32, RFC_4648 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: What a record without an address is said to be of; the format wants an address in every record.
NO_ADDRESS = "about:blank"


def base32(digest: Column) -> Column:
    """Upper-case base32 of a 20-byte digest: five hexadecimal digits are four of base 32."""
    digits = F.hex(digest)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), RADIX_32, RFC_4648)


def headers(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, digest (SHA-1 of the payload, binary), size (bytes of the payload); a null page is empty."""
    payload = F.coalesce(F.col(page), F.lit(""))
    return pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.unhex(F.sha1(payload)).alias("digest"),
        F.octet_length(payload).cast("long").alias("size"))


def _order() -> Column:
    """What the original is the least of: the id, null ids last, then the address."""
    return F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")


def revisits(found: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Headers of all revisit records: page_id, url, digest, size, nth and first (the order of the original).

    Equal headers are counted first, so that a page stored many times is one row until the end; of those that equal the
    original one is the response. A digest with many pages is one row of the originals, and its headers on the other side
    of the join are split by the adaptive plan.
    """
    counted = found.where(F.col("size") >= least_bytes).groupBy("digest", "size", "page_id", "url").agg(
        F.count("*").alias("n"))
    originals = found.groupBy("digest").agg(F.min(_order()).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    mine = F.col("n") - F.when(_order() == F.col("first"), 1).otherwise(0)
    return counted.join(originals.drop("copies"), "digest").withColumn("left", mine).where("left > 0").select(
        "page_id", "url", "digest", "size", F.explode(F.sequence(F.lit(1), "left")).alias("nth"), "first")


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html",
              least_bytes: int = 0) -> DataFrame:
    """Response records: page_id, url, digest, size, nth, payload. One for each digest of payloads of least_bytes or more,
    made where the pages are read as far as copies lie together, and one for each page with a smaller payload."""
    payload = F.coalesce(F.col(page), F.lit(""))
    whole = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.unhex(F.sha1(payload)).alias("digest"),
        F.octet_length(payload).cast("long").alias("size"), payload.alias("payload"))
    first = whole.where(F.col("size") >= least_bytes).groupBy("digest").agg(
        F.min(_order()).alias("first"), F.first("size").alias("size"), F.first("payload").alias("payload"))
    out = first.select("first.page_id", "first.url", "digest", "size", F.lit(0).cast("long").alias("nth"), "payload")
    if least_bytes <= 0:
        return out
    small = whole.where(F.col("size") < least_bytes).select(
        "page_id", "url", "digest", "size", F.monotonically_increasing_id().alias("nth"), "payload")
    return out.unionByName(small)


def _record_id(page_id: Column, url: Column, digest: Column, nth: Column) -> Column:
    """A URN of a UUID (version 8) that a rerun of a task gives again."""
    empty = F.lit("-")
    d = F.md5(F.concat_ws("\n", F.coalesce(page_id.cast("string"), empty), F.coalesce(url, empty), F.hex(digest), nth.cast("string")))
    return F.concat(
        F.lit("<urn:uuid:"), F.substring(d, 1, 8), F.lit("-"), F.substring(d, 9, 4), F.lit("-8"), F.substring(d, 14, 3),
        F.lit("-a"), F.substring(d, 18, 3), F.lit("-"), F.substring(d, 21, 12), F.lit(">"))


def _address(url: Column) -> Column:
    """The address without what would end a header line or its value."""
    plain = F.translate(F.trim(url), "\r\n\t\0", "")
    return F.when(F.coalesce(plain, F.lit("")) == "", NO_ADDRESS).otherwise(F.replace(plain, F.lit(" "), F.lit("%20")))


def _lines(*parts: tuple[str, Column | str]) -> Column:
    """Header lines of those parts that are not null, each with its end."""
    line = [F.concat(F.lit(f"{name}: "), v if isinstance(v, Column) else F.lit(v), F.lit(CRLF)) for name, v in parts]
    return F.concat(*[F.coalesce(x, F.lit("")) for x in line])


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", least_bytes: int = 0,
            date: str | None = None) -> DataFrame:
    """record (string): every page as a WARC record with fresh headers, but for the CRLF that ends it.

    The block of a response is an HTTP response with the payload, that of a revisit the same without the payload, its
    Content-Length still that of the whole payload. page_id and that of the original are extension fields, as the format
    has none for them. date: WARC-Date of all records, the time of the query where it is not given.
    """
    when = F.lit(date) if date else F.date_format(
        F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}"),
        _lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", F.col("size").cast("string"))), F.lit(CRLF))

    def record(kind: str, block: Column, *more: tuple[str, Column | str]) -> Column:
        own = _record_id(F.col("page_id"), F.col("url"), F.col("digest"), F.col("nth"))
        return F.concat(F.lit(VERSION + CRLF), _lines(
            ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", when), ("WARC-Target-URI", _address(F.col("url"))),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))), *more,
            ("X-Page-ID", F.col("page_id").cast("string")), ("Content-Type", "application/http;msgtype=response"),
            ("Content-Length", F.octet_length(block).cast("string"))), F.lit(CRLF), block, F.lit(CRLF))

    first = responses(pages, page_id, url, page, least_bytes).select(
        record("response", F.concat(http, F.col("payload"))).alias("record"))
    original = [F.col("first")[c] for c in ("page_id", "url")]
    again = revisits(headers(pages, page_id, url, page), least_bytes).select(record(
        "revisit", http, ("WARC-Profile", PROFILE),
        ("WARC-Refers-To", _record_id(*original, F.col("digest"), F.lit(0).cast("long"))),
        ("WARC-Refers-To-Target-URI", _address(original[1])), ("WARC-Refers-To-Date", when),
        ("X-Refers-To-Page-ID", original[0].cast("string"))).alias("record"))
    return first.unionByName(again)


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", page: str = "html",
          least_bytes: int = 0, date: str | None = None) -> None:
    """Writes pages as gzip-compressed WARC files below path.

    Every row of pages becomes one record. Of payloads that are equal byte for byte and have least_bytes or more, the
    page with the smallest id (null ids last, then the smallest address) is a response and the others are revisits; of
    rows that are equal in all of that one is the response. Smaller payloads are all responses. Null pages are empty
    payloads, null and blank addresses are written as about:blank, line ends in addresses are left out; other columns
    are not read. An empty table gives no records. A page is held whole by one task at a time, of any length.
    """
    records(pages, page_id, url, page, least_bytes, date).write.option("lineSep", CRLF).option("compression", "gzip").text(path)


class _Parser:
    """Records from the lines of archives, in order. Lines come without their CRLF."""

    def __init__(self) -> None:
        self.fields: dict[str, str] | None = None
        self.missing = -1  # bytes of the block that are still to come; -1 in headers and between records
        self.parts: list[bytes] = []

    def feed(self, line: bytes) -> tuple[dict[str, str], bytes] | None:
        if self.missing >= 0:
            return self._block(line)
        if self.fields is None:
            if line == VERSION.encode():
                self.fields = {}
            elif line:
                raise ValueError(f"not the start of a WARC record: {line[:80]!r}")
            return None
        if line:
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            self.fields[name.strip().lower()] = value.strip()
            return None
        self.missing = int(self.fields["content-length"])
        return None

    def _block(self, line: bytes) -> tuple[dict[str, str], bytes] | None:
        """The end of a line is of the block where the block goes on behind it."""
        self.parts.append(line)
        self.missing -= len(line)
        if self.missing > 0:
            self.parts.append(b"\r\n")
            self.missing -= 2
            if self.missing >= 0:
                return None  # what ends the block is still to come, be it the empty line behind a last CRLF
        if self.missing < 0:
            raise ValueError("a block does not end where its Content-Length says")
        block, fields = b"".join(self.parts), self.fields
        self.fields, self.missing, self.parts = None, -1, []
        return fields, block


def _parsed(fields: dict[str, str], block: bytes) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response":
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if own != digest or len(payload) != size:
            raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    refers = fields.get("x-refers-to-page-id")
    return {
        "page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None, "payload_bytes": size,
        "payload_digest": digest, "record_type": kind, "refers_to": int(refers) if refers is not None else None,
        "url": fields["warc-target-uri"], "record_id": fields["warc-record-id"],
        "refers_to_record": fields.get("warc-refers-to"),
        "payload": payload.decode("utf-8", "surrogatepass") if kind == "response" else None}


_SCHEMA = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, "
           "record_id string, refers_to_record string")


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row a record of the archives below path: page_id, payload_bytes, payload_digest, record_type, refers_to, url,
    record_id, refers_to_record, and the payload of responses if asked for.

    Payloads of responses are held against their length and digest. A gzip file is one task, read line by line: a task
    holds one record. An archive that does not follow the format is an error.
    """
    schema = _SCHEMA + (", payload string" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]
    fields = [(n, pa.int64() if n in ("page_id", "payload_bytes", "refers_to") else pa.string()) for n in names]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _Parser()
        for batch in rows.pieces(batches):
            out = []
            for line in rows.texts(batch.column("value")):
                done = parser.feed(line)
                if done is not None:
                    out.append({k: v for k, v in _parsed(*done).items() if k in names})
            yield pa.RecordBatch.from_pylist(out, pa.schema(fields))
        if parser.fields is not None or parser.missing >= 0:
            raise ValueError("an archive ends within a record")

    lines = spark.read.schema("value string").option("lineSep", CRLF).text(path)
    return rows.map_arrow(lines, parse, schema)
