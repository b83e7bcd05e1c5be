"""Web archives: writing pages as WARC records, and a reader that salvages what damaged archives still hold.

Records are built by column expressions and written by Spark's text writer, whose line separator is the end of a record.
The reader takes archives whole, as Spark's binary files, so it needs no other access to the store. A record or a
compressed member that fails a check is quarantined: the reader looks for the next version line or member that holds,
goes on from there, and reports the bytes in between.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from graticule.llm.common import mapped, scratch_path, small_batches, stored, text_of

RECORDS_PER_FILE = (1000, 125, 15, 2, 1)  # by size: the longest records of each class fill ``FILE_BYTES``, but for the last
FILE_BYTES = 64 << 20  # of payloads and addresses in an archive, unless it holds one longer record
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
SCHEMA = (
    "file string, offset long, length long, problem string, record_type string, record_id string, refers_to string,"
    " url string, page_id string, payload_bytes long, payload_digest string, payload binary"
)

VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
MEMBER = b"\x1f\x8b\x08"
MEMBER_START, HEADER_END, BLANK = re.compile(re.escape(MEMBER)), re.compile(rb"\r\n\r\n"), re.compile(rb"\s*")
CHUNK = 64 << 10  # bytes of a compressed member that are inflated at once
MEMBER_BYTES = 1 << 30  # a member that inflates to more is quarantined


def base32_sha1(content: Column) -> Column:
    """The SHA-1 of a string's bytes in upper-case base32: 20 bits of the hexadecimal form at a time."""
    digest = F.upper(F.sha1(F.encode(content, "UTF-8")))
    quads = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def revisited(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Adds ``first`` to rows (id, url, payload, n, digest): the smallest identifier among rows of an equal payload of at
    least ``least_bytes``, NULL where no other row has that payload.

    Only digests that repeat are joined back; Spark decides by their stored size whether the pages need a shuffle.
    """
    copies = (
        pages.where((F.col("n") >= least_bytes) & F.col("id").isNotNull()).groupBy("digest", "n")
        .agg(F.count("*").alias("rows"), F.min("id").alias("first")).where("rows > 1").drop("rows")
    )
    return pages.join(stored(copies, "warc-copies"), ["digest", "n"], "left")


def write(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0,
    date: str = "2000-01-01T00:00:00Z",
) -> None:
    """Writes a WARC/1.1 record for every row: a response with the page in UTF-8, or a revisit of the response with the
    same payload and the smallest identifier. Payloads below ``least_bytes`` are all responses.

    A missing page is an empty payload. Rows that share the smallest identifier and the payload are all responses; rows
    without an identifier are responses too. Line ends in an address become spaces. An empty table writes no record.

    Records are dealt by size, and each class that occurs is written by a job of its own, so that no archive of several
    records holds more than ``FILE_BYTES`` of payloads and addresses. One more job finds the classes.
    """
    rows = pages.select(
        F.col(page_id).alias("id"), F.regexp_replace(text_of(url), r"[\r\n]+", " ").alias("url"), text_of(html).alias("payload")
    ).withColumns({"n": F.octet_length("payload").cast("long"), "digest": base32_sha1(F.col("payload"))})
    marked = revisited(rows, least_bytes)
    own, end = F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\n")

    def record_id(key: Column) -> Column:
        h = F.md5(F.encode(F.concat(F.lit("page "), key), "UTF-8"))
        return F.concat(F.lit("<urn:uuid:"), *[x for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if a > 1 else ()) + (F.substring(h, a, b),)], F.lit(">"))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, end)

    again = F.col("first").isNotNull() & F.col("id").isNotNull() & (F.col("id") != F.col("first"))
    block = F.when(again, F.lit("")).otherwise(F.concat(F.lit(HTTP_HEAD), F.col("n").cast("string"), F.lit("\r\n\r\n"), F.col("payload")))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        field("WARC-Record-ID", record_id(own)), field("WARC-Date", F.lit(date)), field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("X-Payload-Length", F.col("n").cast("string")), field("X-Page-ID", own),
        F.when(again, F.concat(
            field("WARC-Profile", F.lit(PROFILE)), field("WARC-Refers-To", record_id(F.col("first").cast("string"))),
            field("X-Refers-To-Page-ID", F.col("first").cast("string")),
        )).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        field("Content-Length", F.octet_length("block").cast("string")), end, F.col("block"),
    )
    size = F.octet_length("payload").cast("long") + F.coalesce(F.octet_length("url"), F.lit(0))
    kind = sum((F.when(size > FILE_BYTES // most, 1).otherwise(0) for most in RECORDS_PER_FILE[:-1]), F.lit(0))
    kinds = sorted(r["kind"] for r in rows.select(kind.alias("kind")).distinct().collect()) or [0]
    for mode, k in zip(["errorifexists", *["append"] * len(kinds)], kinds):
        some = marked.where(kind == k) if len(kinds) > 1 else marked
        some.withColumn("block", block).select(record.alias("value")).write.mode(mode).option("lineSep", "\r\n\r\n").option(
            "maxRecordsPerFile", RECORDS_PER_FILE[k]
        ).text(path)


def parse_record(data: bytes, at: int, ends: Ahead) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block and end of the record at a place, where ``ends`` finds the ends of headers. Raises ValueError
    where a check fails."""
    version = VERSION.match(data, at)
    if not version:
        raise ValueError("no version line")
    head_end = ends.next(version.end() - 2)
    if head_end == len(data):
        raise ValueError("header without an end")
    fields, place = {}, version.end()
    while place < head_end:  # a line at a time: the end may belong to a record far behind
        stop = data.find(b"\r\n", place, head_end + 2)
        name, colon, value = data[place:stop].decode("utf-8", "replace").partition(":")
        if not colon:
            raise ValueError("malformed header line")
        fields[name.strip().lower()] = value.strip()
        place = stop + 2
    if not re.fullmatch(r"\d{1,18}", fields.get("content-length", "")):
        raise ValueError("no content length")
    if "warc-type" not in fields:
        raise ValueError("no record type")
    start = head_end + 4
    stop = start + int(fields["content-length"])
    if stop > len(data):
        raise ValueError("record is cut off")
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    block = data[start:stop]
    wanted = fields.get("warc-block-digest", "")
    if wanted.startswith("sha1:") and sha1(block) != wanted[5:].upper():
        raise ValueError("block digest differs")
    wanted = fields.get("warc-payload-digest", "")
    if fields["warc-type"].lower() == "response" and wanted.startswith("sha1:") and sha1(payload_of(fields, block)) != wanted[5:].upper():
        raise ValueError("payload digest differs")
    return fields, block, stop + 4


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    if fields.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def sha1(content: bytes) -> str:
    return base64.b32encode(hashlib.sha1(content).digest()).decode()


def open_member(data: bytes, at: int, most: int = MEMBER_BYTES) -> tuple[bytes, int]:
    """Content and end of the compressed member at a place, read by ``CHUNK``. Raises ValueError if it is damaged, cut off
    or inflates to more than ``most`` bytes."""
    unpacked = zlib.decompressobj(31)
    view, place, parts, held = memoryview(data), at, [], 0
    while not unpacked.eof:
        chunk = unpacked.unconsumed_tail or view[place : place + CHUNK]
        if not unpacked.unconsumed_tail:
            place += len(chunk)
        try:
            part = unpacked.decompress(chunk, 16 * CHUNK)
        except zlib.error as e:
            raise ValueError(f"damaged member: {e}") from None
        held += len(part)
        if held > most:
            raise ValueError("member inflates beyond the limit")
        if not len(chunk) and not part and not unpacked.eof:
            raise ValueError("member is cut off")
        parts.append(part)
    return b"".join(parts), place - len(unpacked.unused_data)


class Ahead:
    """The next hit of a pattern from a place on. Hits are remembered, so that places that only grow are searched once."""

    def __init__(self, data: bytes, pattern: re.Pattern):
        self.data, self.pattern = data, pattern
        self.since, self.hit = 0, -1

    def next(self, at: int) -> int:
        """Where the next hit starts; the length of the data if there is none."""
        if not self.since <= at <= self.hit:
            found = self.pattern.search(self.data, at)
            self.since, self.hit = at, found.start() if found else len(self.data)
        return self.hit


def salvage(data: bytes, inside: bool = False, most: int = MEMBER_BYTES) -> Iterator[tuple[int, int, str | None, dict[str, str], bytes]]:
    """Records and quarantined gaps of an archive, in order: offset, length, problem (NULL for a record), fields, block.

    Offsets within a compressed member are those of the member, which holds plain records only: ``inside`` it no further
    member is opened. A member that inflates to more than ``most`` bytes is a gap. White space between records is no gap.
    """
    versions, members, ends = Ahead(data, VERSION), Ahead(data, MEMBER_START), Ahead(data, HEADER_END)
    at, bad, why = 0, None, ""
    while at < len(data):
        try:
            if not inside and data.startswith(MEMBER, at):
                content, stop = open_member(data, at, most)
                inner, first = salvage(content, inside=True), []
                for found in inner:
                    first.append(found)
                    if found[2] is None:
                        break
                else:
                    raise ValueError("member holds no record")
                records = ((at, stop - at, *found[2:]) for found in chain(first, inner))
            else:
                fields, block, stop = parse_record(data, at, ends)
                records = iter([(at, stop - at, None, fields, block)])
        except ValueError as e:
            if bad is None:
                bad, why = at, str(e)
            at = versions.next(at + 1) if inside else min(versions.next(at + 1), members.next(at + 1))
            continue
        if bad is not None and not BLANK.fullmatch(data, bad, at):
            yield bad, at - bad, why, {}, b""
        bad = None
        yield from records
        at = stop
    if bad is not None and not BLANK.fullmatch(data, bad):
        yield bad, len(data) - bad, why, {}, b""


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of all archives in a folder, plain or compressed by record or as a whole.

    ``problem`` is NULL for a record and says what failed first for a gap of quarantined bytes, given by file, offset and
    length. ``payload_bytes`` and ``payload_digest`` are of the payload found in a response; a revisit has those that its
    header names. Each archive is read in one piece, at most 2 GB, by one task; a longer one fails the job. A compressed
    member of more than 1 GiB of content is a gap.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "content"):
            for file, content in zip(batch.column("path"), batch.column("content")):
                rows = []
                held = 0
                for found in salvage(content.as_py() or b""):
                    rows.append((file.as_py(), *row_of(found, with_payload)))
                    held += len(found[4]) if with_payload else 1000
                    if held > 4 << 20:
                        yield to_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield to_batch(rows)

    return mapped(files, run, SCHEMA if with_payload else SCHEMA.replace(", payload binary", ""))


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"file": pa.string(), "offset": pa.int64(), "length": pa.int64(), "problem": pa.string(), "record_type": pa.string(), "record_id": pa.string(), "refers_to": pa.string(), "url": pa.string(), "page_id": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds)[: len(rows[0])])


def row_of(found: tuple, with_payload: bool) -> tuple:
    offset, length, problem, fields, block = found
    if problem is not None:
        return (offset, length, problem, *[None] * (8 if with_payload else 7))
    kind = fields["warc-type"].lower()
    payload = payload_of(fields, block)
    size, digest = len(payload), sha1(payload)
    if kind == "revisit":
        named = fields.get("x-payload-length", "")
        size = int(named) if named.isdigit() else None
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    refers = fields.get("x-refers-to-page-id", fields.get("warc-refers-to"))
    row = (offset, length, None, kind, fields.get("warc-record-id"), refers, fields.get("warc-target-uri"), fields.get("x-page-id") or None, size, digest)
    return (*row, payload) if with_payload else row


def roundtrip(pages: DataFrame, least_bytes: int = 0, page_id: str = "page_id") -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back: one row per record, without payloads. A gap
    in these archives would be a lost page, so it fails the job."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, page_id=page_id, least_bytes=least_bytes)
    return records_only(read(spark, path, with_payload=False), pages.schema[page_id].dataType, page_id)


def records_only(found: DataFrame, kind: DataType, page_id: str = "page_id") -> DataFrame:
    """The records of archives that must be whole. A gap fails the job, by file and offset."""
    lost = F.raise_error(F.concat(F.lit("gap in "), "file", F.lit(" at "), F.col("offset").cast("string"), F.lit(": "), "problem"))
    return found.where(F.when(F.col("problem").isNull(), F.lit(True)).otherwise(lost.cast("boolean"))).select(
        F.col("page_id").cast(kind).alias(page_id), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
