"""Write WARC records (one gzip member each) and read archives back, damaged ones too.

The salvage reader checks every member (gzip CRC, version line, header block, Content-Length, payload digest).
After a failed check whose record or member still states where it ends (all bytes there, only a digest or header is
wrong), reading goes on behind that end, so nothing inside a damaged payload passes for a record. Otherwise it searches
for the next place that holds: a gzip magic whose member inflates whole, or, in plain archives, a version line whose
record holds; a record found so is marked, as it may have been part of a damaged payload. Records behind the damage are
recovered; the bytes between are logged as a quarantined gap. Archives are bounded binary rows, so no path is opened outside Spark, and a lost
task is simply run again: writing depends on nothing but its rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, tidy

ARCHIVE_BYTES = 4 << 20
STEP = 4096
GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/(?:0\.\d+|1\.[01])\r?\n")
END_OF_HEAD = re.compile(rb"\r?\n\r?\n")
DATE = "2024-01-01T00:00:00Z"


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    payload: bytes
    searched: bool = False  # found by a search in bytes given up, not where an earlier record or member ended


class Damaged(ValueError):
    """A failed check; ``end`` is where the record or member ends all the same, if that is known."""

    def __init__(self, why: str, end: int | None = None):
        super().__init__(why)
        self.end = end


@dataclass
class Salvage:
    """What an archive holds: its sound records, and (start, end, reason) of the bytes given up."""

    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_type: str, uri: str, record_id: str, payload: bytes, payload_digest: str, extra: dict[str, str] | None = None) -> bytes:
    """One record; a revisit carries no payload but the digest of the one it refers to."""
    body = b"" if record_type == "revisit" else payload
    head = {"WARC-Type": record_type, "WARC-Record-ID": record_id, "WARC-Date": DATE, "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]+", "", uri), "Content-Type": "text/html; charset=utf-8", "WARC-Payload-Digest": f"sha1:{payload_digest}", **(extra or {}), "Content-Length": str(len(body))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def member(record: bytes, level: int = 4) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def parse_record(data: bytes, start: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the record at ``start``; ValueError says which check fails."""
    if not (version := VERSION.match(data, start)):
        raise ValueError("no version line")
    if not (end := END_OF_HEAD.search(data, version.end() - 1)):
        raise ValueError("no end of headers")
    headers = {}
    for line in data[version.end() : end.start()].splitlines():
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        headers[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise ValueError("no content length")
    stop = end.end() + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("content length does not meet the end of the record")
    payload = data[end.end() : stop]
    claimed = headers.get("warc-payload-digest", "")
    if claimed.startswith("sha1:") and headers.get("warc-type") != "revisit" and claimed[5:] != digest(payload):
        raise Damaged("payload digest differs", stop + 4)
    return headers, payload, stop + 4


def _member_at(data: bytes, start: int) -> tuple[dict[str, str], bytes, int]:
    unpacker, parts, at = zlib.decompressobj(31), [], start
    try:
        while at < len(data) and not unpacker.eof:  # in steps, as what follows the member is copied each time
            parts.append(unpacker.decompress(data[at : at + STEP]))
            at += STEP
    except zlib.error as error:
        raise ValueError(f"gzip: {error}") from error
    if not unpacker.eof:
        raise ValueError("gzip: member ends early")
    stop = min(at, len(data)) - len(unpacker.unused_data)
    try:
        headers, payload, end = parse_record(plain := b"".join(parts))
    except ValueError as error:
        raise Damaged(str(error), stop) from error
    if end != len(plain):
        raise Damaged("bytes after the record", stop)
    return headers, payload, stop


def salvage(data: bytes) -> Salvage:
    """All sound records of an archive (gzip members, plain records, or both), and the gaps between them."""
    out, at, gap, why, searched = Salvage(), 0, None, "", False
    packed_at = plain_at = -1  # the next places of either kind, looked up again only once they are passed
    while at < len(data):
        packed = data.startswith(GZIP_MAGIC, at)
        try:
            headers, payload, end = _member_at(data, at) if packed else parse_record(data, at)
        except ValueError as error:
            if gap is None:
                gap, why = at, str(error)
            end = getattr(error, "end", None)
            searched = end is None
            if end is not None:
                at = end
                continue
            if packed_at <= at:
                packed_at = data.find(GZIP_MAGIC, at + 1)
                packed_at = len(data) if packed_at < 0 else packed_at
            if plain_at <= at:
                found = VERSION.search(data, at + 1)
                plain_at = found.start() if found else len(data)
            at = min(packed_at, plain_at)
            continue
        if gap is not None:
            out.gaps.append((gap, at, why))
            gap = None
        out.records.append(Record(at, headers, payload, searched))
        at, searched = end, False
    if gap is not None:
        out.gaps.append((gap, len(data), why))
    return out


_ARCHIVES = pa.schema([("archive", pa.string()), ("content", pa.binary())])
_RECORDS = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("searched", pa.bool_())])


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and ``first``: the smallest page_id of the rows with the same payload.

    Only digests that stand more than once take part in the join's small side, and the large side is dealt by
    digest and salt, so a payload that a third of the pages share is spread over tasks.
    """
    salts = max(32, pages.count() >> 17)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    firsts = rows.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    # A salted copy of a digest's first page for each salt only where copies could fill a task.
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    return rows.join(firsts, ["sha1", "salt"], "left").select("page_id", "url", "payload", "first")


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives as rows (archive, content) of about ``archive_bytes`` each, kept in the checkpoint folder.

    A page is ``response`` if no page with a smaller page_id has its payload, else ``revisit`` of that one. A null
    page_id is never smaller; such pages and repeated rows of the smallest page_id are responses.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def full() -> pa.RecordBatch:
            content = b"".join(held)
            return pa.RecordBatch.from_pydict({"archive": [hashlib.sha1(content).hexdigest() + ".warc.gz"], "content": [content]}, _ARCHIVES)

        for batch in batches:
            for page_id, url, payload, first in zip(*(batch.column(k).to_pylist() for k in range(4))):
                revisit = first is not None and page_id is not None and page_id != first
                extra = {"WARC-Refers-To": f"<urn:page:{first}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"} if revisit else {}
                extra["X-Payload-Bytes"] = str(len(payload))
                held.append(member(record_bytes("revisit" if revisit else "response", url, f"<urn:page:{'' if page_id is None else page_id}>", payload, digest(payload), extra)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield full()
                    held, size = [], 0
        if held:
            yield full()

    return checkpointed(with_revisits(pages).mapInArrow(tidy(write), "archive string, content binary"))


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps of archives (archive, content), such as rows of ``spark.read.format("binaryFile")``.

    A record's row has its start, page_id, record_type and so on, and no reason; ``searched`` is true where it was found
    by a search, so it may be a part of a damaged payload. A gap's row has start, end and reason only. Empty or null archives have neither.
    """

    def page(text: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
        return int(found[1]) if found else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = salvage(content.as_py() or b"")
                rows = []
                for r in found.records:
                    h = r.headers
                    rows.append({"archive": name, "start": r.offset, "page_id": page(h.get("warc-record-id")), "record_type": h.get("warc-type"), "uri": h.get("warc-target-uri"), "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:"), "payload_bytes": int(h.get("x-payload-bytes") or len(r.payload)), "refers_to": page(h.get("warc-refers-to")), "payload": r.payload if payloads else None, "searched": r.searched})
                rows += [{"archive": name, "start": a, "end": b, "reason": why} for a, b, why in found.gaps]
                yield pa.RecordBatch.from_pylist(rows, _RECORDS)

    kinds = "archive string, start bigint, end bigint, reason string, page_id bigint, record_type string, uri string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary, searched boolean"
    return archives.select("archive", "content").mapInArrow(tidy(read), kinds)


def page_records(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from the archives."""
    found = read_archives(write_archives(pages.select("page_id", "url", "html")), payloads=False)
    return found.where("reason is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows in SQL: 40 hex digits are 8 groups of 5, each 4 letters of base 32.
PAGE_RECORDS_SQL = """
WITH raw AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
hashed AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY sha1(h)) AS first FROM raw)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(x, (1 + 5 * (i // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM hashed
"""
