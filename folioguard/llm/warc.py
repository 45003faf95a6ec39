"""WARC archives: a writer of one gzip member a record, and a reader that salvages damaged archives.

Writing. Payloads with equal SHA-1 and at least ``min_revisit_bytes`` bytes are stored once: the record of the smallest
key is the response, the others revisit it. Only digests and keys are aggregated. Spark's text writer stores the
members, so its commit protocol applies and any file system Spark knows will do; the separator it puts after each row
is an empty gzip member, which readers of multi-member files pass over.

Reading. Each archive is read as bytes. Members (or plain records at a version line) must decompress, have a sound
header, their full declared length and matching digests. After a failed check the reader looks for the next place that
passes them all, goes on from there, and logs the bytes between as a quarantined gap. Inside a member, also one whose
compressed data is damaged or cut off, the search goes on in the content that comes out; sound records of it are kept, and
each gap is logged with its place in the content.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioguard.llm.common import pick, release

EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
MEMBER_START = b"\x1f\x8b\x08"
RECORD_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
RECORD_END = b"\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 2_000
CHUNK = 1 << 16
LARGEST_BLOCK = 1 << 30
RECORD_FIELDS = (
    "archive string, offset bigint, length bigint, record_type string, record_id string, target_uri string, "
    "refers_to string, payload_digest string, http_length bigint, payload binary")
GAP_FIELDS = "archive string, gap_start bigint, gap_end bigint, reason string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: object) -> str:
    return f"<urn:x-page:{'' if pd.isna(key) else int(key)}>"


def record_key(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def build_record(key: object, url: str | None, payload: bytes, refers_to: object, date: str) -> bytes:
    """One record: the whole payload in a response, its HTTP header alone in a revisit."""
    revisit = not pd.isna(refers_to)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key)}",
             f"WARC-Date: {date}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
              "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + RECORD_END + block + RECORD_END


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def with_first_copies(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """key, url, payload and refers_to: the smallest key of the rows with an equal payload, null for that row itself,
    for shorter payloads and for payloads met once. A null payload counts as empty; null keys refer but are not
    referred to."""
    rows = pages.withColumn("payload", F.coalesce(F.col("payload"), F.lit("").cast("binary"))).withColumn(
        "digest", F.sha1("payload"))
    firsts = (
        rows.where(F.length("payload") >= min_revisit_bytes)
        .groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1").select(F.col("digest").alias("same"), "first"))
    joined = rows.join(firsts, (F.col("digest") == F.col("same")) & (F.length("payload") >= min_revisit_bytes), "left")
    return joined.select(
        "key", "url", "payload", F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(rows: DataFrame, path: str, date: str = "2026-01-01T00:00:00Z", level: int = 6) -> None:
    """Archives below ``path`` with a record for every row of ``with_first_copies``; an empty table gives no record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for batch in batches:
            members = [
                gzip_member(build_record(k, u, p, r, date), level)
                for k, u, p, r in zip(batch["key"], batch["url"], batch["payload"], batch["refers_to"])]
            yield pd.DataFrame({"member": members})

    members = rows.select("key", "url", "payload", "refers_to").mapInPandas(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option(
        "lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class Unsound(ValueError):
    """A check failed; the text says which."""


def _member(data: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """The content of the gzip member at ``at``, the place after it, and the fault that ended it early, if one did: then
    the content is what came out before it."""
    unpacker = zlib.decompressobj(31)
    parts, size, place, fault = [], 0, at, None
    while not unpacker.eof and fault is None:
        chunk = data[place : place + CHUNK]
        if not len(chunk):
            fault = "member is cut off"
            break
        before = unpacker.copy()
        try:
            parts.append(unpacker.decompress(chunk))
            place += len(chunk)
        except zlib.error as error:
            fault = f"member is damaged ({str(error).split(':')[0]})"
            parts.append(_prefix(before, chunk))
        size += len(parts[-1])
        if size > LARGEST_BLOCK:
            fault = "member is too large"
    return b"".join(parts), place if fault else place - len(unpacker.unused_data), fault


def _prefix(unpacker, chunk: memoryview) -> bytes:
    """What comes out of a chunk before the fault in it, byte by byte."""
    parts = []
    try:
        for i in range(len(chunk)):
            parts.append(unpacker.decompress(chunk[i : i + 1]))
    except zlib.error:
        pass
    return b"".join(parts)


def _record(data: bytes | memoryview, at: int) -> tuple[dict, int]:
    """The record whose version line is at ``at`` and the place after it."""
    window, size = bytes(data[at : at + CHUNK]), CHUNK
    if not VERSION.match(window):
        raise Unsound("no version line")
    while (stop := window.find(RECORD_END)) < 0 and len(window) == size:
        size *= 2
        window = bytes(data[at : at + size])
    if stop < 0:
        raise Unsound("header has no end")
    headers: dict[str, str] = {}
    for line in window[:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Unsound("header line without a name")
        headers[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    declared = headers.get("content-length", "")
    if not declared.isascii() or not declared.isdigit():
        raise Unsound("no content length")
    if not headers.get("warc-type") or not headers.get("warc-record-id"):
        raise Unsound("no type or id")
    start = at + stop + len(RECORD_END)
    end = start + int(declared)
    if end + len(RECORD_END) > len(data) or bytes(data[end : end + len(RECORD_END)]) != RECORD_END:
        raise Unsound("content length does not meet the record's end")
    block = bytes(data[start:end])
    _digest(headers.get("warc-block-digest"), block, "block")
    payload, http_length = block, None
    if headers.get("content-type", "").replace(" ", "").startswith("application/http"):
        head, end_of_head, payload = block.partition(RECORD_END)
        if not end_of_head:
            raise Unsound("HTTP header has no end")
        found = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
        http_length = int(found[1]) if found else None
    if headers["warc-type"] != "revisit":
        _digest(headers.get("warc-payload-digest"), payload, "payload")
    return headers | {"payload": payload, "http_length": http_length}, end + len(RECORD_END)


def _digest(stated: str | None, data: bytes, what: str) -> None:
    kind, _, value = (stated or "").partition(":")
    if kind.lower() == "sha1" and value.upper() != base32_sha1(data):
        raise Unsound(f"{what} digest differs")


def _consumed(data: memoryview, at: int, size: int) -> int:
    """The place up to which the member at ``at`` must be read for the first ``size`` bytes of its content."""
    unpacker, out, place = zlib.decompressobj(31), 0, at
    while True:
        before, chunk = unpacker.copy(), data[place : place + CHUNK]
        try:
            more = len(unpacker.decompress(chunk))
        except zlib.error:
            more = size
        if out + more >= size:
            break
        out, place = out + more, place + len(chunk)
    while out < size:
        out += len(before.decompress(data[place : place + 1]))
        place += 1
    return place


def _sound_records(content: bytes) -> tuple[list[dict], list[tuple[int, int, str]], int]:
    """All sound records of a member's content, the ranges between them with the check that failed, and the end of the
    last sound record."""
    records, gaps, place, reach = [], [], 0, 0
    while place < len(content):
        try:
            record, place = _record(content, place)
            records.append(record)
            reach = place
        except Unsound as fault:
            start, reason = place, str(fault)
            while True:
                found = VERSION.search(content, place + 1)
                place = found.start() if found else len(content)
                if not found:
                    break
                try:
                    _record(content, place)
                    break
                except Unsound:
                    continue
            gaps.append((start, place, reason))
    return records, gaps, reach


def _at(data: memoryview, at: int) -> tuple[list[dict], int, list[str]]:
    """The sound records of the member, or the plain record, at ``at``, the place after it, and what is wrong within.

    A member of which nothing is sound is unsound. After a fault in its compressed data the place is that where its last
    sound record ends.
    """
    if bytes(data[at : at + 3]) != MEMBER_START:
        record, end = _record(data, at)
        return [record], end, []
    content, end, fault = _member(data, at)
    records, gaps, reach = _sound_records(content)
    if not records and (fault or gaps):
        raise Unsound(fault or gaps[0][2])
    within = [f"{reason} (bytes {a} to {b} of the member's content)" for a, b, reason in gaps]
    if fault:
        end = _consumed(data, at, reach)
        within.append(f"{fault} (after {len(content)} bytes of content)")
    return records, end, within


def _next_sound(data: bytes, view: memoryview, place: int) -> int:
    """The next place after ``place`` with a sound record or with a member that holds one, else the end."""
    while (found := RECORD_START.search(data, place + 1)) is not None:
        place = found.start()
        try:
            if _at(view, place)[0]:
                return place
        except Unsound:
            continue
    return len(data)


def salvage(data: bytes) -> Iterator[tuple[int, int, list[dict] | str]]:
    """Go through an archive: ``(start, end, records)`` for what is sound, ``(start, end, reason)`` for a gap.

    Records out of a damaged member come with its range, which runs to the next sound place if its compressed data is
    damaged; each gap within its content follows with an empty range at its end, and its reason names the place.
    """
    view, at = memoryview(data), 0
    while at < len(data):
        try:
            records, end, within = _at(view, at)
        except Unsound as fault:
            place = _next_sound(data, view, at)
            yield at, place, str(fault)
            at = place
            continue
        if within and within[-1].startswith("member is"):
            end = _next_sound(data, view, end - 1)
        yield at, end, records
        for reason in within:
            yield end, end, reason
        at = end


def _read(spark: SparkSession, path: str, fields: str, rows) -> DataFrame:
    kinds = dict(f.strip().split(" ") for f in fields.split(","))

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=list(kinds)).astype({n: "Int64" for n, k in kinds.items() if k == "bigint"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                out, size = [], 0
                for part in salvage(content):
                    for row in rows(archive, *part):
                        out.append(row)
                        size += len(row[-1] or b"")
                    if size > 256 * CHUNK:
                        yield frame(out)
                        out, size = [], 0
                yield frame(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInPandas(run, fields)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every sound record of the archives below ``path``, with its place; an empty folder gives none."""

    def rows(archive, start, end, found):
        if isinstance(found, str):
            return
        for r in found:
            digest = (r.get("warc-payload-digest") or "").partition(":")[2].upper() or None
            yield (archive, start, end - start, r["warc-type"], r["warc-record-id"], r.get("warc-target-uri"),
                   r.get("warc-refers-to"), digest, r["http_length"], r["payload"])

    return _read(spark, path, RECORD_FIELDS, rows)


def read_gaps(spark: SparkSession, path: str) -> DataFrame:
    """The quarantined byte ranges of the archives below ``path``: start, end (exclusive) and the check that failed."""

    def rows(archive, start, end, found):
        if isinstance(found, str):
            yield archive, start, end, found

    return _read(spark, path, GAP_FIELDS, rows)


def archive_round_trip(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives below ``path`` and return what reading them back gives.

    A page without html has an empty payload. Pages with equal payloads revisit the one with the smallest page_id;
    rows repeated under that same page_id are responses too.
    """
    rows = pick(pages, ["page_id", "url", "html"]).select(
        F.col("page_id").alias("key"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    write_archives(with_first_copies(rows, min_revisit_bytes), path)
    return page_records(read_records(pages.sparkSession, path))


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of page records.

    Length and digest of a response are those of the payload that was read; a revisit states them in its headers.
    """

    def key(column: str):
        return F.regexp_extract(F.col(column), r"^<urn:x-page:(-?\d+)>$", 1).try_cast("bigint")

    revisit = F.col("record_type") == "revisit"
    return records.select(
        key("record_id").alias("page_id"),
        F.when(revisit, F.col("http_length")).otherwise(F.length("payload")).cast("bigint").alias("payload_bytes"),
        F.col("payload_digest"), "record_type",
        F.when(revisit, key("refers_to")).alias("refers_to"),
        F.element_at(F.split("archive", "/"), -1).alias("archive"), "offset", "length")


# Base 32 in SQL: five bits at a time out of two neighbouring hexadecimal digits.
ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS x,
    min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((
        (strpos('0123456789abcdef', substr(x, 1 + (5 * i // 4)::INT, 1)) - 1) * 16
        + strpos('0123456789abcdef', substr(x, 2 + (5 * i // 4)::INT, 1)) - 1) >> (3 - 5 * i % 4)::INT) & 31)::INT, 1)),
        '') AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
