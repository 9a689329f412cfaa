"""WARC archives as rows of bytes: a writer that replaces repeated payloads by revisits, and a reader that salvages damage."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import join_groups, stored, table

ARCHIVE_BYTES = 4 << 20
FEED = 1 << 15
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = "archive string, content binary"
ENTRIES = "archive string, kind string, first long, last long, reason string, record_id string, record_type string, target_uri string, payload binary, payload_bytes long, payload_digest string, refers_to string"


class Entry(NamedTuple):
    """A record, or a gap (kind "gap") of bytes [first, last) that no valid record covers."""

    kind: str
    first: int
    last: int
    reason: str | None = None
    record_id: str | None = None
    record_type: str | None = None
    target_uri: str | None = None
    payload: bytes | None = None
    payload_bytes: int | None = None
    payload_digest: str | None = None
    refers_to: str | None = None


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, name: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", DATE), *headers, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def page_record(name: str, url: str | None, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """A response, or a revisit of ``refers_to`` with the response's HTTP header only."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return _record("response", name, headers, http + payload)
    return _record("revisit", name, [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")], http)


def _parse(data: bytes) -> tuple[Entry | None, int, str]:
    """The record at the start of ``data``, the bytes it takes, or why there is none."""
    if not data.startswith(b"WARC/1."):
        return None, 0, "no version line"
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None, 0, "unended header"
    head: dict[str, str] = {}
    for line in data[:end].split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon or re.search(rb"[\x00-\x08\x0B-\x1F\x7F]", line):
            return None, 0, "bad header line"
        head[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
    if not re.fullmatch("[0-9]{1,18}", head.get("content-length", "")):
        return None, 0, "no length"
    start, size = end + 4, int(head["content-length"])
    block, stop = data[start : start + size], start + size + 4
    if len(block) < size or data[stop - 4 : stop] != b"\r\n\r\n":
        return None, 0, "cut short"
    digest = head.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != base32_sha1(block):
        return None, 0, "block digest differs"
    kind, payload, told = head.get("warc-type"), block, None
    if "application/http" in head.get("content-type", ""):
        http, _, payload = block.partition(b"\r\n\r\n")
        m = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", http)
        told = int(m[1]) if m else None
    full = kind != "revisit"
    stated = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if full and stated and stated != base32_sha1(payload):
        return None, 0, "payload digest differs"
    ids = lambda k: re.sub(r"^<urn:page:|>$", "", head[k]) if k in head else None
    return Entry("record", 0, 0, None, ids("warc-record-id"), kind, head.get("warc-target-uri"), payload if full else None, len(payload) if full else told, stated or (base32_sha1(payload) if full else None), ids("warc-refers-to")), stop, ""


def _at(content: bytes, pos: int) -> tuple[Entry | None, int, str]:
    """The record, compressed or not, at ``pos`` and where it ends."""
    if content[pos : pos + 2] != b"\x1f\x8b":
        end = content.find(b"\r\n\r\n", pos)
        m = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})", content[pos:end]) if end > 0 else None
        found, used, why = _parse(content[pos : end + 8 + int(m[1])] if m else content[pos : pos + 64])
        return found, pos + used, why
    z, at, got = zlib.decompressobj(31), pos, []
    try:
        while not z.eof and at < len(content):
            got.append(z.decompress(content[at : at + FEED]))
            at += FEED
    except zlib.error as e:
        return None, pos, f"bad member: {e}"
    if not z.eof:
        return None, pos, "cut member"
    data = b"".join(got)
    found, used, why = _parse(data)
    if found and data[used:].strip():
        found, why = None, "more than a record in a member"
    return found, min(at, len(content)) - len(z.unused_data), why


def salvage(content: bytes) -> Iterator[Entry]:
    """The records of an archive in order, with a gap entry for each range that had to be skipped.

    After a failed check the search goes on at the next gzip magic or version line, and later records are recovered. A
    damaged stretch is one gap, with the first reason. Empty content has neither.
    """
    pos, bad, reason = 0, None, ""
    while pos < len(content):
        found, end, why = _at(content, pos)
        if found:
            if bad is not None:
                yield Entry("gap", bad, pos, reason)
            bad = None
            yield found._replace(first=pos, last=end)
            pos = end
            continue
        if bad is None:
            bad, reason = pos, why
        ahead = [p for p in (content.find(b"\x1f\x8b\x08", pos + 1), content.find(b"WARC/1.", pos + 1)) if p > 0]
        pos = min(ahead, default=len(content))
    if bad is not None:
        yield Entry("gap", bad, len(content), reason)


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archives (name, bytes) with a record for each page, gzip member by member.

    Of equal payloads the page of least id is the response and the others revisit it; rows that repeat that id and payload are
    responses again. Null html is the empty payload and equal to it; a null id sorts first and is named "null". Pages of one
    digest may be any part of the table: large groups are spread over tasks. Columns besides the three are ignored.
    """
    raw = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).alias("page"), F.col(url).alias("url"), raw.alias("payload"), F.sha1(raw).alias("digest"))
    narrow = stored(rows.select("page", "digest"), "warc-digests")
    groups = narrow.groupBy("digest").agg(F.min(F.struct(F.col("page").isNotNull().alias("a"), F.col("page").alias("p"))).alias("b"), F.count("*").alias("n"))
    groups = groups.select("digest", F.coalesce(F.col("b.p").cast("string"), F.lit("null")).alias("least"), "n")
    ruled = join_groups(rows, groups, "digest", "n", narrow.count())
    name = F.coalesce(F.col("page").cast("string"), F.lit("null"))
    refers = F.when(name != F.col("least"), F.col("least"))
    ready = ruled.select(name.alias("name"), "url", F.octet_length("payload").cast("long").alias("size"), F.when(refers.isNull(), F.col("payload")).alias("payload"), "digest", refers.alias("refers"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for name, url, n, payload, digest, refers in batch.itertuples(index=False, name=None):
                base32 = base64.b32encode(bytes.fromhex(digest)).decode()
                held.append(_member(page_record(name, url, payload or b"", base32, n, refers)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pd.DataFrame({"archive": [f"part-{part:06d}-{number:04d}.warc.gz"], "content": [b"".join(held)]})
                    number, held, size = number + 1, [], 0
        if held:
            yield pd.DataFrame({"archive": [f"part-{part:06d}-{number:04d}.warc.gz"], "content": [b"".join(held)]})

    return ready.mapInPandas(write, ARCHIVES)


def read_archives(archives: DataFrame) -> DataFrame:
    """Records and quarantined gaps of archives given as (archive, content), such as the binaryFile source reads."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Entry._fields
        for batch in batches:
            for name, content in batch.itertuples(index=False, name=None):
                rows: list[Entry] = []
                size = 0
                for entry in salvage(bytes(content or b"")):
                    rows.append(entry)
                    size += len(entry.payload or b"")
                    if size > ARCHIVE_BYTES:
                        yield _frame(name, rows, names)
                        rows, size = [], 0
                if rows:
                    yield _frame(name, rows, names)

    return archives.select("archive", "content").mapInPandas(read, ENTRIES)


def _frame(archive: str, rows: list[Entry], names: tuple[str, ...]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=list(names))
    for c in ("first", "last", "payload_bytes"):
        out[c] = out[c].astype("Int64")
    out.insert(0, "archive", archive)
    return out


def op6_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record, digest and revisit of every page, read back from the written archives; null pages have an empty payload."""
    archives = stored(write_archives(table(spark, sf_dir, "pages")), "warc")
    found = read_archives(archives).where("kind = 'record'")
    number = lambda c: F.when(F.col(c) != "null", F.col(c)).cast("long")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // {0}) % 32 + 1, 1)"
_FOUR = " || ".join(_DIGIT.format(1 << s) for s in (15, 10, 5, 0))
ORACLE_OP6 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS vs, min(page_id) OVER (PARTITION BY h) AS least FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string(list_transform(vs, lambda v: {_FOUR}), '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to FROM d
"""
