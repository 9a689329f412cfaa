"""Matroska media columns: documents stored as 8-bit audio samples, and packet tables parsed from the stored bytes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import table

FRAME = 576
RATE = 8000
FRAME_MS = FRAME * 1000 // RATE
LACED = 8
BLOCKS = 8

# Fixed values of the format: element identifiers.
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}

PACKET = "track int, cluster int, block int, lace int, timestamp_ms long, keyframe boolean, cued boolean, first long, size long"


class Packet(NamedTuple):
    track: int
    cluster: int
    block: int
    lace: int
    timestamp_ms: int
    keyframe: bool
    cued: bool
    first: int
    size: int


def _size(n: int) -> bytes:
    """A size as a variable-length integer of as few bytes as hold it."""
    width = 1
    while n >= (1 << (7 * width)) - 1:
        width += 1
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def _element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


HEAD = _element(EBML, _element(DOC_TYPE, b"matroska"))
TRACK = _element(
    TRACKS,
    _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(DEFAULT_DURATION, FRAME_MS * 1_000_000) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _element(AUDIO, _element(SAMPLING, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))),
)


def lace_frames(frames: list[bytes], kind: int) -> bytes:
    """Frames after a block's header; kind: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if kind == 0:
        return frames[0]
    out, sizes = [bytes([len(frames) - 1])], [len(f) for f in frames]
    if kind == 1:
        out += [b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1]]
    elif kind == 3:
        out.append(_size(sizes[0]))
        for a, b in zip(sizes, sizes[1:-1]):
            width = 1
            while abs(b - a) > (1 << (7 * width - 1)) - 1:
                width += 1
            out.append(((b - a) + (1 << (7 * width - 1)) - 1 | 1 << (7 * width)).to_bytes(width, "big"))
    return b"".join(out + frames)


def write_media(payload: bytes, lacing: int = 2) -> bytes:
    """A Matroska file of one 8-bit PCM track: frames of 576 samples, laced by 8 in blocks, 8 blocks in a cluster, with cues."""
    count = len(payload) // FRAME
    info = _element(INFO, _uint(SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", count * FRAME_MS)))
    body, cues, at = [info, TRACK], [], len(info) + len(TRACK)
    for c in range(0, count, LACED * BLOCKS):
        inside = [_uint(TIMESTAMP, c * FRAME_MS)]
        for b in range(c, min(count, c + LACED * BLOCKS), LACED):
            last = min(count, b + LACED)
            kind = lacing if last - b > 1 else 0
            head = b"\x81" + struct.pack(">hB", (b - c) * FRAME_MS, 0x80 | kind << 1)
            frames = [payload[b * FRAME : last * FRAME]] if kind == 2 else [payload[i * FRAME : i * FRAME + FRAME] for i in range(b, last)]
            data = bytes([last - b - 1]) + frames[0] if kind == 2 else lace_frames(frames, kind)
            inside.append(_element(SIMPLE_BLOCK, head + data))
        cluster = _element(CLUSTER, b"".join(inside))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, c * FRAME_MS) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(_element(CUES, b"".join(cues)))
    return HEAD + _element(SEGMENT, b"".join(body))


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """A variable-length integer, where it ends, and whether all its bits are ones (an unknown size)."""
    first = data[at]
    if not first:
        raise ValueError(f"integer of more than 8 bytes at {at}")
    width = 9 - first.bit_length()
    end = at + width
    if end > len(data):
        raise ValueError(f"cut integer at {at}")
    value = int.from_bytes(data[at:end], "big")
    plain = value & ((1 << (7 * width)) - 1)
    return (value if keep_marker else plain), end, plain == (1 << (7 * width)) - 1


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(identifier, start of the element, of its body, end), masters before what they hold; an unknown size lasts to ``end``."""
    stack = [(at, end)]
    while stack:
        at, end = stack.pop()
        if at >= end:
            continue
        ident, body, _ = read_vint(data, at, keep_marker=True)
        n, body, unknown = read_vint(data, body)
        stop = end if unknown else body + n
        if stop > end:
            raise ValueError(f"element {ident:x} at {at} goes beyond its parent")
        stack.append((stop, end))
        if ident in MASTERS:
            stack.append((body, stop))
        yield ident, at, body, stop


def _laces(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(start, size) of each frame of a block."""
    if kind == 0:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 1:
        while len(sizes) < count - 1:
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    elif kind == 3 and count > 1:
        n, at, _ = read_vint(data, at)
        sizes.append(n)
        while len(sizes) < count - 1:
            width = 9 - data[at].bit_length()
            step, at, _ = read_vint(data, at)
            sizes.append(sizes[-1] + step - ((1 << (7 * width - 1)) - 1))
    elif kind == 2:
        if (end - at) % count:
            raise ValueError("fixed lacing doesn't divide the block")
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing beyond the block")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return out


def parse_packets(data: bytes) -> list[Packet]:
    """The packet table of a file. Cues tell which clusters they point at; cues that point at no cluster are an error."""
    found, cued, starts = [], set(), []
    scale, segment, cluster, base, block, frame_ms = 1_000_000, 0, -1, 0, 0, {}
    track = 0
    for ident, start, body, stop in elements(data, 0, len(data)):
        if ident == SEGMENT:
            segment = body
        elif ident == SCALE:
            scale = int.from_bytes(data[body:stop], "big")
        elif ident == TRACK_NUMBER:
            track = int.from_bytes(data[body:stop], "big")
        elif ident == DEFAULT_DURATION:
            frame_ms[track] = int.from_bytes(data[body:stop], "big") // 1_000_000
        elif ident == CLUSTER:
            cluster, block = cluster + 1, 0
            starts.append(start - segment)
        elif ident == TIMESTAMP:
            base = int.from_bytes(data[body:stop], "big")
        elif ident in (SIMPLE_BLOCK, BLOCK):
            number, at, _ = read_vint(data, body)
            offset, flags = struct.unpack_from(">hB", data, at)
            begun = (base + offset) * scale // 1_000_000
            step = frame_ms.get(number, 0)
            for i, (first, size) in enumerate(_laces(data, at + 3, stop, flags >> 1 & 3)):
                found.append((number, cluster, block, i, begun + i * step, ident == SIMPLE_BLOCK and flags >= 128, first, size))
            block += 1
        elif ident == CUE_CLUSTER:
            cued.add(int.from_bytes(data[body:stop], "big"))
    if cued - set(starts):
        raise ValueError("cue without a cluster")
    return [Packet(*x[:6], starts[x[1]] in cued, *x[6:]) for x in found]


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


def media_column(text: Column) -> Column:
    """Texts (null: empty) stored as media, each padded with bytes 255 to a positive multiple of 576."""

    @F.pandas_udf("binary")
    def store(texts: pd.Series) -> pd.Series:
        return pd.Series([write_media(padded(t)[1]) for t in texts], dtype=object)

    return store(text)


def packet_table(media: DataFrame, key: str, column: str = "media") -> DataFrame:
    """A row for each packet of each media value; a null value has none."""

    @F.pandas_udf(f"array<struct<{', '.join(x.replace(' ', ': ') for x in PACKET.split(', '))}>>")
    def parse(values: pd.Series) -> pd.Series:
        return pd.Series([[p._asdict() for p in parse_packets(v)] if v is not None else [] for v in values])

    return media.select(F.col(key), F.explode(parse(F.col(column))).alias("p")).select(key, "p.*")


READ_BACK = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(media: Column) -> Column:
    """Digests and the feature of what the packets' byte ranges hold, read from the stored bytes; null for null."""

    @F.pandas_udf(READ_BACK)
    def read(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            if v is None:
                out.append((None,) * 6)
                continue
            packets = parse_packets(v)
            payload = b"".join([v[p.first : p.first + p.size] for p in packets])
            samples = np.frombuffer(payload, np.uint8)
            feature = f"packets={len(packets)} clusters={packets[-1].cluster + 1 if packets else 0} end_ms={packets[-1].timestamp_ms + FRAME_MS if packets else 0} sum={int(samples.sum(dtype=np.int64))} peak={int(samples.max(initial=0))}"
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(v), hashlib.sha256(v).hexdigest(), feature))
        return pd.DataFrame(out, columns=[x.split()[0] for x in READ_BACK.split(", ")])

    return read(media)


def documents_as_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document with the digests of its payload read back. Null and empty texts are one frame of 255s; repeated rows
    give repeated rows, and other columns are ignored."""
    whole = F.coalesce(F.col(text), F.lit(""))
    made = docs.select(F.col(key), F.octet_length(whole).cast("long").alias("n_bytes"), read_back(media_column(whole)).alias("r"))
    return made.select(key, "n_bytes", "r.*")


def op3_matroska_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, payload and stored form of every document as packets, read back from the stored bytes; null texts are empty."""
    return documents_as_media(table(spark, sf_dir, "documents"))
