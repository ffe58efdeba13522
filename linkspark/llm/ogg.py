"""Media columns in Ogg: packets, pages and logical streams in a binary column.

A payload of 8-bit samples is kept as one physical stream of two logical ones, both opened before either goes on: the
samples, and a stream with their length and digest. Reading verifies the checksum and number of every page, puts
packets together from lacing values, takes the logical streams apart, and derives times from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm.storage import materialize

#: Fixed values of the format.
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = (1 << 64) - 1
MAX_SEGMENTS = 255

RATE = 8000
PACKET = 4096
UNIT = 64
SAMPLES_HEAD, DIGEST_HEAD = b"\x01pcm8", b"\x01sums"

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """The format's CRC: polynomial 0x04C11DB7, first bit highest, from 0. zlib's runs over mirrored bits from ~0."""
    mirrored = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBQIIIB", CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


def pages_of(serial: int, packets: list[tuple[bytes, int]], first: int, last: bool) -> Iterator[bytes]:
    """Pages for (packet, granule position at its end), numbered from ``first``; a packet may go over pages."""
    lacing, parts, granule, number, continued = bytearray(), [], NO_GRANULE, first, False
    for packet, at in packets:
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        begin = 0
        while values:
            if len(lacing) == MAX_SEGMENTS:
                yield page(serial, number, granule, CONTINUED * continued, bytes(lacing), b"".join(parts))
                number += 1
                lacing, parts, granule, continued = bytearray(), [], NO_GRANULE, begin > 0
            room = values[: MAX_SEGMENTS - len(lacing)]
            lacing += room
            size = sum(room)
            parts.append(packet[begin : begin + size])
            begin += size
            values = values[len(room) :]
        granule = at
    if lacing or last:
        yield page(serial, number, granule, CONTINUED * continued | LAST * last, bytes(lacing), b"".join(parts))


def write_stream(payload: bytes) -> bytes:
    """The same payload always gives the same bytes; serials come from it."""
    serial = zlib.crc32(payload)
    other = serial ^ 0xFFFFFFFF
    out = [page(serial, 0, 0, FIRST, bytes([len(SAMPLES_HEAD) + 4]), SAMPLES_HEAD + struct.pack("<I", RATE)), page(other, 0, 0, FIRST, bytes([len(DIGEST_HEAD)]), DIGEST_HEAD)]
    cut = [(payload[k : k + PACKET], min(k + PACKET, len(payload))) for k in range(0, len(payload), PACKET)]
    samples = pages_of(serial, cut, 1, True)
    out.append(next(samples))
    out.extend(pages_of(other, [(struct.pack("<Q", len(payload)) + hashlib.sha256(payload).digest(), len(payload))], 1, True))
    out.extend(samples)
    return b"".join(out)


@dataclass
class Logical:
    """One logical stream: its packets, the granule position at the end of each page, and how many pages."""

    packets: list[bytes]
    granules: list[int]
    pages: int = 0
    open: bytes | None = None
    ended: bool = False


def read_stream(data: bytes) -> dict[int, Logical]:
    """Logical streams by serial, in the order in which they begin, or ValueError."""
    found: dict[int, Logical] = {}
    at = 0
    while at < len(data):
        if data[at : at + 4] != CAPTURE or len(data) < at + 27:
            raise ValueError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, n = struct.unpack_from("<4sBBQIIIB", data, at)
        lacing = data[at + 27 : at + 27 + n]
        body = at + 27 + n
        end = body + sum(lacing)
        if version or end > len(data) or len(lacing) < n:
            raise ValueError(f"the page at byte {at} is cut off or of version {version}")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"the page at byte {at} differs from its checksum")
        stream = found.get(serial)
        if bool(flags & FIRST) != (stream is None):
            raise ValueError(f"stream {serial} begins twice or not at all")
        stream = found.setdefault(serial, Logical([], []))
        if stream.ended or number != stream.pages or bool(flags & CONTINUED) != (stream.open is not None):
            raise ValueError(f"page {number} of stream {serial} is out of place")
        stream.pages += 1
        begin, size = body, 0
        for value in lacing:
            size += value
            if value < 255:
                stream.packets.append((stream.open or b"") + data[begin : begin + size])
                stream.open = None
                begin, size = begin + size, 0
        if size or (lacing and lacing[-1] == 255):
            stream.open = (stream.open or b"") + data[begin : begin + size]
        if granule != NO_GRANULE:
            stream.granules.append(granule)
        stream.ended = bool(flags & LAST)
        at = end
    if any(not s.ended or s.open is not None for s in found.values()):
        raise ValueError("a stream doesn't end")
    return found


def read_payload(data: bytes) -> tuple[bytes, dict[int, Logical]]:
    """The samples, held against the length and digest in the other stream, and all streams."""
    streams = read_stream(data)
    heads = {s.packets[0][:5]: s for s in streams.values()}
    samples, sums = heads[SAMPLES_HEAD], heads[DIGEST_HEAD]
    payload = b"".join(samples.packets[1:])
    if sums.packets[1] != struct.pack("<Q", len(payload)) + hashlib.sha256(payload).digest() or samples.granules[-1] != len(payload):
        raise ValueError("the samples differ from their length or digest")
    return payload, streams


def feature(payload: bytes, streams: dict[int, Logical]) -> str:
    """Streams, pages, packets, milliseconds at the end and after the first page of samples, and sample statistics."""
    samples = next(s for s in streams.values() if s.packets[0][:5] == SAMPLES_HEAD)
    rate = struct.unpack("<I", samples.packets[0][5:9])[0]
    ms = [g * 1000 // rate for g in samples.granules]
    x = np.frombuffer(payload, np.uint8)
    crossings = int(np.count_nonzero(np.diff((x >= 128).view(np.int8))))
    return f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={sum(len(s.packets) for s in streams.values())};first_ms={ms[1] if len(ms) > 1 else 0};ms={ms[-1]};sum={int(x.sum(dtype=np.int64))};peak={int(x.max(initial=0))};crossings={crossings}"


def padded(data: bytes) -> bytes:
    """Zeros up to a positive multiple of UNIT."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary) of every row; null is the empty text. Long texts take more packets and pages."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                data = [x or b"" for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, data), pa.int64()), pa.array([write_stream(padded(x)) for x in data], pa.binary())], [id_col, "n_bytes", "media"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def read_media(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the media column of (id, n_bytes, media) holds, by digests and features. A damaged stream raises."""
    rows = media.select(F.col(id_col), "n_bytes", "media")
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def look(data: bytes) -> tuple[int, str, int, int, str, str]:
        payload, streams = read_payload(data)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload, streams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [look(x.as_py()) for x in b.column(2)]
            columns = [pa.array(c, pa.string() if k in (1, 4, 5) else pa.int64()) for k, c in enumerate(zip(*seen, strict=True))] if seen else []
            if columns:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names)

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_media(materialize(encode_media(docs), "media"))
