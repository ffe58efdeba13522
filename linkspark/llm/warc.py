"""WARC 1.1 archives in Zstandard: a dictionary in the leading skippable frame, then one frame per record.

Spark's own text writer puts the frames into files: a row is an archive of some MB, and a file has one row. So archives
are written and read through any file system that Spark knows, a lost task only writes its own files again, and files
are small enough to be read whole; only a record that is larger by itself makes a larger one.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm.blocks import slices
from linkspark.llm.storage import materialize, small_batches
from linkspark.sources.storage import new_path

#: Fixed values of the formats: magic numbers of Zstandard frames and of the dictionary frame, and an empty frame.
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY_FRAME = b"\x5d\x2a\x4d\x18"
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Pages that the dictionary is trained on, the first ones of the table, and bytes of each; it changes sizes only, never content.
SAMPLE_PAGES = 200
SAMPLE_BYTES = 64 << 10
DICTIONARY_BYTES = 32 << 10
#: Compressed bytes in a row of a file, its dictionary counted; a larger record is a row of its own.
ARCHIVE_BYTES = 4 << 20
#: Rows that the reader gives at once, and bytes of payload.
READ_ROWS, READ_BYTES = 1024, 4 << 20
DATE = "2000-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def train(samples: list[bytes]) -> bytes:
    """A dictionary; where there is too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:] or VERSION + b"\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return DICTIONARY_FRAME + struct.pack("<I", len(dictionary)) + dictionary


def record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None, payload_digest: str | None = None) -> bytes:
    """One record: a response with its payload, or a revisit that keeps only the HTTP header and its length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{payload_digest or digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[2:2] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise ValueError(f"record id {urn!r}")
    name = urn[len("<urn:page:") : -1]
    return None if name == "null" else int(name)


def frames(data: memoryview) -> Iterator[tuple[bytes, memoryview]]:
    """(magic, frame) of each frame; skippable frames without their header."""
    at = 0
    while at < len(data):
        magic = bytes(data[at : at + 4])
        if magic == FRAME:
            end = _frame_end(data, at)
            yield magic, data[at:end]
        elif magic[1:] == DICTIONARY_FRAME[1:] and magic[0] >> 4 == 5:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
            yield magic, data[at + 8 : end]
        else:
            raise ValueError(f"no frame at byte {at}: {magic!r}")
        if end > len(data):
            raise ValueError(f"the frame at byte {at} is cut off")
        at = end


def _frame_end(data: memoryview, at: int) -> int:
    """The end of a frame, by its blocks' headers."""
    checksum = 4 * (data[at + 4] >> 2 & 1)
    at += zstandard.frame_header_size(data[at : at + 18])
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        if at + 3 > len(data):
            raise ValueError("a block is cut off")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + checksum


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record, or ValueError."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not found or first != VERSION:
        raise ValueError(f"not a record: {raw[:40]!r}")
    fields = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise ValueError(f"header line {line!r}")
        fields[name.strip().lower()] = value.strip()
    length = int(fields.get("content-length", -1))
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"a block of {len(rest) - 4} bytes, not {length}")
    block = rest[:length]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("the block differs from its digest")
    return fields, block


def http_payload(block: bytes) -> tuple[int, bytes]:
    """Content-Length of the HTTP header, and what follows it."""
    head, _, body = block.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.lower() == b"content-length":
            return int(value), body
    raise ValueError("no Content-Length")


def read_archive(data: bytes | pa.Buffer) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """(header fields, payload length, payload) of each record; the payload of a revisit is empty."""
    decoder, lead = None, True
    for magic, frame in frames(memoryview(data)):
        if magic == DICTIONARY_FRAME:
            kept = bytes(frame)
            kept = zstandard.ZstdDecompressor().decompress(kept) if kept[:4] == FRAME else kept
            decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(kept))
        elif magic == FRAME:
            if lead and decoder is None:
                raise ValueError("the archive doesn't begin with a dictionary")
            fields, block = parse(decoder.decompress(frame))
            length, body = http_payload(block)
            if fields["warc-type"] == "response":
                if len(body) != length or fields["warc-payload-digest"] != f"sha1:{digest(body)}":
                    raise ValueError(f"the payload of {fields['warc-record-id']} differs from its header")
            elif fields["warc-type"] != "revisit" or body:
                raise ValueError(f"a record of type {fields['warc-type']} with {len(body)} bytes")
            yield fields, length, body
        lead = False


def with_originals(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, revisit, refers_to): of rows with equal payloads the largest page_id is the original.

    Only digests that occur twice make the small side of the join, a written table, so that a payload which a third
    of all rows share is split by the join. Null html is the empty payload. Rows that share the largest id are all
    originals, so are rows without any id among equals; other rows without an id revisit.
    """
    key = F.unhex(F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    twice = pages.groupBy(key.alias("_key")).agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    joined = pages.select("page_id", "url", "html", key.alias("_key")).join(materialize(twice, "equal-payloads"), "_key", "left")
    revisit = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return joined.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("_last")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str) -> None:
    """A record for each row of (page_id long, url, html), in files below ``path``."""
    sample = [(r.html or "").encode() for r in pages.select(F.substring("html", 1, SAMPLE_BYTES // 4).alias("html")).limit(SAMPLE_PAGES).collect()]
    dictionary = train([x for x in sample if x])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        lead = dictionary_frame(dictionary)
        held, size = [lead], len(lead)

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])

        for batch in batches:
            for b in slices(batch):
                for page_id, url, html, revisit, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    frame = encoder.compress(record(page_id, url, (html or "").encode(), revisit, refers_to))
                    if size + len(frame) > ARCHIVE_BYTES and len(held) > 1:
                        yield flush()
                        held, size = [lead], len(lead)
                    held.append(frame)
                    size += len(frame)
        if len(held) > 1:
            yield flush()

    small_batches(pages.sparkSession)
    made = with_originals(pages).mapInArrow(write, "archive binary").select(F.col("archive").cast("string").alias("value"))
    made.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


def _rows_of(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(page_id, record_type, target_uri, payload_bytes, payload_digest, refers_to[, payload]) of every record.

    A frame, header, length or digest that doesn't hold raises ValueError.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows, size = [], 0
                for f, length, body in read_archive(data.as_buffer()):
                    revisit = f["warc-type"] == "revisit"
                    row = _page(f["warc-record-id"]), f["warc-type"], f["warc-target-uri"], length, f["warc-payload-digest"].removeprefix("sha1:"), _page(f["warc-refers-to"]) if revisit else None, body
                    rows.append(row[: len(names)])
                    size += len(body) * payloads
                    if len(rows) >= READ_ROWS or size >= READ_BYTES:
                        yield _rows_of(rows, names, types)
                        rows, size = [], 0
                if rows:
                    yield _rows_of(rows, names, types)

    names = ["page_id", "record_type", "target_uri", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * payloads
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * payloads
    schema = "page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(read, schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _base32_sql(text: str) -> str:
    """SHA-1 in bare base32: each five hex digits are four letters."""
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {0}) & 31) + 1, 1)"
    four = " || ".join(letter.format(k) for k in (15, 10, 5, 0))
    return f"array_to_string(list_transform(list_transform(range(8), lambda k: ('0x' || substr(sha1({text}), 5 * k + 1, 5))::INT), lambda v: {four}), '')"


ORACLE_SQL = f"""
WITH digested AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, {_base32_sql("coalesce(html, '')")} AS d FROM pages)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY d) AS last FROM digested)
"""
