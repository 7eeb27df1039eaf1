"""WARC archives in Zstandard form: one frame a record behind a dictionary in the leading skippable frame.

Archives are written by Spark's own text writer, so a lost task leaves no half file: each line is a whole frame,
and the line separator is an empty skippable frame, which every decoder passes over. Archives are read
with the ``binaryFile`` source, so any store that Spark reads will do. An archive holds a fixed number of records
at most; that bounds what one reading task has in memory at a time.

Defined cases: null payload is empty; null identifiers are written as an empty identifier and come back null;
a null address becomes about:blank; rows that repeat the least identifier of equal payloads are all responses;
an empty table gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alarmlake.llm.common import raw_text

# Magic numbers of the format (little-endian) and header names of the archive.
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY = b"\x37\xa4\x30\xec"
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
VERSION = b"WARC/1.1"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

EMPTY_FRAME = (0x184D2A50).to_bytes(4, "little") + bytes(4)
ID = "urn:page:"
MIN_REVISIT = 100
RECORDS = 4096
DICTIONARY_BYTES = 16 << 10
DICTIONARY_SAMPLES = 256
FIELDS = "archive string, offset long, warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


class ArchiveError(ValueError):
    pass


def _record(row: dict, date: str) -> bytes:
    """One record; the block of a revisit ends after the HTTP headers, which keep the full length."""
    payload, revisit = row["payload"], row["refers_to"] is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    key = "" if row["id"] is None else row["id"]
    heads = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{ID}{key}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(row["url"] or "about:blank", safe=":/?#[]@!$&'()*+,;=%~")),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if revisit:
        heads += [("WARC-Refers-To", f"<{ID}{row['refers_to']}>"), ("WARC-Profile", SAME_PAYLOAD)]
    heads += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in heads) + b"\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of the archive's first records; too few or too small ones get none."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, level=3)
    except zstandard.ZstdError:
        return None


def _frames(records: Iterator[bytes], limit: int) -> Iterator[bytes]:
    """Frames of one archive after another, each of ``limit`` frames."""
    while True:
        first = [r for _, r in zip(range(min(DICTIONARY_SAMPLES, limit - 1)), records)]
        if not first:
            return
        known = _dictionary(first)
        packer = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=True, write_content_size=True)
        body = known.as_bytes() if known else b""
        # An archive without a dictionary begins with an empty frame, so that all have the same number of frames.
        yield DICTIONARY_FRAME.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body if known else EMPTY_FRAME
        for r in first:
            yield packer.compress(r)
        for _, r in zip(range(limit - 1 - len(first)), records):
            yield packer.compress(r)


def _writer(limit: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (_record(row, date) for batch in batches for row in _rows(batch))
        held: list[bytes] = []
        size = 0
        for frame in _frames(records, limit):
            held.append(frame)
            size += len(frame)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])

    return write


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", records: int = RECORDS, date: str = "2024-01-01T00:00:00Z", min_revisit: int = MIN_REVISIT) -> None:
    """One record a row. Of equal payloads of ``min_revisit`` bytes or more, the least key is the response."""
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), raw_text(payload).alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"))
    repeated = rows.filter(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.min("id").alias("response"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.join(repeated, "digest", "left").select("id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"))
    frames = rows.mapInArrow(_writer(records, date), "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames.write.option("lineSep", EMPTY_FRAME.decode("latin-1")).option("maxRecordsPerFile", records).option("compression", "none").text(path)


def _frame_size(data: memoryview) -> int:
    """Bytes of the frame at the start of ``data``, by its block headers."""
    try:
        at, checked = zstandard.frame_header_size(data[:18]), zstandard.get_frame_parameters(data[:18]).has_checksum
    except zstandard.ZstdError as error:
        raise ArchiveError(f"frame header: {error}") from None
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if at > len(data):
            raise ArchiveError("cut frame")
        if head & 1:
            break
    at += 4 * checked
    if at > len(data):
        raise ArchiveError("cut frame")
    return at


def frames_of(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of every record frame, with the dictionary that leads the archive."""
    view, at = memoryview(data), 0
    reader = zstandard.ZstdDecompressor()
    while at < len(view):
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic in SKIPPABLE:
            size = int.from_bytes(view[at + 4 : at + 8], "little")
            if at + 8 + size > len(view):
                raise ArchiveError("cut skippable frame")
            if at == 0 and magic == DICTIONARY_FRAME:
                body = bytes(view[8 : 8 + size])
                if body[:4] == FRAME:  # the dictionary may be compressed itself
                    body = zstandard.ZstdDecompressor().decompress(body)
                if body[:4] != DICTIONARY:
                    raise ArchiveError("dictionary magic")
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            at += 8 + size
            continue
        if bytes(view[at : at + 4]) != FRAME:
            raise ArchiveError(f"no frame at {at}")
        size = _frame_size(view[at:])
        try:
            content = reader.decompressobj().decompress(bytes(view[at : at + size]))
        except zstandard.ZstdError as error:
            raise ArchiveError(f"frame at {at}: {error}") from None
        yield at, content
        at += size


def _heads(block: bytes, first: bytes) -> tuple[dict[str, str], bytes]:
    head, found, rest = block.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(first):
        raise ArchiveError(f"no {first.decode()} header")
    heads = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or name != name.strip() or not name:
            raise ArchiveError(f"header line {line[:40]!r}")
        heads[name.decode().lower()] = value.strip().decode()
    return heads, rest


def parse_record(content: bytes) -> dict:
    """Fields of one record; wrong headers, lengths or digests raise ArchiveError."""
    heads, rest = _heads(content, VERSION)
    for name in REQUIRED:
        if name.lower() not in heads:
            raise ArchiveError(f"no {name}")
    size = heads["content-length"]
    if not size.isascii() or not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError("Content-Length")
    block, kind = rest[:-4], heads["warc-type"]
    digest = heads.get("warc-payload-digest", "").removeprefix("sha256:")
    if heads.get("warc-block-digest", "") not in ("", f"sha256:{hashlib.sha256(block).hexdigest()}"):
        raise ArchiveError("block digest")
    http, payload = _heads(block, b"HTTP/")
    full = http.get("content-length", "")
    if not full.isascii() or not full.isdigit():
        raise ArchiveError("HTTP Content-Length")
    if kind == "response":
        if len(payload) != int(full) or hashlib.sha256(payload).hexdigest() != digest:
            raise ArchiveError("payload length or digest")
    elif kind != "revisit" or "warc-refers-to" not in heads or payload:
        raise ArchiveError(f"record type {kind!r}")
    return {"warc_type": kind, "record_id": heads["warc-record-id"], "target_uri": heads.get("warc-target-uri"), "refers_to": heads.get("warc-refers-to"), "payload_digest": digest, "payload_bytes": int(full), "payload": payload if kind == "response" else None}


def _reader(with_payload: bool):
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, held = batch.column(0)[i].as_py(), []
                for at, content in frames_of(batch.column(1)[i].as_py()):
                    try:
                        row = {"archive": path, "offset": at} | parse_record(content)
                    except ArchiveError as error:
                        raise ArchiveError(f"{path} at {at}: {error}") from None
                    held.append(row if with_payload else row | {"payload": None})
                    if len(held) == 512:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return read


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records under ``path``; a record that fails a check stops the job and names its archive and offset."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_reader(with_payload), FIELDS)


def key_of(name: str):
    """The identifier in a record name, null where it is empty."""
    return F.try_element_at(F.split(F.regexp_extract(name, f"^<{ID}(-?[0-9]+)>$", 1), ","), F.lit(1)).try_cast("long")
