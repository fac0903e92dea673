"""WARC archives compressed with Zstandard: one dictionary per file, one frame per record."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wagerframe.llm.registry import query, table
from wagerframe.llm.shared import bounded_batches, save, shared_folder

# Fixed values of the formats.
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
TOKEN = re.compile(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
RECORD_ID = re.compile(r"<urn:page:(-?\d*)>")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(fields: Iterable[tuple[str, str]], block: bytes) -> bytes:
    """A record; characters that would end a header line are percent-encoded."""
    lines = [VERSION]
    for name, value in fields:
        lines.append(f"{name}: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value))
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""])
    return head.encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response holding the payload, or a revisit that holds its HTTP header only."""
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", date),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url))
    if refers_to is None:
        return record_bytes(fields, http + payload)
    return record_bytes([*fields, ("WARC-Refers-To", name(refers_to)), ("WARC-Profile", REVISIT_PROFILE)], http)


def train(samples: list[bytes], size: int) -> bytes:
    """A dictionary from the first records; where they are too few, the first of them serves as it is."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return next((s[:size] for s in samples if len(s) >= 8), b"")


class ArchiveWriter:
    """Writes one archive: a skippable frame with the dictionary, then a frame per record."""

    def __init__(self, out: BinaryIO, dictionary: bytes, level: int):
        self.out, self.bytes, self.records = out, 0, 0
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True)
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.compressor.compress(record))
        self.records += 1


def read_frames(source: BinaryIO, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The content of every frame. Reads ``chunk`` bytes at a time; memory is one record's."""
    pending = source.read(8)
    if len(pending) < 8:
        raise ValueError("archive ends before its first frame")
    magic, length = struct.unpack("<II", pending)
    dictionary = None
    if magic == DICTIONARY_FRAME:
        content = source.read(length)
        if len(content) < length:
            raise ValueError("archive ends inside its dictionary")
        if content[:4] == ZSTD_MAGIC:
            content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
        if content:
            dictionary = zstandard.ZstdCompressionDict(content)
        pending = b""
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        while len(pending) < 8 and (more := source.read(chunk)):
            pending += more
        if not pending:
            return
        if len(pending) >= 8 and struct.unpack("<I", pending[:4])[0] in SKIPPABLE:
            left = struct.unpack("<I", pending[4:8])[0] + 8
            while len(pending) < left and (more := source.read(chunk)):
                pending += more
            if len(pending) < left:
                raise ValueError("archive ends inside a skippable frame")
            pending = pending[left:]
            continue
        frame = decompressor.decompressobj()
        parts = [frame.decompress(pending)]
        while not frame.eof:
            more = source.read(chunk)
            if not more:
                raise ValueError("archive ends inside a record's frame")
            parts.append(frame.decompress(more))
        pending = frame.unused_data
        yield b"".join(parts)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; the frame must hold exactly that record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("record without an end of its headers")
    version, *lines = head.decode("utf-8").split("\r\n")
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"unknown version {version[:20]!r}")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not TOKEN.fullmatch(name):
            raise ValueError(f"malformed header {line[:60]!r}")
        if name.lower() in fields:
            raise ValueError(f"repeated header {name[:40]!r}")
        fields[name.lower()] = value.strip()
    for name in REQUIRED:
        if name.lower() not in fields:
            raise ValueError(f"missing header {name}")
    length = fields["content-length"]
    if not length.isascii() or not length.isdigit():
        raise ValueError(f"Content-Length {length[:20]!r} is not a number")
    if len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes where Content-Length says {length}")
    return fields, rest[:-4]


def page_of(fields: dict[str, str], block: bytes) -> dict:
    """The page of a response or revisit record, its lengths and digests checked."""
    kind = fields["warc-type"]
    http, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("block without an end of its HTTP header")
    sizes = re.findall(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", http)
    if len(sizes) != 1:
        raise ValueError("HTTP header without one Content-Length")
    size, digest = int(sizes[0]), fields.get("warc-payload-digest", "")
    if not re.fullmatch(r"sha1:[A-Z2-7]{32}", digest):
        raise ValueError(f"payload digest {digest[:50]!r} is not a base32 SHA-1")
    if kind == "response":
        if len(payload) != size:
            raise ValueError(f"payload of {len(payload)} bytes where HTTP says {size}")
        if base32_sha1(payload) != digest[5:]:
            raise ValueError("payload does not have its digest")
    elif payload:
        raise ValueError("revisit with a payload")

    def number(name: str) -> int | None:
        match = RECORD_ID.fullmatch(fields.get(name, ""))
        if match is None:
            raise ValueError(f"{name} is not a page's")
        return int(match[1]) if match[1] else None

    return {
        "page_id": number("warc-record-id"),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": number("warc-refers-to") if kind == "revisit" else None,
        "payload_bytes": size,
        "payload_digest": digest[5:],
        "payload": payload if kind == "response" else None,
    }


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, sha1, refers_to``: of equal payloads of ``min_bytes`` or more the smallest id is referred to.

    Digests are grouped before the payloads move, so a payload that a third of the
    pages share costs one row per task there; the join back splits such a key.
    Rows that share the smallest id all hold the payload, as do rows of groups in
    which every id is null.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    hashed = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha1"))
    shared = (
        hashed.filter(F.octet_length("payload") >= min_bytes)
        .groupBy("sha1")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("sha1", "first")
    )
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    return hashed.join(shared, "sha1", "left").select(
        "page_id", "url", "payload", "sha1", F.when(F.col("first").isNotNull() & other, F.col("first")).alias("refers_to")
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    archive_bytes: int = 64 << 20,
    dictionary_bytes: int = 16 << 10,
    samples: int = 200,
    level: int = 3,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write the rows of ``mark_revisits`` as archives below ``folder``; returns the manifest (path, records, bytes).

    A task writes archives of about ``archive_bytes``, each with a dictionary made
    from its first ``samples`` records. File names are unique to the attempt and
    the manifest is committed by Spark, so archives of lost or repeated attempts
    are never read. ``folder`` is a URI that pyarrow can open on every executor.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as files

        store, root = files.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done: list[dict] = []
        waiting: list[bytes] = []
        waiting_bytes = 0
        writer = None

        def open_archive() -> None:
            nonlocal writer, waiting_bytes
            path = f"{root}/{uuid.uuid4().hex}.warc.zst"
            writer = ArchiveWriter(store.open_output_stream(path), train(waiting, dictionary_bytes), level)
            writer.path = path
            writer.add(record_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date)], b""))
            for record in waiting:
                writer.add(record)
            waiting.clear()
            waiting_bytes = 0

        def close_archive() -> None:
            nonlocal writer
            writer.out.close()
            done.append({"path": writer.path, "records": writer.records, "bytes": writer.bytes})
            writer = None

        for batch in batches:
            for row in batch.to_pylist():
                digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                record = page_record(row["page_id"], row["url"], row["payload"], digest, row["refers_to"], date)
                if writer is None:
                    waiting.append(record)
                    waiting_bytes += len(record)
                    if len(waiting) >= samples or waiting_bytes >= 100 * dictionary_bytes:
                        open_archive()
                else:
                    writer.add(record)
                if writer is not None and writer.bytes >= archive_bytes:
                    close_archive()
        if waiting:
            open_archive()
        if writer is not None:
            close_archive()
        schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
        yield pa.RecordBatch.from_pylist(done, schema=schema)

    bounded_batches(pages.sparkSession)
    return save(pages.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


PAGE = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False, strict: bool = True) -> DataFrame:
    """The pages in the archives of ``manifest`` (path), one row per response or revisit record.

    Archives are spread over tasks by path and decoded frame by frame. A record
    that breaks the format stops the job with its archive and number; with
    ``strict`` off it becomes a row with only ``problem`` set (always null
    otherwise), and reading goes on with the next frame, if there is one.
    """
    schema = PAGE + (", payload binary" if payloads else "") + ", problem string"
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields_out = pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as files

        store, _ = files.FileSystem.from_uri(folder)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held, at = [], 0, 0

                def fail(error: Exception, path=path, rows=rows):
                    if strict:
                        raise ValueError(f"{path}, record {at}: {error}") from error
                    rows.append({"problem": f"{path}, record {at}: {error}"})

                with store.open_input_stream(path) as source:
                    frames = read_frames(source)
                    while True:
                        try:
                            data = next(frames)
                        except StopIteration:
                            break
                        except (ValueError, zstandard.ZstdError) as error:
                            fail(error)
                            break
                        try:
                            fields, block = parse_record(data)
                            if fields["warc-type"] in ("response", "revisit"):
                                rows.append(page_of(fields, block))
                        except ValueError as error:
                            fail(error)
                        at += 1
                        held += len(data)
                        if len(rows) >= 5000 or held >= 32 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=fields_out)
                            rows.clear()
                            held = 0
                yield pa.RecordBatch.from_pylist(rows, schema=fields_out)

    partitions = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(partitions, "path").mapInArrow(read, schema)


def archive_pages(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) and read the archives back.

    A null html is an empty payload, a null url gives no target, a null page_id an
    empty record id that reads back as null; repeated rows are records each; no
    rows give no archives and no rows. A very long payload is one record of its full
    length. Other columns are not read.
    """
    return read_archives(write_archives(mark_revisits(pages, min_bytes), folder), folder)


@query("op1_warc")
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = archive_pages(table(spark, folder, "pages"), shared_folder(spark, "warc"))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
