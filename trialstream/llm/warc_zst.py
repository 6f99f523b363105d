"""WARC archives in Zstandard: writer, and a reader that validates them.

An archive starts with a skippable frame that holds the dictionary; then comes one frame for each
record. Archives are files of bounded size in a folder that all executors share; a task's
files have names of their own, and a manifest lists those of the tasks that ended well.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, ship, written

#: Fixed values of the formats: magic numbers of the dictionary's skippable frame and of a Zstandard frame, and the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
_END = b"\r\n\r\n"


class ArchiveError(ValueError):
    """An archive isn't as the format asks."""


@dataclass(frozen=True)
class ArchiveConfig:
    #: Payloads of at least so many bytes that are equal are stored once.
    min_bytes: int = 0
    #: Compressed size after which a task begins another archive.
    archive_bytes: int = 64 << 20
    #: Bounded sample for the dictionary: payloads, the bytes of each, and the dictionary's size.
    sample_rows: int = 300
    sample_bytes: int = 4096
    dictionary_bytes: int = 32 << 10
    level: int = 3


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_text(value: str) -> str:
    """value on one line; control characters and % are percent-encoded."""
    return re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, record_id: str, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{_header_text(record_id)}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_header_text(uri)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{_header_text(refers_to or '')}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"WARC-Block-Digest: sha1:{digest32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def info_record(name: str) -> bytes:
    block = f"software: trialstream\r\nformat: WARC File Format 1.1\r\n"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:archive:{name}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}".encode() + _END + block.encode() + _END


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record; an ArchiveError if its version, headers, length, end or digests are wrong."""
    head, found, rest = data.partition(_END)
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ArchiveError("no WARC version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ArchiveError(f"a header line without a name: {line[:80]!r}")
        headers[name.strip()] = value.strip()
    missing = [h for h in MANDATORY if h not in headers]
    if missing:
        raise ArchiveError(f"missing headers: {', '.join(missing)}")
    if not headers["Content-Length"].isdigit():
        raise ArchiveError("Content-Length isn't a number")
    length = int(headers["Content-Length"])
    if len(rest) != length + len(_END) or rest[length:] != _END:
        raise ArchiveError(f"a block of {len(rest) - len(_END)} bytes where Content-Length says {length}")
    block = rest[:length]
    if "WARC-Block-Digest" in headers and headers["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
        raise ArchiveError("the block's digest is another")
    return headers, block


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a binary stream, one after the other; only one is held."""
    import zstandard

    def need(n: int) -> bytes:
        data = source.read(n)
        if len(data) != n:
            raise ArchiveError("the archive ends within its dictionary")
        return bytes(data)

    magic, size = struct.unpack("<II", need(8))
    if magic != DICTIONARY_MAGIC:
        raise ArchiveError("the first frame isn't a dictionary's")
    raw = need(size)
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 26)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    rest, number = b"", 0
    while True:
        rest = rest or bytes(source.read(1 << 20))
        if not rest:
            return
        frame, parts = reader.decompressobj(), []
        try:
            while True:
                parts.append(frame.decompress(rest))
                rest = frame.unused_data
                if frame.eof:
                    break
                rest = bytes(source.read(1 << 20))
                if not rest:
                    raise ArchiveError("the archive ends within a frame")
            yield parse_record(b"".join(parts))
        except (zstandard.ZstdError, ArchiveError) as error:
            raise ArchiveError(f"record {number}: {error}") from error
        number += 1


class ArchiveWriter:
    """Writes one archive: the dictionary, then a frame for each record."""

    def __init__(self, sink, dictionary: bytes, name: str, level: int = 3):
        import zstandard

        self.sink = sink
        own = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True, **own)
        self.size = 0
        self._put(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
        self.add(info_record(name))

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.packer.compress(data))


def open_path(path: str, mode: str):
    """A binary stream of a path or URI of any store that pyarrow knows; mode is r or w."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    if mode == "w":
        store.create_dir(place.rpartition("/")[0], recursive=True)
        return store.open_output_stream(place)
    return store.open_input_stream(place)


def make_dictionary(pages: DataFrame, html_column: str, config: ArchiveConfig) -> bytes:
    """A dictionary from a bounded sample of payloads, chosen by hash; empty if there's too little to learn from."""
    import zstandard

    payload = F.col(html_column).cast("string")
    rows = pages.where(payload.isNotNull()).select(F.xxhash64(payload).alias("h"), F.substring(payload, 1, config.sample_bytes).alias("p")).orderBy("h").limit(config.sample_rows).collect()
    samples = [record("response", str(i), "http://example.com/", r["p"].encode(), None) for i, r in enumerate(rows)]
    try:
        return zstandard.train_dictionary(config.dictionary_bytes, samples).as_bytes()
    except (zstandard.ZstdError, ValueError, MemoryError):
        return b"".join(samples)[: config.dictionary_bytes]


def write_archives(pages: DataFrame, where: str, config: ArchiveConfig = ArchiveConfig(), *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Write a record for every row of pages under the folder where; returns the manifest (path, records, bytes).

    Of rows with equal payloads the one with the smallest id is the response, the others revisit it; rows that share that
    id are all responses. A null payload counts as empty. A row with a null id revisits a row with one, or else is a response.
    """
    ship(pages.sparkSession)
    dictionary = make_dictionary(pages, html_column, config)
    payload = F.coalesce(F.col(html_column).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    ids = pages.select(F.col(id_column).alias("id"), F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).alias("size"))
    firsts = ids.where(F.col("size") >= config.min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    marked = rows.join(firsts, "digest", "left").select(F.col("id").cast("string").alias("id"), "url", "payload", F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first").cast("string")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = sink = None
        done: list[tuple[str, int, int]] = []
        path, count = "", 0
        for batch in batches:
            for id_, url, data, first in zip(*batch.columns, strict=True):
                if writer is None:
                    name = uuid.uuid4().hex
                    path, count = f"{where}/{name}.warc.zst", 0
                    sink = open_path(path, "w")
                    writer = ArchiveWriter(sink, dictionary, name, config.level)
                refers = first.as_py()
                writer.add(record("response" if refers is None else "revisit", "" if not id_.is_valid else id_.as_py(), url.as_py(), data.as_py(), refers))
                count += 1
                if writer.size >= config.archive_bytes:
                    sink.close()
                    done.append((path, count, writer.size))
                    writer = None
        if writer is not None:
            sink.close()
            done.append((path, count, writer.size))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "records", "bytes"])

    return written(marked.mapInArrow(run, "path string, records bigint, bytes bigint"), "manifest")


_PAGE = re.compile(r"<urn:page:(.*)>")
_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)\r\n")


def _unquoted(value: str) -> str:
    from urllib.parse import unquote

    return unquote(value)


def read_archives(manifest: DataFrame, id_type: str = "bigint", *, payload: bool = False) -> DataFrame:
    """Records of the archives whose paths the manifest lists: page_id, target_uri, payload_bytes, payload_digest,
    record_type, refers_to, and payload (null for revisits) if asked for. warcinfo records are left out.

    Each archive is read as a stream by one task, record by record. A damaged one fails with an ArchiveError.
    """
    ship(manifest.sparkSession)
    schema = "page_id string, target_uri string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + ", payload binary" * payload

    def rows(path: str) -> Iterator[tuple]:
        with open_path(path, "r") as source:
            try:
                for headers, block in read_archive(source):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    head, _, body = block.partition(_END)
                    size = _LENGTH.search(head + b"\r\n")
                    digest = headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                    kind = headers["WARC-Type"]
                    if size is None or kind not in ("response", "revisit"):
                        raise ArchiveError(f"{headers['WARC-Record-ID']}: neither a response nor a revisit with a length")
                    if kind == "response" and (len(body) != int(size[1]) or digest32(body) != digest):
                        raise ArchiveError(f"{headers['WARC-Record-ID']}: the payload isn't the one that its headers describe")
                    own = _PAGE.fullmatch(headers["WARC-Record-ID"])
                    other = _PAGE.fullmatch(headers.get("WARC-Refers-To", ""))
                    uri = headers.get("WARC-Target-URI")
                    out = (_unquoted(own[1]) or None if own else None, None if uri is None else _unquoted(uri), int(size[1]), digest, kind, _unquoted(other[1]) if other else None)
                    yield (*out, body if kind == "response" else None) if payload else out
            except ArchiveError as error:
                raise ArchiveError(f"{path}: {error}") from error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * payload
        names = ["page_id", "target_uri", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held: list[tuple] = []
                size = 0
                for row in rows(path):
                    held.append(row)
                    size += 500 + (row[2] if payload else 0)
                    if size > 16_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = manifest.select("path").repartition(n).mapInArrow(run, schema)
    return out.withColumns({"page_id": F.col("page_id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})


def archive_round_trip(pages: DataFrame, config: ArchiveConfig = ArchiveConfig(), *, id_column: str = "page_id", **columns: str) -> DataFrame:
    """Write every row of pages into archives in the shared folder and read them back, validated."""
    manifest = write_archives(pages, scratch(pages.sparkSession, "warc"), config, id_column=id_column, **columns)
    return read_archives(manifest, pages.schema[id_column].dataType.simpleString())
