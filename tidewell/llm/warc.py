"""WARC archives whose records are compressed one by one with a dictionary from the archive itself.

An archive starts with a skippable Zstandard frame that holds the (compressed) dictionary, trained on the
first records of the archive; every record is a frame of its own. Each task writes archives of
its own to the shared folder under new names and reports them when they are closed, so files of
lost or repeated attempts are in no manifest and are never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import fresh_folder, write_and_read
from tidewell.llm.files import open_store
from tidewell.operators.attach import attach
from tidewell.operators.sift import key_filter

#: Magic number of the skippable frame with the dictionary (fixed value of the format).
DICTIONARY_MAGIC = 0x184D2A5D
#: Most bytes of records that a dictionary is trained on, and its size.
SAMPLE_BYTES, DICTIONARY_BYTES = 4 << 20, 64 << 10
#: An archive is closed when its records, uncompressed, reach this many bytes.
ARCHIVE_BYTES = 1 << 30
DATE = "2026-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None, digest: str) -> str:
    """Record id that follows from page and payload, so a revisit can name a record that another task writes."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}:{digest}'.encode()).digest())}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, first_id: int | None, response: bool, date: str = DATE) -> bytes:
    """A response with its payload, or a revisit that refers to the response of ``first_id``."""
    digest = base32_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if response else http
    fields = [
        ("WARC-Type", "response" if response else "revisit"),
        ("WARC-Record-ID", record_uri(page_id, digest) if response else f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", len(payload)),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")))
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    if not response:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_uri(first_id, digest)), ("X-Refers-To-Page-ID", first_id)]
    fields.append(("Content-Length", len(block)))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one whole record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not one whole WARC record")
    return fields, rest[:size]


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of the samples; where they are too few to train on, their plain end serves as one."""
    if not samples:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        tail = b"".join(samples)[-DICTIONARY_BYTES:]
        return zstandard.ZstdCompressionDict(tail, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(tail) >= 8 else None


class ArchiveWriter:
    """Writes records to one open stream; the first ones are held back until the dictionary is trained."""

    def __init__(self, stream):
        self.stream, self.held, self.held_bytes, self.coder = stream, [], 0, None
        self.offset = self.records = self.raw = 0

    def add(self, record: bytes) -> None:
        self.records += 1
        self.raw += len(record)
        if self.coder:
            self._put(self.coder.compress(record))
            return
        self.held.append(record)
        self.held_bytes += len(record)
        if self.held_bytes >= SAMPLE_BYTES:
            self._start()

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.offset += len(data)

    def _start(self) -> None:
        dictionary = train(self.held)
        content = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes()) if dictionary else b""
        self._put(struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content)
        self.coder = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
        for record in self.held:
            self._put(self.coder.compress(record))
        self.held = []

    def close(self) -> None:
        if not self.coder:
            self._start()
        self.stream.close()


def read_archive(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one at a time, through the dictionary in its first frame."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not start with a dictionary frame")
    content = stream.read(size)
    dictionary = zstandard.ZstdCompressionDict(zstandard.decompress(content)) if content else None
    coder, data = zstandard.ZstdDecompressor(dict_data=dictionary), stream.read(chunk)
    while data:
        frame, parts = coder.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                break
            data = stream.read(chunk)
            if not data:
                raise ValueError("the archive ends within a record")
        yield b"".join(parts)
        data = frame.unused_data or stream.read(chunk)


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE
) -> DataFrame:
    """Write every row as a record into archives under ``folder``; returns their manifest (archive, records, raw_bytes, bytes).

    Of rows with equal payloads the one with the smallest page id is the response and the others revisit it. A null payload
    is empty, and empty payloads count as equal; a null id counts as larger than any other, and if a payload has only null ids
    all its rows are responses, as are repeated rows of the smallest id; a null url gives a record without target; other columns
    are not read; an empty table gives an empty manifest. Only payloads that repeat are shuffled, once; those of the most frequent digests spread over all tasks.
    """
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).cast("binary").alias("payload")
    ).withColumn("sha", F.sha1("payload"))
    many = rows.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    many = write_and_read(many, "payloads")
    # a filter over the digests that repeat: the payloads of all others are written where they are read
    sieve = key_filter(many, "sha")
    repeated, alone = (rows, None) if sieve is None else sieve.split(rows, "sha")
    known = attach(repeated, many, ["sha"], weight="n", keep_weight=True)
    response = F.col("n").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))
    ready = known.select("page_id", "url", "payload", "first_id", response.alias("response"))
    if alone is not None:
        ready = ready.union(alone.select("page_id", "url", "payload", F.lit(None).cast("bigint"), F.lit(True)))

    def write(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        part, writer, name = TaskContext.get().partitionId(), None, ""

        def closed() -> pa.RecordBatch:
            writer.close()
            values = {"archive": [name], "records": [writer.records], "raw_bytes": [writer.raw], "bytes": [writer.offset]}
            return pa.RecordBatch.from_pydict(values)

        for frame in frames:
            columns = [frame.column(i) for i in range(5)]
            for i in range(frame.num_rows):
                if writer is None:
                    name = f"{part:06d}-{uuid.uuid4().hex}.warc.zst"
                    writer = ArchiveWriter(store.open_output_stream(f"{path}/{name}"))
                page, target, payload, first, is_response = (c[i].as_py() for c in columns)
                writer.add(build_record(page, target, payload, first, is_response, date))
                if writer.raw >= ARCHIVE_BYTES:
                    yield closed()
                    writer = None
        if writer is not None:
            yield closed()

    return write_and_read(ready.mapInArrow(write, "archive string, records bigint, raw_bytes bigint, bytes bigint"), "manifest")


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives in the manifest; payloads are checked against their digests.

    ``with_payload`` adds url and payload (null for revisits).
    """
    extra = ", url string, payload binary" if with_payload else ""
    ddl = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string" + extra

    def records(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + ([pa.string(), pa.binary()] if with_payload else [])
        names = [x.split()[0] for x in ddl.split(", ")]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for frame in frames:
            for archive in frame.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{path}/{archive}") as stream:
                    for data in read_archive(stream):
                        fields, block = parse_record(data)
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload, size, kind = None, int(fields["X-Payload-Length"]), fields["WARC-Type"]
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if len(payload) != size or base32_digest(payload) != digest:
                                raise ValueError(f"record of page {fields.get('X-Page-ID')} does not match its digest")
                        page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                        row = (None if page is None else int(page), size, digest, kind, None if refers is None else int(refers), archive)
                        rows.append(row + ((fields.get("WARC-Target-URI"), payload) if with_payload else ()))
                        held += len(data) if with_payload else 100
                        if held >= 8 << 20:
                            yield table(rows)
                            rows, held = [], 0
                if rows:
                    yield table(rows)

    archives = manifest.select("archive")
    return archives.repartition(max(1, archives.count())).mapInArrow(records, ddl)


def archive_report(pages: DataFrame) -> DataFrame:
    """Write all pages to new archives and read the archives back."""
    folder = fresh_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder).drop("archive")
