"""WARC archives as a chunked record table.

Writing: every task streams its records into gzip members of one archive at a time, payloads in slices.
The rows that come back name each record's file and place, so archives of failed attempts are never read.

Reading: a record is a run of rows (record, chunk number, chunk) with the digest of the payload so far, so
that no payload is held whole; the last row of a record has the digest of all of it.

A payload that is written is a value of its row, which Spark holds whole; beyond that, memory is bounded by
the chunk size on both ways.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import bit_words, flagged, joined
from .scratch import new_path, written

CHUNK_BYTES = 1 << 20
ARCHIVE_BYTES = 1 << 28
#: Bytes of archives that one task reads back, about.
READ_BYTES = 1 << 24
#: Payloads below this are never replaced by a revisit.
LEAST_REVISIT_BYTES = 1000
MANIFEST = "archive string, offset long, length long, page_id long"
CHUNKS = "archive string, offset long, page_id long, record_type string, refers_to long, url string, chunk long, bytes_so_far long, sha1_so_far string, payload_bytes long, payload_digest string, is_last boolean, data binary"


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    number = re.fullmatch(r"<urn:x-page:(-?[0-9]{1,19})>", name or "")
    return int(number[1]) if number else None


def with_revisits(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with payload_bytes, payload_digest and refers_to (null for a response).

    Of records with equal payloads of LEAST_REVISIT_BYTES or more, that with the largest page_id is the
    response.  Payloads are equal if length and SHA-1 are.  Rows whose page_id is null, or that repeat
    the largest page_id, are responses.  Only rows whose digest may occur again are shuffled, and not those
    of the largest groups of copies.
    """
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"))
    keys = ["payload_bytes", "payload_digest"]
    facts = pages.where(F.col("payload_bytes") >= LEAST_REVISIT_BYTES).groupBy(*keys).agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    keepers = written(facts.where("n > 1"), "keepers")
    again = written(bit_words(keepers, F.xxhash64(*keys)), "digests")
    out = joined(flagged(pages, F.xxhash64(*keys), again, "again"), keepers, keys, "n", F.col("again"))
    refers_to = F.when(F.col("page_id") != F.col("keeper"), F.col("keeper"))
    return out.select("page_id", "url", "html", *keys, refers_to.alias("refers_to"))


def _header(page_id, url, n, digest, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {' '.join((url or '').split())}", "Content-Type: application/http; msgtype=response"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Length: {n}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"Content-Length: {len(http) + (n if refers_to is None else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


class _Archive:
    def __init__(self, folder: str):
        self.name = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
        self.files, path = fs.FileSystem.from_uri(self.name)
        self.files.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.size = self.files.open_output_stream(path, compression=None), 0

    def add(self, header: bytes, payload: memoryview) -> tuple[int, int]:
        gz, start = zlib.compressobj(1, wbits=31), self.size
        for part in (header, *(payload[i : i + CHUNK_BYTES] for i in range(0, len(payload), CHUNK_BYTES)), b"\r\n\r\n"):
            self._put(gz.compress(part))
        self._put(gz.flush())
        return start, self.size - start

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            rows = []
            page, url, n, digest, refers = (batch.column(i).to_pylist() for i in range(5))
            for i in range(batch.num_rows):
                if archive is None or archive.size > ARCHIVE_BYTES:
                    if archive is not None:
                        archive.out.close()
                    archive = _Archive(folder)
                html = batch.column(5)[i]
                payload = memoryview(html.as_buffer()) if html.is_valid and refers[i] is None else memoryview(b"")
                rows.append((archive.name, *archive.add(_header(page[i], url[i], n[i], digest[i], refers[i]), payload), page[i]))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["archive", "offset", "length", "page_id"])
        if archive is not None:
            archive.out.close()

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of with_revisits() into archives in folder; the manifest of what was written."""
    rows = pages.select("page_id", "url", "payload_bytes", "payload_digest", "refers_to", F.when(F.col("refers_to").isNull(), F.col("html")).cast("binary").alias("html"))
    return written(rows.mapInArrow(_writer(folder), MANIFEST), "manifest")


def _blocks(stream, length: int, most: int) -> Iterator[bytes]:
    """The inflated bytes of one gzip member, in parts of most bytes."""
    gz = zlib.decompressobj(31)
    while length and not gz.eof:
        data = stream.read(min(length, 1 << 16))
        length -= len(data)
        if not data:
            raise EOFError("an archive ends within a record")
        while data:
            yield gz.decompress(data, most)
            data = gz.unconsumed_tail
    yield gz.flush()


def _head(data: bytearray, blocks: Iterator[bytes]) -> list[bytes]:
    """Takes a block of header lines off the front of data, which is filled from blocks."""
    while (end := data.find(b"\r\n\r\n")) < 0:
        data += next(blocks)
    lines = bytes(data[:end]).split(b"\r\n")
    del data[: end + 4]
    return lines


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.decode().lower(): v.strip().decode() for k, _, v in (line.partition(b":") for line in lines[1:])}


def _reader(chunk_bytes: int):
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("chunk", pa.int64()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("is_last", pa.bool_()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = stream = None
        rows, held = [], 0
        for batch in batches:
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if archive != name:
                    files, path = fs.FileSystem.from_uri(archive)
                    name, stream = archive, files.open_input_file(path)
                stream.seek(offset)
                blocks, data = _blocks(stream, length, chunk_bytes), bytearray()
                head = _fields(_head(data, blocks))
                left = int(head["content-length"])
                http = _head(data, blocks)
                left -= sum(len(x) + 2 for x in http) + 2
                digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                fixed = (archive, offset, page_of(head["warc-record-id"]), head["warc-type"], page_of(head.get("warc-refers-to")), head.get("warc-target-uri"))
                sha1, seen, chunk = hashlib.sha1(), 0, 0
                while True:
                    while len(data) < min(left, chunk_bytes) and (more := next(blocks, None)) is not None:
                        data += more
                    part = bytes(data[: min(left, chunk_bytes)])
                    if left > 0 and not part:
                        raise EOFError("a record ends within its payload")
                    del data[: len(part)]
                    left -= len(part)
                    seen += len(part)
                    sha1.update(part)
                    rows.append((*fixed, chunk, seen, sha1.hexdigest(), int(head["x-payload-length"]), digest, left <= 0, part))
                    held += len(part) + 300
                    chunk += 1
                    if held > 8 * CHUNK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                    if left <= 0:
                        break
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of the archives in a manifest.  A revisit has one empty chunk; its length and digest are those in its header."""
    size = manifest.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = 1 + size // READ_BYTES  # by the bytes of the archives, not of the manifest; ranges keep a task in one place of an archive
    places = manifest.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return places.select("archive", "offset", "length").mapInArrow(_reader(chunk_bytes), CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row for each record of a chunked record table, from its last chunk; raises if a payload doesn't have the digest of its header."""
    whole = (F.col("record_type") == "revisit") | ((F.col("sha1_so_far") == F.col("payload_digest")) & (F.col("bytes_so_far") == F.col("payload_bytes")))
    payload_bytes = F.when(whole, F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a payload was damaged")).cast("long"))
    return chunks.where("is_last").select("page_id", "url", payload_bytes.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) as read back from archives.

    A row for each row of pages, repeated ones too; a null html is an empty payload, a null url an empty
    one.  Other columns, whatever their names, are not read.  An empty table gives an empty table.
    """
    folder = folder or new_path(pages.sparkSession, "archives")
    return records(read_archives(write_archives(with_revisits(pages), folder)))
