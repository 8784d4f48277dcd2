"""WARC archives, dictionary-compressed: a Zstandard dictionary in a leading skippable frame, a frame per record.

A task writes the records of its partition to archives of its own. It holds the first records of an
archive, builds a dictionary from them, writes it in a skippable frame (magic 0x184D2A5D, as
readers of .warc.zst expect), and then compresses each record by itself, so a record can be read
alone from its offset. Writers name files by partition and a random part and give one row
per finished archive; only archives in that list count, so a task that ran twice leaves nothing
that is read twice.
"""

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from crawlspark.llm.scratch import Scratch

DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 110 << 10
#: Bytes of records held before an archive's dictionary is built, and the size at which the next archive starts.
SAMPLE_BYTES = 8 << 20
ARCHIVE_BYTES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response or revisit record, uncompressed."""
    digest = base32_sha1(payload)
    block = _HTTP % len(payload) + (b"" if revisit else payload)
    target = "".join(c if 0x20 < ord(c) < 0x7F else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {target}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head += [f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


class _Archive:
    """One archive being written: records are held until its dictionary can be built."""

    def __init__(self, path: str):
        store, inner = fs.FileSystem.from_uri(path)
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        self.path, self.out = path, store.open_output_stream(inner)
        self.held: list[bytes] = []
        self.waiting = self.records = 0
        self.pack: zstandard.ZstdCompressor | None = None

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.pack:
            self.out.write(self.pack.compress(data))
            return
        self.held.append(data)
        self.waiting += len(data)
        if self.waiting >= SAMPLE_BYTES:
            self.begin()

    def begin(self) -> None:
        trained = b""
        try:
            if len(self.held) >= 16:
                trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, self.waiting // 16 + 256), self.held).as_bytes()
        except zstandard.ZstdError:  # too few or too like records to train on: their own bytes serve
            trained = b""
        trained = trained or b"".join(self.held)[:DICTIONARY_BYTES].ljust(8, b"\0")
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained)
        self.pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained))
        info = b"software: crawlspark\r\nformat: WARC File Format 1.1\r\n"
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMES, self.path)}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
        for data in (head.encode() + info + b"\r\n\r\n", *self.held):
            self.out.write(self.pack.compress(data))
        self.held = []

    def close(self) -> tuple[str, int]:
        if not self.pack:
            self.begin()
        self.out.close()
        return self.path, self.records


def read_archive(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive, streamed frame by frame."""
    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_stream(inner) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError(f"{path} has no dictionary frame")
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(source.read(size)))
        rest = b""
        while chunk := rest or source.read(1 << 20):
            frame, parts, rest = unpack.decompressobj(), [], b""
            while True:
                parts.append(frame.decompress(chunk))
                if frame.eof:
                    rest = frame.unused_data
                    break
                chunk = source.read(1 << 20)
                if not chunk:
                    raise ValueError(f"{path} ends inside a record")
            yield parse(b"".join(parts))


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to, revisit: records whose payload an earlier page has point to it.

    Digests are compared without the payloads; only payloads that occur more than once get a partner.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    first = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("_d"), "first")
    out = rows.join(first, F.col("digest") == F.col("_d"), "left")
    revisit = F.coalesce((F.col("page_id") != F.col("first")) & (F.octet_length("payload") >= least_bytes), F.lit(False))
    return out.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write every page as a record below ``folder``, a place all executors reach; (path, records) of the archives.

    ``folder`` is a URI or path that pyarrow's file systems open (file, s3, gs, hdfs). Calling an
    action on the result writes; write it once and read that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, done, size = TaskContext.get().partitionId(), None, [], 0
        for batch in batches:
            for page_id, url, payload, refers_to, revisit in zip(*batch.columns, strict=True):
                data = record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), revisit.as_py())
                if now is None or size >= ARCHIVE_BYTES:
                    if now:
                        done.append(now.close())
                    now, size = _Archive(f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.warc.zst"), 0
                now.add(data)
                size += len(data)
        if now:
            done.append(now.close())
        paths, records = zip(*done, strict=True) if done else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(records, pa.int64())], names=["path", "records"])

    return with_revisits(pages, least_bytes).mapInArrow(run, "path string, records long")


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of the listed archives (column path), each archive streamed by one task; digests are checked.

    A revisit's payload is null; its length and digest are those of the page it refers to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out, size = [], 0
                for fields, block in read_archive(path):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    out.append(row(fields, block, path))
                    size += len(block)
                    if size > 8 << 20:
                        yield batch_of(out)
                        out, size = [], 0
                if out:
                    yield batch_of(out)

    def row(fields: dict[str, str], block: bytes, path: str) -> tuple:
        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
        if f"sha1:{base32_sha1(block)}" != fields["warc-block-digest"] or payload is not None and base32_sha1(payload) != digest:
            raise ValueError(f"damaged record {fields['warc-record-id']} in {path}")
        page, refers = (int(fields[k]) if k in fields else None for k in ("x-page", "x-refers-to-page"))
        return page, fields.get("warc-target-uri"), payload, int(fields["x-payload-length"]), digest, kind, refers

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [c.split()[0] for c in _RECORDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return archives.select("path").repartition("path").mapInArrow(run, _RECORDS)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """All pages written to archives below the shared folder and read back.

    Defined results: null html is an empty payload; a null page_id is written as such and is never
    referred to; rows that repeat both page_id and payload are responses each if that page_id is the
    smallest; a null url leaves the target out; an empty table gives no archives. Other columns are
    not read.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    return read_archives(scratch.table("archives", write_archives(pages, scratch.path("records"), least_bytes)))
