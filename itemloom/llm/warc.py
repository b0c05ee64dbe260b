"""WARC archives: one gzip member per record, written by Spark tasks and read sequentially.

Archives are rows (archive, n_records, content) of a table, so that any store Spark writes to can hold
them and a lost task is simply written again; `content` is the bytes of a .warc.gz file.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.llm.common import stored

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = "archive string, n_records long, content binary"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string, verified boolean"
#: Payloads that several pages have are sent to every task up to so many (about 100 bytes each, so 100 MB).
MOST_SENT = 1_000_000


def b32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None) -> str:
    h = hashlib.md5(str(page_id).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str, level: int = 6) -> bytes:
    """One record as one gzip member. A revisit has the HTTP head, with the full length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else "urn:x-page:none"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{b32_sha1(hashlib.sha1(payload).digest())}", f"WARC-Block-Digest: sha1:{b32_sha1(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is None:
        head.append("X-No-Url: 1")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def read_records(chunks: Iterable[bytes]) -> Iterator[dict]:
    """Records of a .warc.gz stream, member by member, without holding more than one record's head and a chunk.

    Raises ValueError where a member is cut, a length doesn't frame its record, or a digest is wrong.
    """
    source, rest = iter(chunks), b""
    while True:
        while not rest:
            rest = next(source, None)
            if rest is None:
                return
        z, head, record = zlib.decompressobj(31), b"", None
        while not z.eof:
            out = z.decompress(rest, 1 << 16)
            rest = z.unused_data if z.eof else z.unconsumed_tail
            if record is None:
                head += out
                at = head.find(b"\r\n\r\n")
                if at >= 0:
                    record, out = _Record(head[:at]), head[at + 4 :]
                    record.feed(out)
            else:
                record.feed(out)
            if not z.eof and not rest:
                rest = next(source, None)
                if rest is None:
                    raise ValueError("the last member is cut")
        if record is None:
            raise ValueError("a member has no WARC head")
        yield record.done()


class _Record:
    def __init__(self, head: bytes):
        first, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError("not a WARC record")
        self.headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        if not self.headers.get("content-length", "").isdigit():
            raise ValueError("no content-length")
        self.left = int(self.headers["content-length"])
        self.block, self.payload, self.http, self.size, self.tail = hashlib.sha1(), hashlib.sha1(), b"", 0, b""
        # only HTTP messages have a head of their own before the payload
        self.in_payload = not self.headers.get("content-type", "").lower().startswith("application/http")

    def feed(self, data: bytes) -> None:
        own, after = data[: self.left], data[self.left :]
        self.left -= len(own)
        self.tail += after
        if own:
            self.block.update(own)
            if not self.in_payload:
                self.http += own
                at = self.http.find(b"\r\n\r\n")
                if at < 0:
                    return
                own, self.http, self.in_payload = self.http[at + 4 :], self.http[:at], True
            self.payload.update(own)
            self.size += len(own)

    def _agrees(self, name: str, digest: bytes) -> bool:
        """Whether a digest of the head was verified; digests may be missing, and other algorithms than SHA-1 are passed over."""
        given = self.headers.get(name, "")
        if not given.lower().startswith("sha1:"):
            return False
        if given[5:].upper() != b32_sha1(digest):
            raise ValueError(f"wrong {name.split('-')[1]} digest")
        return True

    def done(self) -> dict:
        if self.left or self.tail != b"\r\n\r\n":
            raise ValueError("content-length doesn't frame the record")
        h = self.headers
        kind = h.get("warc-type", "unknown")
        checked = self._agrees("warc-block-digest", self.block.digest())
        size, digest = self.size, h.get("warc-payload-digest")
        if kind == "revisit":  # the payload stands in the record that it refers to
            full = [v.strip() for k, _, v in (x.partition(b":") for x in self.http.split(b"\r\n")) if k.strip().lower() == b"content-length"]
            size = int(full[0]) if full and full[0].isdigit() else None
        else:
            checked = self._agrees("warc-payload-digest", self.payload.digest()) or checked
            digest = digest or f"sha1:{b32_sha1(self.payload.digest())}"
        number = lambda name: int(h[name]) if h.get(name, "").lstrip("-").isdigit() else None
        return {
            "page_id": number("x-page-id"), "url": None if "x-no-url" in h else h.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest and digest.removeprefix("sha1:"), "record_type": kind,
            "refers_to": number("x-refers-to-page"), "record_id": h.get("warc-record-id"), "refers_to_record": h.get("warc-refers-to"), "verified": checked,
        }


def write_archives(pages: DataFrame, archive_bytes: int = 4 << 20, date: str = "2024-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """pages(page_id, url, html) as WARC archives of about archive_bytes, in a stored table.

    Of pages with equal payloads the one with the smallest page_id is a response, the others are revisits of it.
    Null html is an empty payload. Rows that repeat both page_id and payload are responses each time; a null
    page_id is a response unless an equal payload has an id. Equality is that of SHA-256. Payloads are only shuffled where more than
    MOST_SENT of them occur several times.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("body"))
    key = F.unhex(F.sha2("body", 256))
    least = stored(rows.select("page_id", key.alias("key")).groupBy("key").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n"), "warc-repeated", 1 << 14)
    marked = rows.withColumn("key", key).join(F.broadcast(least) if least.count() <= MOST_SENT else least, "key", "left").drop("key")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held, size, count = TaskContext.get().partitionId(), 0, [], 0, 0

        def flush():
            return pa.RecordBatch.from_pydict({"archive": [f"part-{part:06d}-{n:06d}.warc.gz"], "n_records": [count], "content": [b"".join(held)]})

        for batch in batches:
            for page_id, url, payload, first in zip(*(batch.column(c) for c in ("page_id", "url", "body", "first_id")), strict=True):
                page_id, first = page_id.as_py(), first.as_py()
                held.append(write_record(page_id, url.as_py(), payload.as_py(), first, first is not None and first != page_id, date, level))
                size, count = size + len(held[-1]), count + 1
                if size >= archive_bytes:
                    yield flush()
                    n, held, size, count = n + 1, [], 0, 0
        if held:
            yield flush()

    return stored(marked.mapInArrow(pack, ARCHIVES), "warc")


def read_archives(archives: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """All records of archives(content), read in order and verified; a broken archive fails the job with its reason."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("refers_to_record", pa.string()), ("verified", pa.bool_())])
        for batch in batches:
            for content in batch.column("content"):
                view = content.as_buffer()
                chunks = (view.slice(i, min(chunk, view.size - i)).to_pybytes() for i in range(0, view.size, chunk))
                rows = list(read_records(chunks))
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.select("content").mapInArrow(unpack, RECORDS)


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of .warc.gz files in any store that Spark reads, of every type, verified where they have SHA-1 digests."""
    return read_archives(spark.read.format("binaryFile").load(path).select("content"))


def resolved(records: DataFrame) -> DataFrame:
    """records with refers_to of revisits found by the id of the record that they refer to; a target outside of records leaves it as it is."""
    targets = records.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_record")).agg(F.min("page_id").alias("target"))
    return records.join(targets, "refers_to_record", "left").withColumn("refers_to", F.coalesce("target", "refers_to")).select(*records.columns)
