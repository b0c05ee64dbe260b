"""ISO media containers: payloads stored as raw 8-bit video frames, and a reader that walks boxes and sample tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm.common import stored, texts_of

WIDTH, HEIGHT = 16, 12
FRAME = WIDTH * HEIGHT
CHUNK_FRAMES, KEY_EVERY, TIMESCALE, TICKS = 64, 12, 600, 25
#: Boxes that hold boxes, and how many bytes come before these.
NESTED = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"dinf": 0, b"stbl": 0, b"udta": 0, b"dref": 8, b"edts": 0}
CONTAINERS = "doc_id long, media binary"
PROBED = (
    "doc_id long, codec string, width int, height int, timescale long, duration long, n_samples long, media_bytes long, media_sha256 string, "
    "key_starts array<long>, key_ends array<long>, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, error string"
)


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size < 1 << 32:
        return struct.pack(">I4s", size, kind) + b"".join(parts)
    return struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(parts)


def full(kind: bytes, version: int, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(payload: bytes) -> bytes:
    """Spaces up to a positive multiple of a frame."""
    return payload + b" " * ((-len(payload)) % FRAME if payload else FRAME)


def build_container(payload: bytes) -> bytes:
    """A one-track file: each frame's 192 samples of 8 bits are payload bytes; every twelfth frame is a sync sample."""
    media = pad(payload)
    n = len(media) // FRAME
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIII H", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    chunks = -(-n // CHUNK_FRAMES)
    last = n - (chunks - 1) * CHUNK_FRAMES
    runs = [(1, CHUNK_FRAMES if chunks > 1 else last)] + ([(chunks, last)] if chunks > 1 and last != CHUNK_FRAMES else [])
    keys = range(1, n + 1, KEY_EVERY)

    def moov(base: int, wide: bool) -> bytes:
        offsets = [base + FRAME * CHUNK_FRAMES * i for i in range(chunks)]
        stbl = box(
            b"stbl", full(b"stsd", 0, struct.pack(">I", 1), entry), full(b"stts", 0, struct.pack(">III", 1, n, TICKS)),
            full(b"stss", 0, struct.pack(f">I{len(keys)}I", len(keys), *keys)), full(b"stsc", 0, struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs)),
            full(b"stsz", 0, struct.pack(">II", FRAME, n)), full(b"co64" if wide else b"stco", 0, struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        times = struct.pack(">QQIQ", 0, 0, TIMESCALE, n * TICKS)
        minf = box(b"minf", full(b"vmhd", 0, bytes(8), flags=1), box(b"dinf", full(b"dref", 0, struct.pack(">I", 1), full(b"url ", 0, flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", 1, times, struct.pack(">HH", 0x55C4, 0)), full(b"hdlr", 0, bytes(4), b"vide", bytes(12), b"texts\0"), minf)
        tkhd = full(b"tkhd", 1, struct.pack(">QQIIQ", 0, 0, 1, 0, n * TICKS), bytes(8), struct.pack(">hhhh", 0, 0, 0, 0), matrix, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=7)
        mvhd = full(b"mvhd", 1, times, struct.pack(">IHHQ", 0x10000, 0x100, 0, 0), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia), box(b"udta", box(b"size", struct.pack(">Q", len(payload)))))

    wide = len(media) >= (1 << 32) - (1 << 24)
    base = len(ftyp) + len(moov(0, wide)) + (16 if wide else 8)
    return ftyp + moov(base, wide) + box(b"mdat", media)


def walk(data: memoryview, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path, start, end) of every box's content, depth first. ValueError where a box leaves its parent."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("a box is cut")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box is cut")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} leaves its parent")
        yield (*path, kind), start + head, start + size
        if kind in NESTED:
            yield from walk(data, start + head + NESTED[kind], start + size, (*path, kind))
        start += size


def _table(data: memoryview, at: tuple[int, int], each: str) -> list[tuple]:
    n, row = struct.unpack_from(">I", data, at[0] + 4)[0], struct.Struct(">" + each)
    if n * row.size > at[1] - at[0] - 8:
        raise ValueError("a table is cut")
    return [row.unpack_from(data, at[0] + 8 + i * row.size) for i in range(n)]


def tracks(data: memoryview) -> list[dict[bytes, tuple[int, int]]]:
    """For each track the first box of each kind within it; boxes outside of tracks are in all of them."""
    shared: dict[bytes, tuple[int, int]] = {}
    found: list[dict[bytes, tuple[int, int]]] = []
    for path, a, b in walk(data):
        if path[-1] == b"trak":
            found.append({})
        (found[-1] if b"trak" in path else shared).setdefault(path[-1], (a, b))
    return [shared | own for own in found] or [shared]


def probe(content: bytes | memoryview, track: int = 0) -> dict:
    """Codec, duration, samples as byte ranges and sync samples of one track; no payload is decoded.

    Width and height are 0 where the track isn't video. ValueError where boxes, tables or offsets don't fit the file.
    """
    data = memoryview(content)
    at = tracks(data)[track]
    for kind in (b"mdhd", b"stsd", b"stts", b"stsc", b"stsz"):
        if kind not in at:
            raise ValueError(f"no {kind.decode()} box")
    mdhd = at[b"mdhd"][0]
    timescale, duration = struct.unpack_from(">IQ", data, mdhd + 20) if data[mdhd] == 1 else struct.unpack_from(">II", data, mdhd + 12)
    stsd = at[b"stsd"][0] + 8
    codec = bytes(data[stsd + 4 : stsd + 8]).decode("latin-1").strip()
    video = b"hdlr" not in at or bytes(data[at[b"hdlr"][0] + 8 : at[b"hdlr"][0] + 12]) == b"vide"
    width, height = struct.unpack_from(">HH", data, stsd + 8 + 24) if video else (0, 0)
    fixed, n = struct.unpack_from(">II", data, at[b"stsz"][0] + 4)
    sizes = [fixed] * n if fixed else list(struct.unpack_from(f">{n}I", data, at[b"stsz"][0] + 12))
    if sum(k for k, _ in _table(data, at[b"stts"], "II")) != n:
        raise ValueError("times and sizes differ in number")
    offsets = [x for (x,) in (_table(data, at[b"co64"], "Q") if b"co64" in at else _table(data, at[b"stco"], "I"))]
    runs, starts, k = _table(data, at[b"stsc"], "III"), [], 0
    for i, (first, per_chunk, _) in enumerate(runs):
        for chunk in range(first, runs[i + 1][0] if i + 1 < len(runs) else len(offsets) + 1):
            here = offsets[chunk - 1]
            for _ in range(per_chunk):
                starts.append(here)
                here += sizes[k]
                k += 1
    if k != n or any(a + s > len(data) for a, s in zip(starts, sizes, strict=True)):
        raise ValueError("samples lie outside the file")
    keys = [i - 1 for (i,) in _table(data, at[b"stss"], "I")] if b"stss" in at else range(n)
    return {"codec": codec, "width": width, "height": height, "timescale": timescale, "duration": duration, "starts": starts, "sizes": sizes, "keys": list(keys), "at": at}


def read_payload(content: bytes | memoryview, info: dict) -> bytes:
    """The samples' bytes in order."""
    data = memoryview(content)
    return b"".join(data[a : a + s] for a, s in zip(info["starts"], info["sizes"], strict=True))


def write_media(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text) as containers (doc_id, media) in a stored table. Null text is empty: one frame of spaces."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([build_container((t or "").encode()) for t in texts_of(part.column("text"))], pa.binary())], names=["doc_id", "media"])

    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, CONTAINERS), "media")


def probe_media(media: DataFrame) -> DataFrame:
    """One row per container of media(doc_id, media). A broken or null container has only its error and stored form's columns."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
                content = memoryview(content.as_buffer()) if content.is_valid else memoryview(b"")
                row = {"doc_id": doc_id, "media_bytes": len(content), "media_sha256": hashlib.sha256(content).hexdigest(), "error": None}
                try:
                    x = probe(content)
                    row |= {k: x[k] for k in ("codec", "width", "height", "timescale", "duration")} | {"n_samples": len(x["sizes"])}
                    row |= {"key_starts": [x["starts"][k] for k in x["keys"]], "key_ends": [x["starts"][k] + x["sizes"][k] for k in x["keys"]]}
                    payload = read_payload(content, x)
                    row |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:])}
                    if b"size" in x["at"]:
                        row["n_bytes"] = struct.unpack_from(">Q", content, x["at"][b"size"][0])[0]
                except (ValueError, struct.error, IndexError) as e:
                    row["error"] = str(e) or type(e).__name__
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return media.select("doc_id", "media").mapInArrow(read, PROBED)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
ARROW = pa.schema([(n, _TYPES[t]) for n, t in (x.strip().split(" ") for x in PROBED.split(","))])


def media_digest(probed: DataFrame) -> DataFrame:
    """The features as one string: codec, size, seconds, samples, sync samples and a sum over their byte ranges."""
    spread = F.aggregate(F.zip_with("key_starts", "key_ends", lambda a, b: a * 31 + b), F.lit(0).cast("long"), lambda s, x: (s * 1000003 + x) % 2147483647)
    feature = F.format_string("%s|%dx%d|%.4f|%d|%d|%d", "codec", "width", "height", F.col("duration") / F.col("timescale"), "n_samples", F.size("key_starts"), spread)
    return probed.withColumn("feature", feature)
