"""Token ids in a binary format: fixed-size blocks, transposed into bit or byte planes, each plane zstandard-compressed.

A file (the `content` of a row) is: b"TPL1"; the compressed planes, block after block; the chunk index (for each block:
offset, ids, and each plane's size); the document index (ids, null marks, lengths); a fixed-size footer.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemloom.llm.common import BoundedCache, cut_long, stored, texts_of

MAGIC, FOOTER = b"TPL1", struct.Struct("<QIIIBxxx4s")
FILES = "shard int, file_no int, shard_start long, n_ids long, content binary"
DOCS = "shard int, doc_id long, in_shard long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    cells = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [cells[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(cells, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    if mode == "byte":
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8, n) for p in planes], axis=1)).view("<u4").reshape(-1)
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


def encode_file(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], mode: str = "byte", block: int = 1 << 16, level: int = 3) -> bytes:
    import zstandard

    z = zstandard.ZstdCompressor(level=level)
    parts, at, index, n_planes = [MAGIC], len(MAGIC), [], 4 if mode == "byte" else 32
    for i in range(0, len(ids), block):
        cut = ids[i : i + block]
        planes = [z.compress(p) for p in to_planes(cut, mode)]
        index.append(struct.pack(f"<QI{n_planes}I", at, len(cut), *map(len, planes)))
        parts += planes
        at += sum(map(len, planes))
    docs = z.compress(b"".join((np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), np.array(lengths, "<u8").tobytes())))
    return b"".join([*parts, *index, docs, FOOTER.pack(at, len(index), len(doc_ids), len(docs), mode == "bit", MAGIC)])


def decode_file(content: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    at, n_blocks, n_docs, doc_bytes, bit, magic = FOOTER.unpack(content[-FOOTER.size :])
    if magic != MAGIC or content[:4] != MAGIC:
        raise ValueError("not a token file")
    mode, n_planes = ("bit", 32) if bit else ("byte", 4)
    entry, ids = struct.Struct(f"<QI{n_planes}I"), []
    for k in range(n_blocks):
        start, n, *sizes = entry.unpack_from(content, at + k * entry.size)
        planes = []
        for size in sizes:
            planes.append(z.decompress(content[start : start + size]))
            start += size
        ids.append(from_planes(planes, n, mode))
    at += n_blocks * entry.size
    raw = z.decompress(content[at : at + doc_bytes])
    names, nulls = np.frombuffer(raw, "<i8", n_docs), np.frombuffer(raw, np.uint8, n_docs, 8 * n_docs)
    return np.concatenate(ids) if ids else np.zeros(0, "<u4"), [None if null else int(d) for d, null in zip(names, nulls, strict=True)], np.frombuffer(raw, "<u8", n_docs, 9 * n_docs)


#: Between an ASCII letter and ASCII punctuation but the apostrophe, a piece of such a tokenizer always ends.
_LETTER, _SIGN, _SOLID = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
_LETTER[97:123] = True
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = True
_SOLID[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of text that are divided into words at once; longer texts are cut at white space.
CHUNK = 1 << 20


def distinct_words(pieces: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words between ASCII white space of all pieces, cut where letters end and signs begin; each word's place
    among these, in order; and how many words come before each piece."""
    raw = np.frombuffer(b"\n".join(pieces), np.uint8)
    solid = _SOLID[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1] | (_LETTER[raw[:-1]] & _SIGN[raw[1:]])
    before = np.searchsorted(np.flatnonzero(first), np.cumsum([0, *(len(x) + 1 for x in pieces[:-1])]))
    data = raw[solid]
    ends = np.append(np.flatnonzero(first[solid]), len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    return words.dictionary.to_pylist(), words.indices.to_numpy(), before


class WordEncoder:
    """Ids of texts through a tokenizer that lowers case and whose pieces never span white space.

    Each word is encoded once while it is cached; of a full cache, words that are met again move on to the next one. A
    text with a mark of special tokens, or any text where the tokenizer keeps case, is encoded whole.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.cache, self.older = Tokenizer.from_file(path), most, {}, {}
        probe = ["Ab, cD. x", "ab", ",", "cd", ".", "x"]
        whole, *parts = [e.ids for e in self.tokenizer.encode_batch_fast(probe, add_special_tokens=False)]
        self.by_words = whole == sum(parts, [])
        # the byte-level alphabet: printable bytes stand for themselves, the others for 256, 257 and so on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.model, self.letters = self.tokenizer.model, {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
        self.by_words = self.by_words and all(self.word(w.encode()) == self.whole(w).tobytes() for w in ("the", "ß", "éàça", "unciónraasll"))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def word(self, word: bytes) -> bytes:
        """Lower-case Latin letters alone are one piece that no normalizer changes, so the model can take it at once."""
        if word.isalpha():  # of ASCII letters, which stand for themselves
            return array("I", [t.id for t in self.model.tokenize(word.decode())]).tobytes()
        text = word.decode()
        if text.isalpha() and max(text) < "\u0250" and text == text.lower() and unicodedata.is_normalized("NFC", text):
            return array("I", [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, word)))]).tobytes()
        return self.whole(text).tobytes()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_words:
            return [self.whole(t) for t in texts]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held, size = [], 0
        for k, t in enumerate(texts):
            if "<|" in t:
                out[k].append(self.whole(t))
                continue
            for piece in cut_long(t.encode().lower(), CHUNK):
                held.append((k, piece))
                size += len(piece)
                if size >= CHUNK:
                    self.add(held, out)
                    held, size = [], 0
        if held:
            self.add(held, out)
        return [x[0] if len(x) == 1 else np.concatenate([*x, np.zeros(0, "<u4")]) for x in out]

    def add(self, held: list[tuple[int, bytes]], out: list[list[np.ndarray]]) -> None:
        """Appends the ids of each (k, piece) to out[k]."""
        words, at, before = distinct_words([piece for _, piece in held])
        ids = self.known(words)
        flat, n = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        long, starts = n[at], (np.cumsum(n) - n)[at]
        ends = np.cumsum(long)
        all_ids = flat[np.repeat(starts - ends + long, long) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate(([0], ends))[before].tolist()
        for (k, _), a, b in zip(held, cuts, [*cuts[1:], len(all_ids)], strict=True):
            out[k].append(all_ids[a:b])

    def known(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids, through the cache."""
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > self.most:
            self.older, self.cache, new = self.cache, {}, words
        older = self.older
        self.cache.update([(w, older[w] if w in older else self.word(w)) for w in new])
        return [self.cache[w] for w in words]


_ENCODERS = BoundedCache(WordEncoder, 4)


def write_token_files(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, mode: str = "byte", block: int = 1 << 16, file_ids: int = 1 << 20) -> DataFrame:
    """documents(doc_id, text) as token files of about file_ids ids, in ascending doc_id order over (shard, file_no).

    tokenizer: a path, or a name that public_tokenizers knows; see WordEncoder for what it must keep to.
    Null texts are empty and get the end id alone; null ids come first; repeated ids are kept, ordered by a
    hash of the text. Files are the binary `content` of rows of a stored table, so that any store Spark writes to can hold them.
    A document is never divided between files, so a very long one makes its file longer.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path = tokenizer
        if not os.path.isabs(tokenizer):
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        to_ids = _ENCODERS[path]
        shard, file_no, start, held, names, lengths, n = TaskContext.get().partitionId(), 0, 0, [], [], [], 0
        end = np.array([end_id], "<u4")

        def flush():
            content = encode_file(np.concatenate(held), names, lengths, mode, block)
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file_no": pa.array([file_no], pa.int32()), "shard_start": [start], "n_ids": [n], "content": [content]})

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), to_ids([t or "" for t in texts_of(part.column("text"))]), strict=True):
                    held += [ids, end]
                    names.append(doc_id)
                    lengths.append(len(ids) + 1)
                    n += len(ids) + 1
                    if n >= file_ids:
                        yield flush()
                        file_no, start, held, names, lengths, n = file_no + 1, start + n, [], [], [], 0
        if held:
            yield flush()

    # the hash divides the rows of a hot id, or without one, over partitions
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("__h"))
    ordered = keyed.repartitionByRange("doc_id", "__h").sortWithinPartitions("doc_id", "__h", "text").select("doc_id", "text")
    return stored(ordered.mapInArrow(encode, FILES), "tokens")


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document of the files: its place among all ids, its number of ids and their crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start, content in zip(batch.column("shard").to_pylist(), batch.column("shard_start").to_pylist(), batch.column("content"), strict=True):
                ids, names, lengths = decode_file(content.as_py())
                ends = np.cumsum(lengths).astype(np.int64)
                starts = ends - lengths.astype(np.int64)
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard] * len(names), pa.int32()), "doc_id": pa.array(names, pa.int64()), "in_shard": starts + start, "n_tokens": lengths.astype(np.int64), "ids_crc32": pa.array(crcs, pa.int64())})

    # one row for each shard (a partition of the write), so this window is small
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.groupBy("shard").agg(F.sum("n_ids").alias("ids")).select("shard", F.coalesce(F.sum("ids").over(w), F.lit(0)).alias("base"))
    return files.select("shard", "shard_start", "content").mapInArrow(decode, DOCS).join(bases, "shard").select("doc_id", (F.col("base") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32")
