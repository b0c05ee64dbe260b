"""Target-distribution importance resampling over hashed word n-grams, counted batch by batch.

The texts of a batch are joined with a separator that belongs to no word; one pass of a regular expression finds all words of the
batch; a search in the texts' sorted offsets tells each word's text, and n-grams whose words lie in two texts are masked; a bincount
sums the rest by bucket. CRCs of n-grams are put together from those of their words, as crc(a + b) is a linear map of crc(a), which
depends on the length of b alone, plus crc(b); no n-gram is ever spelled out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.llm.common import BoundedCache, discard, stored, texts_of

BUCKETS, MOST_WORDS = 10_000, 3
#: Documents of so many words can be drawn; so large a share of them is.
LEAST_WORDS, PERCENT = 20, 5
SEED = 42
#: Bytes of joined texts; a longer text is looked at in pieces that overlap by the words of an n-gram.
CHUNK = 1 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SEPARATOR = b"\0"
_INSIDE = np.zeros(256, bool)
_INSIDE[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True
#: Lengths of a word and its space for which the shift of a CRC stands in a table.
SHORT = 64


@cache
def _shift_tables() -> np.ndarray:
    """[n, k, byte]: what byte k of a CRC becomes when n bytes follow it."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # a byte in, without the constant
    step = lambda crc: (crc >> np.uint32(8)) ^ one[crc & np.uint32(255)]  # noqa: E731  one zero byte more
    tables = np.zeros((SHORT + 1, 4, 256), np.uint32)
    for k in range(4):
        tables[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, SHORT + 1):
        tables[n] = step(tables[n - 1])
    return tables


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each crc after n more bytes whose own crc is still to be xored in."""
    tables = _shift_tables()
    out, left = crc.copy(), n.copy()
    at = np.arange(len(out))
    while len(at):  # once, but for words of more than SHORT bytes
        c, m = out[at], np.minimum(left[at], SHORT)
        out[at] = tables[m, 0, c & 255] ^ tables[m, 1, (c >> 8) & 255] ^ tables[m, 2, (c >> 16) & 255] ^ tables[m, 3, c >> 24]
        left[at] -= m
        at = at[left[at] > 0]
    return out


class Words:
    """CRCs of words and of a space and the word, kept while they are few."""

    def __init__(self):
        self.cache = BoundedCache(lambda w: (zlib.crc32(w), zlib.crc32(b" " + w)), 300_000)

    def of(self, joined: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(joined, np.uint8)
        offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[_INSIDE[data]])]).dictionary_encode()
        crcs = np.array([self.cache[w] for w in words.dictionary.to_pylist()], np.uint32).reshape(-1, 2)[words.indices.to_numpy()]
        return crcs[:, 0], crcs[:, 1]


def pieces_of(text: bytes, size: int, most_words: int = MOST_WORDS) -> Iterator[tuple[bytes, int]]:
    """A lower-cased text in pieces of about `size` bytes, each after the first with the words before it that n-grams reach back to: how many."""
    at, before = 0, b""
    while True:
        cut = re.compile(rb"[^0-9a-z\x80-\xff]").search(text, at + size) if len(text) - at > size else None
        piece = before + text[at : cut.start() if cut else len(text)]
        yield piece, len(before.split())
        if not cut:
            return
        # the last words of the piece, found from its end: the shortest tail with a word's beginning in it
        tail = 1 << 10
        while len(words := WORD.findall(piece[-tail:])) <= most_words - 1 and tail < len(piece):
            tail *= 4
        before, at = b"".join(w + b" " for w in words[-(most_words - 1) :]) if most_words > 1 else b"", cut.start()


class Ngrams:
    """Buckets of the n-grams of 1 to most_words words of texts."""

    def __init__(self, buckets: int = BUCKETS, most_words: int = MOST_WORDS, chunk: int = CHUNK):
        self.buckets, self.most_words, self.chunk, self.words = buckets, most_words, chunk, Words()

    def __call__(self, texts: Sequence[bytes | None]) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
        """For each batch: words of each text in it (0 for the others), and for n = 1, 2, ... the buckets and the texts' places of its n-grams."""
        held, size = [], 0
        for k, t in enumerate(texts):
            for piece, repeated in pieces_of((t or b"").lower(), self.chunk, self.most_words):
                held.append((k, piece, repeated))
                size += len(piece) + 1
                if size >= self.chunk:
                    yield self.batch(held, len(texts))
                    held, size = [], 0
        if held:
            yield self.batch(held, len(texts))

    def batch(self, held: list[tuple[int, bytes, int]], n_texts: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        joined = SEPARATOR.join(piece for _, piece, _ in held)
        spans = np.fromiter(chain.from_iterable(map(re.Match.span, WORD.finditer(joined))), np.int64).reshape(-1, 2)
        starts, ends = spans[:, 0], spans[:, 1]
        begins = np.cumsum([0, *(len(piece) + 1 for _, piece, _ in held[:-1])])
        part = np.searchsorted(begins, starts, "right") - 1
        # words that stand in a piece for those before it end no n-gram of it
        own = np.arange(len(starts)) >= (np.searchsorted(starts, begins) + [r for _, _, r in held])[part]
        text = np.array([k for k, _, _ in held])[part]
        crc, spaced = self.words.of(joined, starts, ends)
        length = ends - starts + 1
        buckets, places, at = [], [], crc
        for n in range(1, self.most_words + 1):
            if n > 1:
                at = shifted(at[:-1], length[n - 1 :]) ^ spaced[n - 1 :]
            whole = own[n - 1 :] & (part[n - 1 :] == part[: len(part) - n + 1])
            buckets.append((at[whole] % np.uint32(self.buckets)).astype(np.int64))
            places.append(text[n - 1 :][whole])
        return np.bincount(text[own], minlength=n_texts), buckets, places


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, most_words: int = MOST_WORDS) -> np.ndarray:
    """How often each bucket is hit by the n-grams of texts(text): each task sends its sums, so the driver gets one number for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = Ngrams(buckets, most_words), np.zeros(buckets, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for _, found, _ in grams([t and t.encode() for t in texts_of(batch.column("text").slice(at, 256))]):
                    for x in found:
                        total += np.bincount(x, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) of each bucket."""
    s, t, n = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, keep: Sequence[str], most_words: int = MOST_WORDS) -> DataFrame:
    """docs' columns `keep`, n_words, n_features and weight, the sum of the gains of a text's n-grams."""
    keep, kinds = list(keep), dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Ngrams(len(gain), most_words)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = part.num_rows
                words, features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                for w, found, places in grams([t and t.encode() for t in texts_of(part.column("text"))]):
                    words += w
                    for x, k in zip(found, places, strict=True):
                        features += np.bincount(k, minlength=n)
                        weight += np.bincount(k, gain[x], n).astype(np.int64)  # whole numbers, far below 2^53
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *map(pa.array, (words, features, weight))], names=[*keep, "n_words", "n_features", "weight"])

    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_words long, n_features long, weight long"]))


def noise(id_col: str, seed: int = SEED) -> Column:
    """Gumbel noise of an id in thousandths; a null id counts as the text ''."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, most_words: int = MOST_WORDS, seed: int = SEED) -> DataFrame:
    """(id, n_features, weight, score, rank) for each row of docs(id, text): ranks of the percent in 100 of documents with least_words words or more that have the highest scores.

    target(text): the texts whose distribution is drawn towards. A score is the weight plus Gumbel noise of the id, so the draw is one
    without replacement in proportion to exp(weight / 1000). Ties go to the smaller id, null ids last, then to fewer features and the smaller weight. Null and empty texts
    have no features and weight 0; repeated rows are rows like others; bytes that aren't UTF-8 are read as U+FFFD.
    """
    gain = gains(bucket_counts(docs, buckets, most_words), bucket_counts(target, buckets, most_words))
    able = F.col("n_words") >= least_words
    weighed = weights(docs.select(id_col, "text"), gain, [id_col], most_words)
    weighed = stored(weighed.select(id_col, "n_features", "weight", (F.col("weight") + noise(id_col, seed)).alias("score"), able.alias("able"), F.monotonically_increasing_id().alias("row")), "importance-weights")
    n_drawn = weighed.filter("able").count() * percent // 100
    # a range of the order in each partition; rows beside their place in it, so that ranks need only the partitions' sizes
    order = [F.col("able").desc(), F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc(), F.col("row").asc()]
    placed = weighed.repartitionByRange(*order).sortWithinPartitions(*order).select(id_col, "n_features", "weight", "score", "able", F.monotonically_increasing_id().alias("at"))
    placed = stored(placed.select(id_col, "n_features", "weight", "score", "able", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "importance-order")
    discard(weighed)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    bases = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.col("base") + F.col("place") + 1
    return placed.join(bases, "part").select(id_col, "n_features", "weight", "score", F.when(F.col("able") & (rank <= n_drawn), rank).alias("rank"))
