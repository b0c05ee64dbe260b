"""Language ID by hyperdimensional profiles: random letter vectors, permuted and bound into trigrams, bundled and compared by cosine."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm.common import BoundedCache, texts_of

#: Letters are told apart by their lower-cased code points; each has a vector of its own.
SPACE, BITS = 0, 21
#: Profiles are one small vector for each language; more languages than this are refused.
MOST_LANGUAGES = 2048
SCALE = 10_000


class Letters:
    """A vector of -1 and 1 for each code point, made from the bits of its hashes, the same on every machine; made when first asked for."""

    def __init__(self, dim: int, seed: int):
        self.dim, self.seed, self.rows = dim, seed, np.zeros((0, dim), np.int8)
        self.place = np.full(1 << BITS, -1, np.int32)

    def vector(self, point: int) -> np.ndarray:
        parts = (hashlib.blake2b(b"%d %d" % (point, i), digest_size=64, key=b"%d" % self.seed).digest() for i in range(-(-self.dim // 512)))
        return np.unpackbits(np.frombuffer(b"".join(parts), np.uint8))[: self.dim].astype(np.int8) * 2 - 1

    def __call__(self, points: np.ndarray) -> np.ndarray:
        new = np.unique(points[self.place[points] < 0])
        if len(new):
            self.place[new] = len(self.rows) + np.arange(len(new))
            self.rows = np.concatenate((self.rows, [self.vector(p) for p in new.tolist()]))
        return self.rows[self.place[points]]


_LETTERS = BoundedCache(lambda key: Letters(*key), 4)
_LOWER: list[np.ndarray] = []


def lower_letters() -> np.ndarray:
    """By code point: the code point of the lower-cased letter, SPACE for all that aren't letters."""
    if not _LOWER:
        table = np.zeros(1 << BITS, np.int32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LOWER.append(table)
    return _LOWER[0]


class Profiler:
    """Vectors of texts: counts of letter trigrams (runs of other characters are one space) times the trigrams' vectors."""

    def __init__(self, dim: int, seed: int):
        self.dim, self.letters, self.lower = dim, _LETTERS[dim, seed], lower_letters()

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the distinct trigrams, and their counts; none where the text has no letter."""
        places = self.lower[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
        if not places.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        places = np.concatenate(([SPACE], places, [SPACE]))
        places = places[np.concatenate(([True], (places[1:] != SPACE) | (places[:-1] != SPACE)))].astype(np.int64)
        return np.unique((places[:-2] << 2 * BITS) | (places[1:-1] << BITS) | places[2:], return_counts=True)

    def bound(self, codes: np.ndarray) -> np.ndarray:
        """The trigrams' vectors: binding keeps order, as the first letter's vector is rotated twice, the second's once."""
        low = (1 << BITS) - 1
        first, second, third = (self.letters((codes >> shift) & low) for shift in (2 * BITS, BITS, 0))
        return (np.roll(first, 2, axis=1) * np.roll(second, 1, axis=1) * third).astype(np.float32)

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of whole numbers for each text, and which texts have letters."""
        found = [self.trigrams(t) for t in texts]
        codes = np.unique(np.concatenate([c for c, _ in found])) if found else np.zeros(0, np.int64)
        out = np.zeros((len(texts), self.dim), np.float64)
        for i in range(0, len(codes), 4096):
            part = codes[i : i + 4096]
            bound = self.bound(part)
            counts = np.zeros((len(texts), len(part)), np.float32)
            for k, (c, n) in enumerate(found):
                inside = slice(np.searchsorted(c, part[0]), np.searchsorted(c, part[-1], "right"))
                counts[k, np.searchsorted(part, c[inside])] = n[inside]
            out += counts @ bound
        return out, np.array([len(c) > 0 for c, _ in found], bool)


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def fit_profiles(labelled: DataFrame, dim: int = 1024, seed: int = 7) -> dict[str, np.ndarray]:
    """A unit prototype for each non-null lang of labelled(text, lang): the sum of its texts' unit vectors.

    Unit vectors are rounded to whole ten-thousandths, so the sum is the same in any order. Each task sends one
    partial sum for each language; texts without letters add nothing, a language with only such texts is not learned.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, total = Profiler(dim, seed), {}
        for part in _batches(batches):
            vectors, real = profiler.vectors([t or "" for t in texts_of(part.column("text"))])
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            whole = np.rint(vectors * (SCALE / np.where(norms == 0, 1, norms))).astype(np.int64)
            for k, lang in enumerate(texts_of(part.column("lang"))):
                if real[k]:
                    total[lang] = total.get(lang, 0) + whole[k]
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], names=["lang", "sums"])

    partial = labelled.filter("lang is not null").select("text", "lang").mapInArrow(sums, "lang string, sums array<long>")
    rows = partial.select("lang", F.posexplode("sums").alias("at", "v")).groupBy("lang", "at").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("v")).select("lang", "v.v").limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out = {}
    for r in sorted(rows):
        v = np.array(r[1], np.float64)
        if v.any():
            out[r[0]] = v / np.linalg.norm(v)
    return out


def predict_language(docs: DataFrame, profiles: dict[str, np.ndarray], keep: Sequence[str] = ("doc_id",), dim: int = 1024, seed: int = 7) -> DataFrame:
    """(keep..., lang_pred, score) for each row of docs(keep..., text).

    lang_pred is the prototype nearest by cosine, the first by name among equals; `und` with score 0 where the
    text is null or has no letter, or nothing was learned. score is the cosine, 0 where it is negative.
    """
    names = sorted(profiles)
    matrix = np.array([profiles[n] for n in names]).reshape(len(names), dim)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler(dim, seed)
        for part in _batches(batches):
            vectors, real = profiler.vectors([t or "" for t in texts_of(part.column("text"))])
            norms = np.linalg.norm(vectors, axis=1)
            if not names:
                real = real & False
            cosines = vectors @ matrix.T / np.where(norms == 0, 1, norms)[:, None] if names else np.zeros((len(real), 1))
            best = cosines.argmax(axis=1)
            langs = [names[b] if ok else "und" for b, ok in zip(best, real, strict=True)]
            score = np.where(real, np.clip(cosines.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string", "score double"])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(predict, schema)
