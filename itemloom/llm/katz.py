"""Katz backoff language model of any order: Good-Turing discounted counts, exactly normalised backoff weights.

    p(w | h) = d_c c(h w) / c(h)       where the gram h w was seen, and a(h) p(w | h without its first token) elsewhere
    p(w)     = d_c c(w) / N            where the word was seen; all other words together have what is left
    a(h)     = (1 - sum of p(. | h) over seen w) / (1 - sum of the shorter p over the same w), and 1 for an unseen h

A gram of k tokens is the pair of its first and its last k - 1 tokens, so every level is built from the one below by the
same steps, and a text's recursion telescopes: log p(text) is the sum over its tokens' grams of every order of
    gain(g) = log p(g) - log a(its history) - log p(g without its first token),   or log p(w) for one token, if g was seen,
and over their histories of log a(h). So scoring looks grams up by key. The most frequent keys (a bounded number, chosen by a
count) go to every task; all others are found by a join, which so has no hot key.

Words are 64-bit hashes; a second hash of each verifies that no two words of the corpus share one, else another seed is
taken. Longer grams are 64-bit mixes of their parts. Tables are partitioned by a slice of the key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm.common import discard, scratch, stored

#: Counts over this are discounted by a constant.
MOST_DISCOUNTED = 5
#: At most so many words, and so many grams of each longer order, are sent to every task: 32 bytes each.
HEAD_WORDS, HEAD_GRAMS = 1 << 20, 1 << 20
#: Tokens that a task gathers before it counts them.
GATHER = 1 << 21
#: Rows in an Arrow batch of narrow tables; batches of texts are short.
WIDE = 1 << 15
#: Grams are counted, and looked up, in so many parts by key: only a part is shuffled at a time, and texts are read again.
SLICES = 2
#: Bytes that are hashed at once.
PIECE = 1 << 20
ORDER = 2

# keys of what stands before the first token and of the end, like those of words by chance alone
START, END = 0x2545F4914F6CDD1D, 0x1D8AF1F0D3C5A397
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BELOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)  # masks of the first k bytes


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of raw[first:last], eight bytes after eight, each step mixing what was before; longer words by XXH64."""
    import xxhash

    eight = np.ndarray((len(raw) + 1,), "<u8", np.concatenate((raw, np.zeros(8, np.uint8))), strides=(1,))  # the eight bytes from each place on
    length = last - first
    h = _mix(length.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    rows, done = np.arange(len(first)), 0
    while len(rows):
        part = eight[first[rows] + done] & _BELOW[np.minimum(length[rows] - done, 8)]
        h[rows] = _mix((h[rows] ^ part) * np.uint64(0x9E3779B97F4A7C15) + (h[rows] >> np.uint64(7)))
        done += 8
        rows = rows[(length[rows] > done) & (length[rows] <= 256)]
    for k in np.flatnonzero(length > 256).tolist():
        h[k] = xxhash.xxh64_intdigest(raw[first[k] : last[k]].tobytes(), seed)
    return h.view(np.int64)


def word_keys(text: bytes, seeds: tuple[int, ...] = (0,)) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the words of a text, A-Z lowered, and their 64-bit keys under each seed."""
    raw, at, keys, i = np.frombuffer(text.lower(), np.uint8), [], [[] for _ in seeds], 0
    while i < len(raw):
        end = min(i + PIECE, len(raw))
        if end < len(raw):  # cut at white space; a word longer than a piece is taken whole
            spaces = np.flatnonzero(_SPACE[raw[i:end]])
            if len(spaces):
                end = i + int(spaces[-1]) + 1
            else:
                later = np.flatnonzero(_SPACE[raw[end:]])
                end = end + int(later[0]) + 1 if len(later) else len(raw)
        piece = raw[i:end]
        solid = ~_SPACE[piece]
        edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
        at.append(edge[::2] + i)
        for own, seed in zip(keys, seeds, strict=True):
            own.append(_hashes(piece, edge[::2], edge[1::2], seed))
        i = end
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *at]), [np.concatenate([none, *own]) for own in keys]


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One 64-bit key for each gram: of its first and its last tokens' keys."""
    x = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) + w.view(np.uint64)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


@dataclass
class Tokens:
    """Some rows of a batch, the keys of their grams of each order (levels[k - 1]), the places in these at which each row's
    tokens end a gram, how many tokens each row has, and each row's first place."""

    part: pa.RecordBatch
    levels: list[np.ndarray]
    at: np.ndarray
    n: np.ndarray
    first: np.ndarray


def tokens(batches: Iterator[pa.RecordBatch], order: int, seed: int) -> Iterator[Tokens]:
    """A-Z are lowered; tokens are the words between ASCII white space, then one end. order - 1 starts stand before the first."""
    pad = order - 1
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
            places, (keys,) = word_keys(b"\n".join(texts), (seed,))
            row = np.searchsorted(begins, places, "right") - 1
            n = np.bincount(row, minlength=len(texts)) + 1
            ends = np.cumsum(n + pad)
            level = np.full(ends[-1], START, np.int64)
            level[np.arange(len(keys)) + row * (1 + pad) + pad] = keys  # each row before has one end and its starts more
            level[ends - 1] = END
            first = ends - n
            at = np.arange(n.sum()) + np.repeat(pad * np.arange(1, len(n) + 1), n)
            levels = [level]
            for _ in range(pad):
                longer = np.empty_like(level)
                longer[1:] = pair_key(levels[-1][:-1], levels[-1][1:])
                longer[0] = 0
                levels.append(longer)
            yield Tokens(part, levels, at, n, first)


def _summed(held: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    """Counts of equal keys (the first array), with what else stands at them."""
    key, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
    _, at, c = np.unique(key, return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays([*(pa.array(x[at]) for x in ([key, *rest] if len(rest) == 1 else rest)), pa.array(c)], names=names)


def _words(docs: DataFrame, seed: int) -> DataFrame:
    """(w, c, least, most): counts of docs(text)'s words and ends, with the extremes of a second hash of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                texts = [t or b"" for t in batch.slice(i, 64).column("text").cast(pa.binary()).to_pylist()]
                _, (w, check) = word_keys(b"\n".join(texts), (seed, seed + 1_000_003))
                end = np.full(len(texts), END)
                held.append((np.concatenate((w, end)), np.concatenate((check, end))))
                n += len(w)
                if n >= GATHER:
                    yield from checked(held)
                    held, n = [], 0
        if held:
            yield from checked(held)

    def checked(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        w, check = (np.concatenate(x) for x in zip(*held, strict=True))
        both = pair_key(w, check)  # words that share a key but not the second hash are told apart here
        yield _summed([(both, w, check)], ["w", "x", "c"])

    rows = docs.select("text").mapInArrow(run, "w long, x long, c long")
    return rows.groupBy("w").agg(F.sum("c").alias("c"), F.min("x").alias("least"), F.max("x").alias("most"))


def _counted(docs: DataFrame, order: int, seed: int, part: int, slices: int) -> DataFrame:
    """(h, w, c) for one slice of docs(text)'s grams of `order` tokens: the keys of all but the last and all but the first token; each task sends what it has gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for t in tokens(batches, order, seed):
            key, h, w = t.levels[-1][t.at], t.levels[-2][t.at - 1], t.levels[-2][t.at]
            mine = key % slices == part
            held.append((key[mine], h[mine], w[mine]))
            n += len(held[-1][0])
            if n >= GATHER:
                yield _summed(held, ["h", "w", "c"])
                held, n = [], 0
        if held:
            yield _summed(held, ["h", "w", "c"])

    return docs.select("text").mapInArrow(run, "h long, w long, c long").groupBy("h", "w").agg(F.sum("c").alias("c"))


def discounts(of_counts: dict[int, int]) -> np.ndarray:
    """d_0 ... d_5, then at 6 what is taken from each larger count.

    Good-Turing's, by Katz; where numbers of counts are missing or don't give a share of 0 to 1, (r - D) / r with Ney's D.
    A larger count loses half of D, so that every history has something left for unseen words.
    """
    n = [of_counts.get(r, 0) for r in range(MOST_DISCOUNTED + 3)]
    ney = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    k = MOST_DISCOUNTED
    rest = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    d = np.ones(k + 2)
    for r in range(1, k + 1):
        turing = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 0.0
        d[r] = turing if 0 < turing < 1 else (r - min(ney, 0.9)) / r
    d[k + 1] = min(ney, 0.9) / 2
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c <= MOST_DISCOUNTED, d[np.minimum(c, MOST_DISCOUNTED)] * c, c - d[-1])


def _discounted(c, d: np.ndarray):
    """The same as a column."""
    small = F.element_at(F.array(*(F.lit(float(x)) for x in d[1:-1])), F.least(c, F.lit(MOST_DISCOUNTED)).cast("int")) * c
    return F.when(c <= MOST_DISCOUNTED, small).otherwise(c - float(d[-1]))


class Counts:
    """Counts of counts: exact up to 64, then in classes of a sixteenth of a doubling, so they stay few however large the corpus."""

    def __init__(self, table: DataFrame):
        size = F.when(F.col("c") <= 64, F.col("c")).otherwise(F.floor(16 * F.log2(F.col("c").cast("double"))))
        got = table.groupBy((F.col("c") > 64).alias("large"), size.alias("size")).agg(F.min("c").alias("c"), F.count("*").alias("n"), F.sum("c").alias("total")).collect()
        self.classes = sorted((r["c"], r["n"], r["total"]) for r in got)
        self.n, self.v = sum(t for _, _, t in self.classes), sum(k for _, k, _ in self.classes)
        self.d = discounts({c: k for c, k, _ in self.classes if c <= 64})

    def kept(self) -> float:
        """The sum of all discounted counts."""
        return sum(float(discounted(np.array([c]), self.d)[0]) * k if c <= MOST_DISCOUNTED else t - k * self.d[-1] for c, k, t in self.classes)

    def least(self, most: int) -> int | None:
        """The smallest count that begins a class of which all rows with it or a larger one are at most `most`."""
        least, n = None, 0
        for c, k, _ in reversed(self.classes):
            if n + k > most:
                break
            least, n = c, n + k
        return least


class Table:
    """Columns by an int64 key w, found by open addressing in numpy."""

    def __init__(self, columns: dict[str, np.ndarray]):
        self.columns = columns
        self.keys = columns["w"]
        bits = max(4, int(2 * len(self.keys) - 1).bit_length() if len(self.keys) else 4)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        at, left = self._home(self.keys), np.arange(len(self.keys), dtype=np.int32)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several, the last stays
            lost = self.slots[at] != left
            at, left = (at[lost] + 1) & self.mask, left[lost]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted key, -1 where it isn't there."""
        if not len(self.keys):
            return np.full(len(wanted), -1, np.int32)
        at = self._home(wanted)
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != wanted))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            out[open_] = now = self.slots[at[open_]]
            open_ = open_[(now >= 0) & (self.keys[now] != wanted[open_])]
        return out

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]


def _head(table: DataFrame, least: int | None, columns: list[str]) -> dict[str, np.ndarray]:
    """The columns of the rows of table(w, c, ...) with counts of `least` or more."""
    got = table.filter(F.col("c") >= least if least is not None else F.lit(False)).select(*columns).toArrow()
    return {x: got.column(x).to_numpy() if x == "w" else np.nan_to_num(got.column(x).to_numpy().astype(np.float64)) for x in columns}


@dataclass
class Model:
    """levels[k - 1](key, slice, c, value, frequent): what each gram of k tokens adds to a text's score over the default, c being
    a word's count and else 0; rows with `frequent` of least[k - 1] or more are also in head, words first; and what unseen words have."""

    order: int
    seed: int
    slices: int
    levels: list[DataFrame]
    least: list[int | None]
    head: Table
    head_words: int
    n: int
    v: int
    log_unseen: float


def _weights(grams: DataFrame, below: DataFrame, counts: Counts, sent: Broadcast) -> DataFrame:
    """(h, hc, log_a) for each history of grams(h, w, c): its count and its backoff weight. below(w, log_p) has the shorter grams, sent the most frequent of them."""
    d = counts.d

    def summed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, c, p = (np.concatenate(x) for x in zip(*held, strict=True))
        own, back = np.unique(h, return_inverse=True)
        sums = [np.bincount(back, x, minlength=len(own)) for x in (discounted(c, d), p)]
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(back, c, minlength=len(own)).astype(np.int64)), *map(pa.array, sums)], names=["h", "hc", "disc", "p"])

    def histories(tail: bool):
        """Sums over seen words by history; where the shorter gram isn't in the head, rows that still need its p."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = sent.value
            p, held, n = 10.0 ** table["log_p"], [], 0
            for batch in batches:
                h, w, c = (batch.column(x).to_numpy() for x in ("h", "w", "c"))
                at = table.find(w)
                there = at >= 0
                if tail:
                    yield pa.RecordBatch.from_arrays([pa.array(x[~there]) for x in (h, w, c)] + [pa.array(discounted(c[~there], d))], names=["h", "w", "hc", "disc"])
                else:
                    held.append((h[there], c[there], p[at[there]]))
                    n += len(held[-1][0])
                    if n >= GATHER:
                        yield summed(held)
                        held, n = [], 0
            if held:
                yield summed(held)

        return run

    known = grams.mapInArrow(histories(False), "h long, hc long, disc double, p double")
    others = grams.mapInArrow(histories(True), "h long, w long, hc long, disc double").join(below.select("w", F.pow(F.lit(10.0), "log_p").alias("p")).hint("shuffle_hash"), "w").select("h", "hc", "disc", "p")
    sums = known.unionByName(others).groupBy("h").agg(*(F.sum(x).alias(x) for x in ("hc", "disc", "p")))
    # where nothing is left to the shorter grams' unseen words, their share can't be raised
    left = F.greatest(1 - F.col("p"), F.lit(1e-12))
    return sums.select("h", "hc", F.log10(F.greatest(1 - F.col("disc") / F.col("hc"), F.lit(1e-300)) / left).alias("log_a"))


def _gains(grams: DataFrame, below: DataFrame, counts: Counts, sent: Broadcast, with_p: bool) -> DataFrame:
    """(w, c, gain, and log_p if with_p) for each gram of grams(h, w, c), w now its own key; below(w, log_p, log_a, hc) has the shorter grams, sent the most frequent of them."""
    d = counts.d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """As far as the head tells it, and which shorter grams are still lacking."""
        table = sent.value
        log_hc = np.log10(np.maximum(table["hc"], 1))
        for batch in batches:
            h, w, c = (batch.column(x).to_numpy() for x in ("h", "w", "c"))
            at_h, at_w = table.find(h), table.find(w)
            log_p = np.log10(discounted(c, d))
            if len(table.keys):
                log_p = log_p - np.where(at_h >= 0, log_hc[at_h], 0)
                gain = log_p - np.where(at_h >= 0, table["log_a"][at_h], 0) - np.where(at_w >= 0, table["log_p"][at_w], 0)
            else:
                gain = log_p
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (pair_key(h, w), h, w, c, gain, *own_p(log_p), at_h < 0, at_w < 0)], names=["key", "h", "w", "c", "gain", *own_p("log_p"), "lacks_h", "lacks_w"])

    own_p = lambda x: [x] if with_p else []
    partial = grams.mapInArrow(run, f"key long, h long, w long, c long, gain double, {'log_p double, ' if with_p else ''}lacks_h boolean, lacks_w boolean")
    out = [F.col("key").alias("w"), "c", F.col("gain").cast("float").alias("gain"), *own_p(F.col("log_p").cast("float").alias("log_p"))]
    whole = partial.filter("not lacks_h and not lacks_w").select(*out)
    # what is not lacking asks for a key that matches nothing
    lacking = partial.filter("lacks_h or lacks_w").withColumn("kh", F.when(F.col("lacks_h"), F.col("h")).otherwise(F.col("key"))).withColumn("kw", F.when(F.col("lacks_w"), F.col("w")).otherwise(F.col("key")))
    of_h = below.filter("hc is not null").select(F.col("w").alias("kh"), F.log10("hc").alias("log_hc"), F.col("log_a").alias("h_log_a"))
    of_w = below.filter("log_p is not null").select(F.col("w").alias("kw"), F.col("log_p").alias("w_log_p"))
    lacking = lacking.drop("h", "w").join(of_h.hint("shuffle_hash"), "kh", "left").join(of_w.hint("shuffle_hash"), "kw", "left")
    some = lambda flag, c: F.when(F.col(flag), F.col(c)).otherwise(0.0)
    gain = F.col("gain") - some("lacks_h", "log_hc") - some("lacks_h", "h_log_a") - some("lacks_w", "w_log_p")
    filled = lacking.withColumn("gain", gain)
    filled = filled.withColumn("log_p", F.col("log_p") - some("lacks_h", "log_hc")) if with_p else filled
    return whole.unionByName(filled.select(*out))


def fit(docs: DataFrame, order: int = ORDER, head_words: int = HEAD_WORDS, head_grams: int = HEAD_GRAMS, slices: int = SLICES, seed: int = 0) -> Model:
    """The model of docs(text); null texts are empty and are one end each. Repeated rows count each time.

    order: tokens of the longest grams, 1 or more.
    """
    sc = docs.sparkSession.sparkContext
    for seed in range(seed, seed + 8):
        words = stored(_words(docs, seed), "katz-words")
        if words.filter("least <> most").isEmpty():
            break
        discard(words)
    else:
        raise RuntimeError("words share keys under every seed")
    counts, most, held = Counts(words), head_words, words
    n, v = counts.n, counts.v
    log_unseen = float(np.log10((n - counts.kept()) / n)) if n else 0.0
    log_p = F.log10(_discounted(F.col("c"), counts.d) / float(max(n, 1)))
    base = words.select("w", "c", log_p.alias("log_p"), (log_p - log_unseen).alias("gain"))
    levels, least, heads = [], [], []

    def keep(level: DataFrame, value) -> None:
        count = F.col("c") if not levels else F.lit(0).cast("long")
        levels.append(level.select(F.col("w").alias("key"), "slice", count.alias("c"), value.cast("float").alias("value"), "frequent"))
        least.append(counts.least(most))
        heads.append(_head(levels[-1].select(F.col("key").alias("w"), F.col("c").alias("count"), "value", F.col("frequent").alias("c")), least[-1], ["w", "count", "value"]))

    for k in range(2, order + 1):
        grams = [stored(_counted(docs, k, seed, j, slices), f"katz-grams-{k}") for j in range(slices)]
        every = reduce(DataFrame.unionByName, grams)
        above = Counts(every)
        sent = sc.broadcast(Table(_head(base, counts.least(most), ["w", "log_p"])))
        weights = _weights(every, base, above, sent).withColumnRenamed("h", "w")
        level = base.select("w", "c", "log_p", "gain").join(weights, "w", "full").withColumn("c", F.coalesce("c", F.lit(0)))
        level = level.withColumn("frequent", F.greatest("c", F.coalesce("hc", F.lit(0)))).withColumn("slice", F.pmod("w", F.lit(slices)).cast("int"))
        level = stored(level, f"katz-level-{k - 1}", WIDE, by="slice")
        sent.destroy()
        discard(held)
        keep(level, F.coalesce("gain", F.lit(0.0)) + F.coalesce("log_a", F.lit(0.0)))
        sent = sc.broadcast(Table(_head(level.withColumn("c", F.col("frequent")), least[-1], ["w", "log_p", "log_a", "hc"])))
        path = scratch(docs.sparkSession, f"katz-gains-{k}")
        for j, part in enumerate(grams):
            gains = stored(_gains(part, level, above, sent, k < order), "katz-gains", WIDE, path=f"{path}/slice={j}")
            discard(part)
        sent.destroy()
        base = docs.sparkSession.read.schema(f"{gains.schema.simpleString()[7:-1]}, slice int".replace(":", " ")).parquet(path)
        base.scratch_path = path
        held, counts, most = base, above, head_grams
    top = base if "slice" in base.columns else base.withColumn("slice", F.pmod("w", F.lit(slices)).cast("int"))
    keep(top.withColumn("frequent", F.col("c")), F.col("gain"))
    head = {x: np.concatenate([h[x] for h in heads]) for x in ("w", "count", "value")}
    return Model(order, seed, slices, levels, least, Table(head), len(heads[0]["w"]), n, v, log_unseen)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) for each row of docs(id, text).

    Equal texts have equal scores. Null texts are empty: one end. A model of nothing gives every text 0. Texts are read once
    for what the head knows and once for each slice of the rest.
    """
    log_base = lambda c: np.log10((c + 0.5) / (model.n + 0.5 * (model.v + 1)))
    base_unseen, log_unseen, order, seed, slices, n_words = float(log_base(0)), model.log_unseen, model.order, model.seed, model.slices, model.head_words
    sent = docs.sparkSession.sparkContext.broadcast((model.head, log_base(model.head["count"][:n_words]) - base_unseen))

    def keys_of(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all grams, words first, then of the histories before each text's first token; and their rows."""
        row = np.repeat(np.arange(len(t.n)), t.n)
        keys = [level[t.at] for level in t.levels] + [level[t.first - 1] for level in t.levels[:-1]]
        return np.concatenate(keys), np.concatenate([*[row] * order, *[np.arange(len(t.n))] * (order - 1)])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over what the head knows; all else counts as unseen."""
        table, base = sent.value
        known = table["count"] > 0
        for t in tokens(batches, order, seed):
            keys, row = keys_of(t)
            at = table.find(keys)
            value = np.bincount(row[at >= 0], table["value"][at[at >= 0]], minlength=len(t.n)) + t.n * log_unseen
            word, row = at[: len(t.at)], row[: len(t.at)]
            row, word = row[word >= 0], word[word >= 0]
            # the start is no word of the texts' own; its count is 0
            sums = [np.bincount(row, x, minlength=len(t.n)) for x in (known[word], base[word])]
            made = [pa.array(t.n), pa.array(sums[0].astype(np.int64)), pa.array(sums[1] + t.n * base_unseen), pa.array(value)]
            yield pa.RecordBatch.from_arrays([*(t.part.column(c) for c in (id_col, "ref", "tie")), *made], names=[id_col, "ref", "tie", "n_tokens", "n_known", "base_score", "score"])

    def lookups(part: int):
        """Keys of one slice that are not in the head, each time they stand in a text."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, _ = sent.value
            for t in tokens(batches, order, seed):
                keys, row = keys_of(t)
                mine = np.flatnonzero(keys % slices == part)
                mine = mine[table.find(keys[mine]) < 0]
                yield pa.RecordBatch.from_arrays([pa.array(keys[mine]), pa.array(t.part.column("ref").to_numpy()[row[mine]])], names=["key", "ref"])

        return run

    kind, text = dict(docs.dtypes)[id_col], F.coalesce("text", F.lit(""))
    for salt in range(8):
        texts = docs.select(id_col, "text", F.xxhash64(text, F.lit(salt)).alias("ref"), F.hash(text).alias("tie"))
        rows = stored(texts.mapInArrow(own, f"`{id_col}` {kind}, ref long, tie int, n_tokens long, n_known long, base_score double, score double"), "katz-own")
        # a text of m rows is looked up m times
        copies = rows.groupBy("ref").agg(F.count("*").alias("m"), F.min("tie").alias("t0"), F.max("tie").alias("t1"), F.min("n_tokens").alias("n0"), F.max("n_tokens").alias("n1"))
        if copies.filter("t0 <> t1 or n0 <> n1").isEmpty():
            break
        discard(rows)
    else:
        raise RuntimeError("texts share references under every salt")
    base = F.when(F.col("c") > 0, F.log10((F.col("c") + 0.5) / (model.n + 0.5 * (model.v + 1))) - base_unseen).otherwise(0.0)
    parts = []
    for j in range(slices):  # the table's side of a slice is hashed in memory: its keys are even over the partitions
        rest = reduce(DataFrame.unionByName, [x.filter((F.col("slice") == j) & (F.col("frequent") < least if least is not None else F.lit(True))).select("key", "c", "value") for x, least in zip(model.levels, model.least, strict=True)])
        met = texts.select("text", "ref").mapInArrow(lookups(j), "key long, ref long").join(rest.hint("shuffle_hash"), "key")
        parts.append(stored(met.groupBy("ref").agg(F.sum((F.col("c") > 0).cast("long")).alias("known"), F.sum(base).alias("base"), F.sum(F.col("value").cast("double")).alias("value")), f"katz-met-{j}"))
    sent.destroy()
    found = reduce(DataFrame.unionByName, parts).groupBy("ref").agg(*(F.sum(x).alias(x) for x in ("known", "base", "value")))
    found = copies.select("ref", "m").join(found, "ref", "left").na.fill(0).select("ref", (F.col("known") / F.col("m")).cast("long").alias("known"), (F.col("base") / F.col("m")).alias("base"), (F.col("value") / F.col("m")).alias("value"))
    out = rows.join(found, "ref")
    return out.select(id_col, "n_tokens", (F.col("n_known") + F.col("known")).alias("n_known"), F.round(F.col("base_score") + F.col("base"), 6).alias("base_score"), F.round(F.col("score") + F.col("value"), 6).alias("score"))
