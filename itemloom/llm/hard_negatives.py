"""Hard negatives of anchors: candidates in Hilbert order in blocks with zone maps, of which interval bounds choose those to read.

Vectors become whole numbers and are ordered by label and place on a Hilbert curve, so that neighbours lie together, then packed into
blocks: rows of a Parquet table with a zone map, the least and largest value of each dimension. For an anchor, interval arithmetic
over a zone map gives a lower and an upper bound of the inner products with all rows of a block.

1. Positives: a block of the anchor's label is read if its upper bound reaches the least lower bound of so many rows as are asked for.
2. Windows: each positive's score makes a window of scores; a block of another label is read if its bounds meet a window of an
   anchor and its upper bound reaches the best lower bound of the blocks that lie in the window with enough rows.

Anchors are a stated part of all rows and are dealt in groups of neighbours. A group's needs are a list of blocks, so rows are
pairs of a group and a block that it needs; a group's pairs are dealt over SPREAD tasks, each of which keeps the best of an anchor so
far, and skips a block for anchors whose best it can't change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.llm.common import stored

#: Rows of a block, anchors of a group (at most so many more as a block has), zone maps that are looked at together.
BLOCK, GROUP, PAGE = 1024, 1024, 2048
#: Tasks that share a group's blocks.
SPREAD = 16
#: Dimensions of the Hilbert curve (those that vary most) and bits of each.
CURVE_DIMS, CURVE_BITS = 12, 5
#: Components are kept within this, so that scores fit a long: at up to 1,024 dimensions below 2^62.
MOST_COMPONENT = 1 << 26
#: Anchors whose scores or bounds are held at once.
SLICE = 256
LAST = np.iinfo(np.int64).max
NONE = -LAST


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve of points (rows of whole numbers below 2^bits): Gray-coded transposed axes, undone bit by bit."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flips, q = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while q > 1:
        flips ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flips
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix; missing components are 0."""
    if (column.value_lengths().to_numpy(zero_copy_only=False) == dims).all():
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    out = np.zeros((len(column), dims), np.int64)
    for k, x in enumerate(column.to_pylist()):
        out[k, : len(x)] = x
    return out


def _packed(a: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes of a power of two: the kind's letter, then the numbers."""
    for kind in ("i2", "i4", "i8"):
        if not a.size or (a.min() >= np.iinfo(kind).min and a.max() <= np.iinfo(kind).max):
            return kind.encode() + np.ascontiguousarray(a, f"<{kind}").tobytes()
    raise AssertionError


def _unpacked(raw: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(raw, f"<{raw[:2].decode()}", offset=2).reshape(-1, columns).astype(np.int64)


def usable(rows: DataFrame, id_col: str, vector: str, label: str | Column, scale: int) -> DataFrame:
    """(id, label, q) of the rows that take part; q is floor(scale * x) of each component, kept within MOST_COMPONENT."""
    whole = F.transform(vector, lambda x: F.greatest(F.lit(-float(MOST_COMPONENT)), F.least(F.lit(float(MOST_COMPONENT)), F.floor(x.cast("double") * float(scale)).cast("double"))).cast("long"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    right = F.col(id_col).isNotNull() & F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))
    return rows.filter(right).select(F.col(id_col).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), whole.alias("q")).filter("label is not null")


def write_blocks(rows: DataFrame, dims: int, anchors_at: int, block: int = BLOCK) -> DataFrame:
    """rows(id, label, q) as stored blocks: (block, label, n, n_anchors, lo, hi, ids, vectors), ids rising in a block."""
    columns = [F.get("q", F.lit(d)) for d in range(dims)]
    spread = rows.agg(*(F.stddev_pop(c) for c in columns), *(F.min(c) for c in columns), *(F.max(c) for c in columns)).first()
    values = np.array([float(x or 0) for x in spread]).reshape(3, dims)
    chosen = np.argsort(-values[0], kind="stable")[:CURVE_DIMS]
    low, width = values[1][chosen], np.maximum(values[2][chosen] - values[1][chosen], 1) + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.floor((_matrix(batch.column("q"), dims)[:, chosen] - low) / width * (1 << CURVE_BITS)).astype(np.int64)
            at = hilbert(np.clip(cells, 0, (1 << CURVE_BITS) - 1), CURVE_BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=["id", "label", "q", "place"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seq, held = TaskContext.get().partitionId() << 32, []

        def full(label: int, ids: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
            nonlocal seq
            order, seq = np.argsort(ids, kind="stable"), seq + 1
            ids, q = ids[order], q[order]
            lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (q.min(axis=0), q.max(axis=0))]
            return pa.RecordBatch.from_arrays(
                [pa.array([seq]), pa.array([label]), pa.array([len(ids)]), pa.array([int((ids % anchors_at == 0).sum())]), *lists, pa.array([ids.astype("<i8").tobytes()]), pa.array([_packed(q)])],
                names=["block", "label", "n", "n_anchors", "lo", "hi", "ids", "vectors"],
            )

        def flush(all_of_it: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            labels, ids, q = (np.concatenate(x) for x in zip(*held, strict=True))
            edges = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
            for a, b in zip(edges, edges[1:], strict=False):
                last = b == len(labels) and not all_of_it
                while b - a >= block or (b > a and not last):
                    yield full(int(labels[a]), ids[a : min(a + block, b)], q[a : min(a + block, b)])
                    a = min(a + block, b)
                if last:
                    held = [(labels[a:b], ids[a:b], q[a:b])] if b > a else []
            if all_of_it:
                held = []

        for batch in batches:
            held.append((batch.column("label").to_numpy(), batch.column("id").to_numpy(), _matrix(batch.column("q"), dims)))
            if sum(len(x[0]) for x in held) >= 2 * block:
                yield from flush(False)
        if held:
            yield from flush(True)

    order = ["label", "place", "id", F.hash("q")]
    dealt = rows.mapInArrow(place, "id long, label long, q array<long>, place long").repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(dealt.select("id", "label", "q").mapInArrow(pack, "block long, label long, n long, n_anchors long, lo array<long>, hi array<long>, ids binary, vectors binary"), "negatives-blocks", 4096)


def anchor_groups(blocks: DataFrame, dims: int, anchors_at: int, group: int = GROUP) -> DataFrame:
    """Stored (grp, label, at, ids, vectors): anchors of one label from neighbouring blocks; at is each one's (block, place in it)."""
    running = Window.partitionBy("label").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    numbered = blocks.filter("n_anchors > 0").select("block", "label", F.floor(F.coalesce(F.sum("n_anchors").over(running), F.lit(0)) / group).alias("nth"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out_ids, out_vectors = [], [], []
            for b, raw, v in zip(batch.column("block").to_pylist(), batch.column("ids").to_pylist(), batch.column("vectors").to_pylist(), strict=True):
                ids = np.frombuffer(raw, "<i8")
                chosen = np.flatnonzero(ids % anchors_at == 0)
                at.append(np.stack([np.full(len(chosen), b), chosen], axis=1).astype("<i8").tobytes())
                out_ids.append(ids[chosen].tobytes())
                out_vectors.append(_unpacked(v, dims)[chosen].astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("nth"), batch.column("label"), batch.column("block"), *(pa.array(x, pa.binary()) for x in (at, out_ids, out_vectors))], names=["nth", "label", "block", "at", "ids", "vectors"])

    parts = blocks.join(numbered.select("block", "nth"), "block").select("nth", "label", "block", "ids", "vectors").mapInArrow(pick, "nth long, label long, block long, at binary, ids binary, vectors binary")
    # a group has less than group + block anchors
    joined = parts.groupBy("label", "nth").agg(F.array_sort(F.collect_list(F.struct("block", "at", "ids", "vectors"))).alias("parts"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("parts").to_pylist()
            joined = [pa.array([b"".join(x[c] for x in own) for own in parts], pa.binary()) for c in ("at", "ids", "vectors")]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("label"), *joined], names=["grp", "label", "at", "ids", "vectors"])

    own = joined.select(F.xxhash64("label", "nth").alias("grp"), "label", "parts")
    return stored(own.mapInArrow(whole, "grp long, label long, at binary, ids binary, vectors binary"), "negatives-anchors", 64)


def bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each anchor (row) and block (column) the least and largest inner product that the block's zone map allows."""
    a, lo, hi = anchors.astype(float), lo.astype(float).T, hi.astype(float).T
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    slack = 1e-12 * (np.abs(a) @ np.maximum(np.abs(lo), np.abs(hi)))  # of sums beyond 2^53
    return np.floor(up @ lo + down @ hi - slack), np.ceil(up @ hi + down @ lo + slack)


def at_least(lower: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """For each anchor (row) the highest score that k rows are known to reach, from blocks' lower bounds and numbers of rows; -inf where there are fewer."""
    order = np.argsort(-lower, axis=1)
    enough = np.cumsum(np.take_along_axis(counts, order, axis=1), axis=1) >= k
    found = np.take_along_axis(np.take_along_axis(lower, order, axis=1), enough.argmax(axis=1)[:, None], axis=1)[:, 0]
    return np.where(enough.any(axis=1), found, -np.inf)


def windows_of(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest whole n with low * p <= 100 n <= high * p for each positive score p (NONE: no positive, an empty window)."""
    there = scores != NONE
    p = np.where(there, scores, 0)
    return np.where(there, -((-low * p) // 100), 1), np.where(there, (high * p) // 100, 0)


def scores_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def best_in(scores: np.ndarray, k: int, caps: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of scores and each of its windows (columns of caps and floors) the places and scores of the k first; columns are in order of ties; NONE: none."""
    order = np.argsort(-scores, axis=1, kind="stable")
    ranked = np.take_along_axis(scores, order, axis=1)
    n_rows, n = scores.shape
    found = np.full((n_rows, caps.shape[1], k), NONE)
    places = np.zeros((n_rows, caps.shape[1], k), np.int64)
    every = np.arange(n_rows)
    for j in range(caps.shape[1]):
        above = (ranked > caps[:, j : j + 1]).sum(axis=1)
        for i in range(min(k, n)):
            at = np.minimum(above + i, n - 1)
            s = ranked[every, at]
            ok = (above + i < n) & (s >= floors[:, j])
            found[:, j, i] = np.where(ok, s, NONE)
            places[:, j, i] = order[every, at]
    return places, found


class Best:
    """The k first so far of each anchor's windows: scores, ids and row numbers. Highest scores come first, then smallest ids, then rows."""

    def __init__(self, n: int, windows: int, k: int):
        self.k = k
        self.scores, self.ids, self.rows = np.full((n, windows, k), NONE), np.full((n, windows, k), LAST), np.full((n, windows, k), LAST)

    def add(self, part: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        both = [np.concatenate([old[part], new], axis=-1) for old, new in zip((self.scores, self.ids, self.rows), (scores, ids, rows), strict=True)]
        order = np.lexsort((both[2], both[1], -both[0]), axis=-1)[..., : self.k]
        self.scores[part], self.ids[part], self.rows[part] = (np.take_along_axis(x, order, axis=-1) for x in both)

    def packed(self) -> bytes:
        return np.stack([self.scores, self.ids, self.rows]).astype("<i8").tobytes()

    @classmethod
    def unpacked(cls, raw: bytes, windows: int, k: int) -> Best:
        out = cls(0, windows, k)
        out.scores, out.ids, out.rows = np.frombuffer(raw, "<i8").reshape(3, -1, windows, k).copy()
        return out


def needed(heads: DataFrame, pages: DataFrame, n_pages: int, dims: int, k: int, same: bool) -> DataFrame:
    """(grp, block, up) of heads(grp, label, at, vectors, caps, floors): blocks that a group has to read, of its label or of others, and their highest bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                zones = [z for z in row["zones"] if (z["label"] == row["label"]) == same]
                if not zones:
                    found.append([])
                    continue
                lo, hi = (np.array([z[c] for z in zones], np.int64).reshape(len(zones), dims) for c in ("lo", "hi"))
                names, counts = np.array([z["block"] for z in zones]), np.array([z["n"] for z in zones])
                at = np.frombuffer(row["at"], "<i8").reshape(-1, 2)
                vectors = np.frombuffer(row["vectors"], "<i8").reshape(len(at), dims)
                caps, floors = (np.frombuffer(row[c], "<i8").reshape(len(at), -1) for c in ("caps", "floors"))
                use, up = np.zeros(len(zones), bool), np.full(len(zones), -np.inf)
                for a in range(0, len(at), SLICE):
                    part = slice(a, a + SLICE)
                    least, most = bounds(vectors[part], lo, hi)
                    others = counts - (at[part, :1] == names)
                    for j in range(caps.shape[1]):
                        low, cap = floors[part, j : j + 1], caps[part, j : j + 1]
                        inside = np.where((least >= low) & (most <= cap), least, -np.inf)
                        known = at_least(inside, others, k)[:, None]
                        meets = (most >= low) & (least <= cap) & (most >= known) & (low <= cap)
                        use |= meets.any(axis=0)
                    up = np.maximum(up, most.max(axis=0))
                found.append([{"block": b, "up": u} for b, u in zip(names[use].tolist(), up[use].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("grp"), pa.array(found, pa.list_(pa.struct([("block", pa.int64()), ("up", pa.float64())])))], names=["grp", "needs"])

    asked = heads.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1)))).join(pages, "page").drop("page")
    found = stored(asked.mapInArrow(run, "grp long, needs array<struct<block: long, up: double>>"), "negatives-needs", 4)
    return found.select("grp", F.explode("needs").alias("x")).select("grp", "x.block", "x.up")


def read(heads: DataFrame, pairs: DataFrame, blocks: DataFrame, dims: int, windows: int, k: int, block: int) -> DataFrame:
    """Stored (grp, best): the k first rows of each window of each anchor of heads, in the blocks of pairs."""
    empty = [F.lit(None).cast("binary").alias(c) for c in ("at", "caps", "floors")]
    payloads = pairs.join(blocks.select("block", "ids", "vectors"), "block").select("grp", F.pmod(F.hash("block"), F.lit(SPREAD)).alias("share"), F.lit(1).alias("kind"), "up", "block", "ids", "vectors", *empty)
    first = heads.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    first = first.select("grp", "share", F.lit(0).alias("kind"), F.lit(float("inf")).alias("up"), F.lit(0).cast("long").alias("block"), "ids", "vectors", "at", "caps", "floors")
    # a group comes before its blocks, of which those with the highest bounds come first
    dealt = first.unionByName(payloads).repartition("grp", "share").sortWithinPartitions("grp", "share", "kind", F.col("up").desc(), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp = best = None
        some = False
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if row["grp"] != grp:
                        if some:
                            yield pa.RecordBatch.from_pydict({"grp": [grp], "best": [best.packed()]})
                        grp, some = row["grp"], False
                        at = np.frombuffer(row["at"], "<i8").reshape(-1, 2)
                        anchors = np.frombuffer(row["vectors"], "<i8").reshape(len(at), dims)
                        caps, floors = (np.frombuffer(row[c], "<i8").reshape(len(at), windows) for c in ("caps", "floors"))
                        best = Best(len(at), windows, k)
                    continue
                some, ids = True, np.frombuffer(row["ids"], "<i8")
                vectors = _unpacked(row["vectors"], dims)
                least, most = (x[:, 0] for x in bounds(anchors, vectors.min(axis=0)[None], vectors.max(axis=0)[None]))
                # ties by id may still enter at the score of the last one
                open_ = (most[:, None] >= np.maximum(best.scores[:, :, -1], floors)) & (least[:, None] <= caps) & (floors <= caps)
                asking = np.flatnonzero(open_.any(axis=1))
                for a in range(0, len(asking), SLICE):
                    part = asking[a : a + SLICE]
                    scores = scores_of(anchors[part], vectors)
                    own = np.flatnonzero(at[part, 0] == row["block"])
                    scores[own, at[part[own], 1]] = NONE
                    places, found = best_in(scores, k, caps[part], floors[part])
                    best.add(part, found, np.where(found == NONE, LAST, ids[places]), np.where(found == NONE, LAST, row["block"] * block + places))
        if some:
            yield pa.RecordBatch.from_pydict({"grp": [grp], "best": [best.packed()]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                best, *others = (Best.unpacked(raw, windows, k) for raw in parts)
                for x in others:
                    best.add(np.arange(len(best.scores)), x.scores, x.ids, x.rows)
                out.append(best.packed())
            yield pa.RecordBatch.from_arrays([batch.column("grp"), pa.array(out, pa.binary())], names=["grp", "best"])

    found = stored(dealt.mapInArrow(run, "grp long, best binary"), "negatives-parts", 16)
    # SPREAD parts of a group at most
    return stored(found.groupBy("grp").agg(F.collect_list("best").alias("parts")).mapInArrow(merge, "grp long, best binary"), "negatives-best", 4)


def mine(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str | Column = "label", anchors_at: int = 50, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows whose id is divisible by anchors_at.

    Components become floor(scale * x); a score is the inner product with the anchor. An anchor's positives are the n_positives first
    other rows of its label; for each, the n_negatives first rows of another label with low * positive <= 100 * negative <= high * positive
    are given. Higher scores come first, ties go to the smaller id.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Repeated rows are rows of their own: an
    anchor's copy may be its positive. A shorter vector's missing components are 0. Components are kept within MOST_COMPONENT.
    """
    rows = usable(rows, id_col, vector, label, scale)
    dims = rows.agg(F.max(F.size("q"))).first()[0] or 1  # empty vectors are as one 0
    blocks = write_blocks(rows, dims, anchors_at, block)
    n_pages = max(1, -(-blocks.count() // PAGE))
    zone = F.struct("block", "label", "n", "lo", "hi")
    pages = stored(blocks.groupBy(F.pmod(F.hash("block"), F.lit(n_pages)).alias("page")).agg(F.collect_list(zone).alias("zones")), "negatives-zones", 4)
    groups = anchor_groups(blocks, dims, anchors_at, group)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(x) // 8 for x in batch.column("ids").to_pylist()]
            caps, floors = (pa.array([np.full(m, v, "<i8").tobytes() for m in n], pa.binary()) for v in (LAST, NONE + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, caps, floors], names=[*batch.schema.names, "caps", "floors"])

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [windows_of(Best.unpacked(x, 1, n_positives).scores[:, 0], low, high) for x in batch.column("best").to_pylist()]
            caps, floors = (pa.array([x[k].astype("<i8").tobytes() for x in both], pa.binary()) for k in (1, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, caps, floors], names=[*batch.schema.names, "caps", "floors"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                positives, best = Best.unpacked(row["best"], 1, n_positives), Best.unpacked(row["negatives"], n_positives, n_negatives)
                i, j, r = np.nonzero(best.scores != NONE)
                names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
                values = (np.frombuffer(row["ids"], "<i8")[i], positives.ids[i, 0, j], (r + 1).astype(np.int32), best.ids[i, j, r], positives.scores[i, 0, j], best.scores[i, j, r])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in values], names=list(names))

    kinds = "grp long, label long, at binary, ids binary, vectors binary"
    heads = stored(groups.mapInArrow(whole, f"{kinds}, caps binary, floors binary"), "negatives-heads", 16)
    positives = read(heads, needed(heads, pages, n_pages, dims, n_positives, True), blocks, dims, 1, n_positives, block)
    asking = stored(groups.join(positives, "grp").mapInArrow(windowed, f"{kinds}, best binary, caps binary, floors binary"), "negatives-windows", 16)
    negatives = read(asking, needed(asking, pages, n_pages, dims, n_negatives, False), blocks, dims, n_positives, n_negatives, block)
    out = asking.select("grp", "ids", "best").join(negatives.select("grp", F.col("best").alias("negatives")), "grp")
    return stored(out.mapInArrow(told, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"), "negatives-mined", 16)


#: The query in plain SQL: all scores of each anchor.
SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) <= 3
"""
