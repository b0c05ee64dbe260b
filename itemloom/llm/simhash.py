"""SimHash near duplicates: fingerprints, their segments' bit counts, and a grid range-join under Manhattan distance.

Two fingerprints that differ in k bits have bit counts (one for each of 32 segments of 2 bits) at a Manhattan distance of k at
most. With 3 bits, the counts of one of the two halves (16 segments) are at a distance of 1 at most. So for each half the
grid has a cell for every vector of 16 counts: a fingerprint stands in its own cell, and visits the cells that are one higher in
one count. Of two fingerprints whose halves are that close, both stand in a cell, or one visits the other's. In a cell, the
distance of all counts is the lower bound that comes before the exact comparison of bits.

A cell with many members is divided by the same rule again: by the two quarters of the other half, one of which is at a distance
of 1 at most as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm.common import components, stored, texts_of

SEGMENTS, SEGMENT_BITS, MOST_BITS = 32, 2, 3
HALF, QUARTER = SEGMENTS // 2, SEGMENTS // 4
#: A cell with more members than this is divided by quarters; a quarter's cell with more is divided into blocks that are compared
#: pairwise, which takes that many fingerprints with equal counts in 24 of 32 segments.
BLOCK = 1024


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Whole text, A-Z lowered, words between ASCII white space, 3-word shingles with repeats; 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    ends = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts[i : i + 4096], ends[i : i + 4096], strict=True)], "<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(id, fp) with fp the 64 bits as a long, for each row of docs(id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in texts_of(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=[id_col, "fp"])

    return docs.select(id_col, "text").mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, fp long")


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """Bit counts of each segment: the embedding, one row for each fingerprint."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(fps), SEGMENTS, SEGMENT_BITS).sum(axis=2, dtype=np.uint8)


def grid(counts: np.ndarray, first: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, cells, home) of the counts of segments first to first + n: each row's own cell, then for each segment the next higher one."""
    powers = (SEGMENT_BITS + 1) ** np.arange(n, dtype=np.int64)
    part = counts[:, first : first + n].astype(np.int64)
    code = part @ powers
    yield np.arange(len(code)), code, True
    for k in range(n):
        rows = np.flatnonzero(part[:, k] < SEGMENT_BITS)
        yield rows, code[rows] + powers[k], False


def close_pairs(x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, with x[i] and x[j] at MOST_BITS differing bits or fewer, where one of the two stands in the cell."""
    a = segment_counts(x).astype(np.int8)
    left, right = [], []
    for i in range(0, len(x), 128):
        near = np.zeros((min(128, len(x) - i), len(x)), np.uint8)
        for k in range(SEGMENTS):
            near += np.abs(a[i : i + 128, k, None] - a[None, :, k]).view(np.uint8)
        p, q = np.nonzero(near <= MOST_BITS)
        p += i
        exact = (p < q) & (home[p] | home[q]) & (np.bitwise_count(x[p] ^ x[q]) <= MOST_BITS)
        left.append(p[exact])
        right.append(q[exact])
    return np.concatenate(left), np.concatenate(right)


def forest(fps: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between places, as few pairs of places as join the same ones."""
    parent = list(range(len(fps)))
    out = []
    for p, q in zip(left.tolist(), right.tolist(), strict=True):
        i, j = p, q
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        while parent[j] != j:
            parent[j] = j = parent[parent[j]]
        if i != j:
            parent[max(i, j)] = min(i, j)
            out.append((p, q))
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) within groups of rows (task, fp, home) that are sorted by task and fingerprint."""

    def out(task: np.ndarray, fps: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        ends = np.flatnonzero(np.concatenate((task[1:] != task[:-1], [True]))) + 1
        starts = np.concatenate(([0], ends[:-1]))
        pairs = []
        two = starts[ends - starts == 2]  # most cells; compared at once
        if len(two):
            x, y = fps[two], fps[two + 1]
            bound = np.abs(segment_counts(x).astype(np.int8) - segment_counts(y).astype(np.int8)).sum(axis=1) <= MOST_BITS
            near = bound & (home[two] | home[two + 1]) & (np.bitwise_count(x ^ y) <= MOST_BITS) & (x != y)
            pairs += zip(x[near].tolist(), y[near].tolist(), strict=True)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a > 2:
                i, j = close_pairs(fps[a:b], home[a:b])
                pairs += [(int(fps[a + p]), int(fps[a + q])) for p, q in forest(fps[a:b], i, j) if fps[a + p] != fps[a + q]]
        both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    held = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool))
    for batch in batches:
        new = (batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False))
        held = tuple(np.concatenate(x) for x in zip(held, new, strict=True))
        if not len(held[0]):
            continue
        cut = int(np.searchsorted(held[0], held[0][-1]))  # sorted: the last group may go on in the next batch
        if cut:
            yield out(*(x[:cut] for x in held))
        held = tuple(x[cut:] for x in held)
    if len(held[0]):
        yield out(*held)


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of values of distinct(fp) that join exactly the fingerprints that links of 3 bits or fewer join.

    Groups send spanning forests, not pairs. A group has up to `block` members, or up to 2 * block where a quarter's cell is divided.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = segment_counts(batch.column(0).to_numpy().view(np.uint64))
            for half in range(2):
                for rows, cell, home in grid(counts, half * HALF, HALF):
                    yield pa.RecordBatch.from_arrays([pa.array(cell * 2 + half), batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), home))], names=["cell", "fp", "home"])

    def quarters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of large cells in the cells of the other half's two quarters. Where neither stood in the large cell, `home` stays false."""
        for batch in batches:
            cell, fps, home = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
            counts = segment_counts(fps.to_numpy().view(np.uint64))
            other = np.where((cell % 2 == 0)[:, None], counts[:, HALF:], counts[:, :HALF])
            for quarter in range(2):
                for rows, code, own in grid(other, quarter * QUARTER, QUARTER):
                    made = [pa.array(x) for x in (cell[rows], code * 2 + quarter, fps.to_numpy()[rows], home[rows], np.full(len(rows), own))]
                    yield pa.RecordBatch.from_arrays(made, names=["cell", "part", "fp", "home", "own"])

    members = stored(distinct.select("fp").mapInArrow(spread, "cell long, fp long, home boolean"), "simhash-cells", 1 << 14)
    size = [F.count("*").alias("n"), F.bool_or("home").alias("any_home")]
    sizes = stored(members.groupBy("cell").agg(*size).filter("n > 1 and any_home"), "simhash-sizes")
    found = []
    small = members.join(sizes.filter(F.col("n") <= block).select("cell"), "cell").select(F.xxhash64("cell").alias("task"), "fp", "home")
    found.append(small.repartition("task").sortWithinPartitions("task", "fp").mapInArrow(_compare, "a long, b long"))
    large = sizes.filter(F.col("n") > block).select("cell")
    if not large.isEmpty():
        parts = stored(members.join(large, "cell").select("cell", "fp", "home").mapInArrow(quarters, "cell long, part long, fp long, home boolean, own boolean"), "simhash-quarters", 1 << 14)
        counted = parts.groupBy("cell", "part").agg(F.count("*").alias("n"), F.bool_or("own").alias("any_own"), F.bool_or("home").alias("any_home")).filter("n > 1 and any_own and any_home")
        dealt = parts.join(counted.select("cell", "part", F.ceil(F.col("n") / block).cast("int").alias("blocks")), ["cell", "part"]).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        # block i meets blocks j in groups (i, j) or (j, i)
        met = dealt.select("cell", "part", "fp", (F.col("home") | F.col("own")).alias("home"), "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        tasks = met.select(F.xxhash64("cell", "part", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"), "fp", "home")
        found.append(tasks.repartition("task").sortWithinPartitions("task", "fp").mapInArrow(_compare, "a long, b long"))
    return reduce(DataFrame.unionByName, found).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(id, fingerprint, component_id, n_copies) for each row of docs(id, text).

    Documents link where their fingerprints differ in 3 bits or fewer; component_id is the smallest id reachable.
    Null and empty texts have fingerprint zero, which links like any other. A null id stays null and stands for no
    component unless all of a component's ids are null. Equal fingerprints are one node, of n_copies rows; only
    distinct ones are compared.
    """
    prints = stored(fingerprints(docs, id_col, shingle), "simhash-prints")
    nodes = stored(prints.groupBy("fp").agg(F.min(id_col).alias("first_id"), F.count("*").alias("n_copies")), "simhash-nodes")
    found = components(links(nodes), "simhash")
    joined = nodes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = joined.select("fp", "component", "n_copies").join(least, "component").select("fp", "component_id", "n_copies")
    return prints.join(by_fp, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_copies")
