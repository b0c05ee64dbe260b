"""Line dedup by pairwise alignment: documents that share rare line hashes are aligned by patience diff, and the later one loses the common blocks.

A run is a line of LEAST_WORDS words or more, or the shortest run of neighbouring lines with so many from a line onwards or
backwards; the hash of a run is rarer than that of a line. Each line of a block that two documents share lies in a run within the block,
so documents meet exactly where they share a run. A run's documents are aligned with the first of them, which holds the whole run: n
documents make n - 1 pairs however common it is, and as a document loses what it shares with the first holder, wherever it stands there, it
loses all that it shares with any earlier document.

A pair brings only the lines that both documents have: the shorter document's lines ask the longer one's for theirs.
Patience diff anchors at lines that stand once in either document, keeps the run of anchors in the same order that has the
most words, and extends it over equal neighbours. Blocks that it can't align, as they have moved or their lines repeat, are anchored at
the runs that both documents hold.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm.common import discard, stored, texts_of

#: A common block counts from so many words; the lines of a shorter one stay.
LEAST_WORDS = 10
#: A run, or a document of pairs, with more than this part of all rows is hot. So there are fewer hot ones than this, and they
#: are sent to every task.
HOT_PARTS = 10_000
#: Pairs of a hot document that share a copy of its lines.
PAIRS_A_COPY = 2_000


def spans_of(lines: list[int], words: list[int], least_words: int) -> dict[tuple[int, int], int]:
    """The shortest runs of least_words words or more that begin or end at each line, as (start, end): hash."""
    import xxhash

    spans, end, total = set(), 0, 0
    for i in range(len(lines)):  # onwards
        while end < len(lines) and total < least_words:
            total += words[end]
            end += 1
        if total < least_words:
            break
        spans.add((i, end))
        total -= words[i]
    start, total = len(lines), 0
    for j in range(len(lines), 0, -1):  # backwards
        while start > 0 and total < least_words:
            start -= 1
            total += words[start]
        if total < least_words:
            break
        spans.add((start, j))
        total -= words[j - 1]
    raw = np.array(lines, np.int64)
    return {(a, b): xxhash.xxh64_intdigest(raw[a:b].tobytes()) for a, b in spans}


def held_lines(docs: DataFrame, keep: list[str], least_words: int = LEAST_WORDS) -> DataFrame:
    """docs' columns `keep`, and of docs' text the numbers, hashes and words of the lines that have words (compared without white space at their ends), and its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("at", "line", "words", "runs")}
            for text in texts_of(batch.column("text")):
                stripped = [x.strip() for x in (text or "").encode().split(b"\n")]
                at = [k for k, x in enumerate(stripped) if x]
                words = [len(stripped[k].split()) for k in at]
                lines = [digest(stripped[k]) for k in at]
                out["at"].append(at)
                out["words"].append(words)
                out["line"].append(np.array(lines, np.uint64).view(np.int64).tolist())
                out["runs"].append(np.array(sorted(set(spans_of(out["line"][-1], words, least_words).values())), np.uint64).view(np.int64).tolist())
            kinds = {"at": pa.int32(), "words": pa.int32(), "line": pa.int64(), "runs": pa.int64()}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(out[c], pa.list_(kinds[c])) for c in out)], names=[*keep, *out])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "at array<int>", "line array<long>", "words array<int>", "runs array<long>"])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def patience(a: np.ndarray, b: np.ndarray, words: list[int] | None = None) -> list[tuple[int, int]]:
    """Places (i, j) of equal lines in the same order: unique common lines in the increasing run of most words (of b's lines), then neighbours."""
    words = [1] * len(b) if words is None else words
    out: list[tuple[int, int]] = []
    spans = [(0, len(a), 0, len(b))]
    while spans:
        a0, a1, b0, b1 = spans.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once_a, where_a, n_a = np.unique(a[a0:a1], return_index=True, return_counts=True)
        once_b, where_b, n_b = np.unique(b[b0:b1], return_index=True, return_counts=True)
        both, x, y = np.intersect1d(once_a[n_a == 1], once_b[n_b == 1], assume_unique=True, return_indices=True)
        if not len(both):
            continue
        anchors = sorted(zip((where_a[n_a == 1][x] + a0).tolist(), (where_b[n_b == 1][y] + b0).tolist(), strict=True))
        # the run with the most words: a staircase of (second place, words, anchor), both rising
        stairs: list[tuple[int, int, int]] = []
        back = [-1] * len(anchors)
        for k, (_, j) in enumerate(anchors):
            at = bisect_left(stairs, (j,))
            total = words[j] + (stairs[at - 1][1] if at else 0)
            back[k] = stairs[at - 1][2] if at else -1
            if at < len(stairs) and stairs[at][0] == j:
                continue
            end = at
            while end < len(stairs) and stairs[end][1] <= total:
                end += 1
            stairs[at:end] = [(j, total, k)]
        run, k = [], stairs[-1][2]
        while k >= 0:
            run.append(anchors[k])
            k = back[k]
        run.reverse()
        edges = [(a0, b0), *run, (a1, b1)]
        # each part begins with its anchor, which the next pass takes as an equal first line
        spans += [(i, i2, j, j2) for (i, j), (i2, j2) in zip(edges, edges[1:], strict=False) if i < i2 and j < j2]
    return sorted(out)


def common_lines(earlier: dict[str, list], later: dict[str, list], least_words: int) -> list[int]:
    """Line numbers of the later document in common blocks of least_words words or more. Lines without words don't break a block.

    Each side has, in order, its common lines: hashes, words, numbers (at) and numbers among the lines with words (seq).
    """
    a, b = np.array(earlier["line"], np.int64), np.array(later["line"], np.int64)
    drop: set[int] = set()
    block, words, last = [], 0, None
    for i, j in [*patience(a, b, later["words"]), (None, None)]:
        if i is None or last is None or not (i == last[0] + 1 and j == last[1] + 1 and earlier["seq"][i] == earlier["seq"][last[0]] + 1 and later["seq"][j] == later["seq"][last[1]] + 1):
            if words >= least_words:
                drop.update(block)
            block, words = [], 0
        if i is not None:
            block.append(j)
            words += later["words"][j]
            last = (i, j)
    if len(drop) < len(b):  # moved blocks, and lines that repeat
        held = {h for _, part in _neighbours(earlier) for h in spans_of(*part, least_words).values()}
        for base, part in _neighbours(later):
            for (start, end), h in spans_of(*part, least_words).items():
                if h in held:
                    drop.update(range(base + start, base + end))
    return [later["at"][j] for j in sorted(drop)]


def _neighbours(side: dict[str, list]) -> Iterator[tuple[int, tuple[list[int], list[int]]]]:
    """Stretches of a side's lines that stand side by side in the document: the first one's place, hashes and words."""
    edges = [0, *(np.flatnonzero(np.diff(side["seq"]) != 1) + 1).tolist(), len(side["seq"])]
    for i, j in zip(edges, edges[1:], strict=False):
        yield i, (side["line"][i:j], side["words"][i:j])


def pairs_of(held: DataFrame) -> DataFrame:
    """(earlier, later, short, long) of held(doc, line, runs): each document with the first holders of its runs, and which of the two has fewer lines."""
    member = F.struct("doc", F.size("line").alias("n"))
    runs = stored(held.select(member.alias("m"), F.explode("runs").alias("run")), "lines-runs")
    counts = stored(runs.groupBy("run").agg(F.count("*").alias("docs"), F.min("m").alias("first")).filter("docs > 1"), "lines-run-counts")
    hot = counts.filter(F.col("docs") > max(1, (counts.agg(F.sum("docs")).first()[0] or 0) // HOT_PARTS))
    usual = runs.join(counts.join(F.broadcast(hot.select("run")), "run", "left_anti"), "run")
    met = usual.unionByName(runs.join(F.broadcast(hot), "run")).select(F.col("first").alias("e"), F.col("m").alias("l"))
    pairs = met.filter("e.doc <> l.doc").distinct()
    short = F.col("l.n") <= F.col("e.n")
    pairs = stored(pairs.select(F.col("e.doc").alias("earlier"), F.col("l.doc").alias("later"), F.when(short, F.col("l.doc")).otherwise(F.col("e.doc")).alias("short"), F.when(short, F.col("e.doc")).otherwise(F.col("l.doc")).alias("long")), "lines-pairs")
    discard(runs)
    discard(counts)
    return pairs


def aligned(pairs: DataFrame, held: DataFrame, least_words: int) -> DataFrame:
    """(later, earlier, drop): the lines that a later document loses to an earlier one, where there are any."""
    seats = F.transform("line", lambda x, i: F.struct(x.alias("line"), i.alias("seq"), F.get("at", i).alias("at"), F.get("words", i).alias("words")))
    lines = held.select("doc", F.explode(seats).alias("x")).groupBy("doc", "x.line").agg(F.max("x.words").alias("words"), F.array_sort(F.collect_list(F.struct("x.seq", "x.at"))).alias("seats"))
    some = pairs.select(F.explode(F.array("short", "long")).alias("doc")).distinct()
    lines = stored(lines.join(some, "doc", "left_semi"), "lines-of-pairs")
    hubs = pairs.groupBy("long").agg(F.ceil(F.count("*") / PAIRS_A_COPY).cast("int").alias("copies"))
    hubs = hubs.filter(F.col("copies") > max(1, pairs.count() // (HOT_PARTS * PAIRS_A_COPY)))
    salted = pairs.join(F.broadcast(hubs), "long", "left").withColumn("salt", F.pmod(F.xxhash64("short"), F.coalesce("copies", F.lit(1))).cast("int"))
    asking = salted.select("earlier", "later", "short", "long", "salt").join(lines.select(F.col("doc").alias("short"), "line", "words", F.col("seats").alias("s_seats")), "short")
    asked = lines.select(F.col("doc").alias("long"), "line", F.col("seats").alias("l_seats")).join(F.broadcast(hubs), "long", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    late = F.col("later") == F.col("short")
    met = asking.join(asked, ["long", "line", "salt"]).select("earlier", "later", F.struct("line", "words", F.when(late, F.col("l_seats")).otherwise(F.col("s_seats")).alias("e"), F.when(late, F.col("s_seats")).otherwise(F.col("l_seats")).alias("l")).alias("x"))
    grouped = met.groupBy("earlier", "later").agg(F.collect_list("x").alias("xs")).filter(F.aggregate("xs", F.lit(0), lambda s, x: s + x["words"] * F.size(x["l"])) >= least_words)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops = []
            for xs in batch.column("xs").to_pylist():
                sides = []
                for side in ("e", "l"):
                    rows = sorted((seat["seq"], seat["at"], x["line"], x["words"]) for x in xs for seat in x[side])
                    sides.append(dict(zip(("seq", "at", "line", "words"), map(list, zip(*rows, strict=True)), strict=True)))
                drops.append(common_lines(*sides, least_words))
            yield pa.RecordBatch.from_arrays([batch.column("later"), batch.column("earlier"), pa.array(drops, pa.list_(pa.int32()))], names=["later", "earlier", "drop"])

    kind = dict(pairs.dtypes)["later"]
    return grouped.mapInArrow(align, f"later {kind}, earlier {kind}, drop array<int>").filter("size(drop) > 0")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, text, n_lines, n_dropped, partners, dropped) for each row of docs(id, text): text without the blocks it shares with earlier documents.

    partners counts the first holders of its runs to which lines were lost. Every document is compared as it was given, not as other
    comparisons left it, so the result doesn't depend on order. Null stays null and has no lines; repeated rows of an id, and
    rows without an id, are told apart by their text and count as one document each text; a text of several rows keeps its rows.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    # a document is (id, text); the id orders them, nulls last, and the text's hash breaks ties
    ident = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), key.alias("text_key")).alias("doc")
    held = stored(held_lines(docs.select(ident, "text"), ["doc"], least_words).filter("size(runs) > 0"), "lines-held")
    once = stored(held.dropDuplicates(["doc"]), "lines-once")
    pairs = pairs_of(once)
    cut = aligned(pairs, once, least_words).groupBy(F.col("later").alias("doc")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("drop")))).alias("dropped"), F.count("*").alias("partners"))
    cut = stored(cut, "lines-cut")
    for table in (held, once, pairs):
        discard(table)
    # a merge join at every size: texts are shuffled once, and a common text's rows can be split
    whole = docs.select(F.col(id_col), "text", ident).join(cut.hint("merge"), "doc", "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    parts = F.split("text", "\n")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("dropped", i)), "\n")
    text = F.when(F.size("dropped") == 0, F.col("text")).otherwise(kept)
    return whole.select(id_col, text.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), F.coalesce("partners", F.lit(0)).alias("partners"), "dropped")
