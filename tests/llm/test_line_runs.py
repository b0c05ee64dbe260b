"""Blocks of short lines whose partner isn't the first document of any of their lines, against brute force over all pairs."""

import numpy as np
import pytest

from itemloom.llm import line_dedup


def plain(rows, least=10):
    """Every document against every earlier one: lines of common runs of neighbours with enough words."""
    out = {i: set() for i, _ in rows}
    split = {i: t.split("\n") for i, t in rows}
    for d, mine in split.items():
        for e, other in split.items():
            for i in range(len(mine)) if e < d else ():
                for j in range(len(other)):
                    k = 0
                    while i + k < len(mine) and j + k < len(other) and mine[i + k] == other[j + k]:
                        k += 1
                    if sum(len(x.split()) for x in mine[i : i + k]) >= least:
                        out[d] |= set(range(i, i + k))
    return out


def test_block_of_two_later_documents(spark):
    rng = np.random.default_rng(0)
    rows, at = [], 0
    for g, sizes in enumerate([(9, 9), (6, 6, 6), (10, 3), (3, 10), (6, 3, 6), (1,) * 12, (4, 4, 4, 4), (9, 1)]):
        lines = [" ".join(f"g{g}l{k}w{w}" for w in range(n)) for k, n in enumerate(sizes)]
        for line in lines:  # each line stands earlier, alone
            rows.append((at := at + 1, f"own {at}\n{line}\nend {at}"))
        block = "\n".join(lines)
        for _ in range(3):
            rows.append((at := at + 1, f"begin {at} {rng.integers(1 << 30)}\n{block}\nlast {at}"))
    want = plain(rows)
    got = {r.doc_id: set(r.dropped) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want and sum(map(len, want.values())) > 40


@pytest.mark.parametrize("n", [5, 9, 50])
def test_moved_runs(spark, n):
    """The first document holds two lines the other way round than all others: these lose both."""
    one, two = " ".join(f"a{k}" for k in range(12)), " ".join(f"b{k}" for k in range(14))
    rows = [(1, f"{two}\n{one}"), *((k, f"own {k}\n{one}\n{two}\nend {k}") for k in range(2, n + 1))]
    want = plain(rows)
    got = {r.doc_id: set(r.dropped) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want and all(want[k] == {1, 2} for k in range(2, n + 1))


def test_pairs_dont_grow_with_squares(spark):
    """A run in many documents makes one pair for each of them but the first."""
    line = " ".join(f"a{k}" for k in range(12))
    docs = spark.createDataFrame([(k, f"{line}\nown {k}") for k in range(300)], "doc long, text string")
    assert line_dedup.pairs_of(line_dedup.held_lines(docs, ["doc"])).count() == 299


def test_random_blocks_that_repeat_and_move(spark):
    """Few different lines of few words: blocks repeat within documents, overlap and move."""
    rng = np.random.default_rng(4)
    lines = [" ".join(f"l{k}w{w}" for w in range(n)) for k, n in enumerate((6, 6, 3, 4, 11, 5))]
    rows = [(i, "\n".join(lines[k] for k in rng.integers(0, len(lines), rng.integers(1, 9)))) for i in range(60)]
    want = plain(rows)
    got = {r.doc_id: set(r.dropped) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want
