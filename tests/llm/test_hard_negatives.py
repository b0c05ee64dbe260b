"""Hard negatives against all scores of each anchor, and the curve, bounds and zone maps by themselves."""

import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from itemloom.llm import hard_negatives as hn
from itemloom.llm import queries

KIND = "vec_id long, embedding array<double>, label int, extra string, ids string"


def plain(rows, low=50, high=95):
    """rows (id, vector, label) -> anchor, positive, rank, negative, scores; by row, so copies are rows of their own."""
    ok = [(k, i, [max(-hn.MOST_COMPONENT, min(hn.MOST_COMPONENT, math.floor(256 * float(x)))) for x in v], y) for k, (i, v, y) in enumerate(rows) if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, i, v, y in ok:
        if i % 50:
            continue
        score = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, same) for m, j, w, z in ok if m != k for same in [z == y])
        for p, pid, _ in [x for x in score if x[2]][:5]:
            found = [x for x in score if not x[2] and low * -p <= 100 * -x[0] <= high * -p][:3]
            out += [(i, pid, r + 1, x[1], -p, -x[0]) for r, x in enumerate(found)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def test_query_is_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    found = queries.op12_hard_negatives(spark, sf)
    assert found.columns == [d[0] for d in con.execute(hn.SQL).description]
    assert got(found) == sorted(con.execute(hn.SQL).fetchall()) and found.count()


@pytest.mark.parametrize(("block", "group"), [(4, 3), (64, 1024)])
def test_odd_rows(spark, block, group):
    """Clusters, copies, ties, hot labels, short, empty and extreme vectors, and rows that take no part."""
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(4, 6))
    rows = [(int(k), (centres[k % 4] + rng.normal(size=6) * 0.2).tolist(), int(k % 3 if k % 2 else 0)) for k in range(400)]
    rows += [(k, [0.5] * 6, k % 2) for k in range(1000, 1100)] + [(1050, [0.5] * 6, 0)] * 3 + [(2000, [0.25], 1), (2001, [0.5, 0.5], 2), (2050, [], 1), (2100, [1e300] * 6, 2), (2101, [-1e300] * 6, 1), (2150, [300.0] * 6, 2)]
    rows += [(None, [1.0] * 6, 1), (3000, None, 1), (3050, [1.0, None], 1), (3100, [math.nan] * 6, 1), (3150, [math.inf] * 6, 1), (3200, [1.0] * 6, None), (-50, [0.7] * 6, 2)]
    df = spark.createDataFrame([(*r, "e", "f") for r in rows], KIND)
    assert got(hn.mine(df, block=block, group=group)) == plain(rows)
    assert got(hn.mine(df.limit(0))) == []
    assert got(hn.mine(df.filter("vec_id = 2050"))) == []


def test_zone_maps_keep_blocks_from_being_read(spark):
    """Clusters far apart: groups need few of the other labels' blocks, and the rows are those of all blocks."""
    rng = np.random.default_rng(2)
    rows = [(int(k), (np.eye(8)[k // 10 % 8] * (1 if k % 10 else 1.2) + rng.normal(size=8) * 0.01).tolist(), int(k % 2)) for k in range(800)]
    df = spark.createDataFrame([(*r, "e", "f") for r in rows], KIND)
    assert got(hn.mine(df, block=20, group=4)) == plain(rows)
    usable = hn.usable(df, "vec_id", "embedding", "label", 256)
    blocks = hn.write_blocks(usable, 8, 50, 20)
    assert sorted(r[0] for r in blocks.groupBy().agg({"n": "sum"}).collect()) == [800]
    assert all(r.lo <= r.hi and 0 < r.n <= 20 for r in blocks.collect())
    groups = hn.anchor_groups(blocks, 8, 50, 1).collect()
    zones = blocks.collect()
    read = total = 0
    for g in groups:
        a = np.frombuffer(g["vectors"], "<i8").reshape(-1, 8)
        for z in (z for z in zones if z.label != g.label):
            low, high = hn.bounds(a, np.array([z.lo]), np.array([z.hi]))
            v = hn.scores_of(a, hn._unpacked(bytes(z.vectors), 8))
            assert (low[:, 0] <= v.min(axis=1)).all() and (high[:, 0] >= v.max(axis=1)).all()
            p = (a * a).sum(axis=1)
            total += 1
            read += bool(((high[:, 0] >= p // 2) & (low[:, 0] <= p)).any())
    assert read < total / 2


def test_hilbert_neighbours():
    """The curve passes each cell once, and each step changes one axis by one."""
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        at = hn.hilbert(cells, bits)
        assert sorted(at) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_windows_are_whole_numbers():
    for p in range(-50, 200):
        low, cap = hn.windows_of(np.array([p]), 50, 95)
        want = [n for n in range(-60, 260) if 50 * p <= 100 * n <= 95 * p]
        assert list(range(int(low[0]), int(cap[0]) + 1)) == want


def test_groups_cover_all_anchors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    blocks = hn.write_blocks(hn.usable(rows, "vec_id", "embedding", "label", 256), 64, 50, 32)
    seen = defaultdict(int)
    for g in hn.anchor_groups(blocks, 64, 50, 2).collect():
        for i in np.frombuffer(g["ids"], "<i8").tolist():
            seen[i] += 1
    assert dict(seen) == {r[0]: 1 for r in rows.filter("vec_id % 50 = 0").select("vec_id").collect()}
