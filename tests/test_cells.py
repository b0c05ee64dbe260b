"""Nearest vectors from cells against the full scan."""

import numpy as np
import pytest

from itemloom.operators import cells
from itemloom.operators import search as S


def tables(spark, m, every=5, more=()):
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + list(more), "question_id long, vector array<double>").repartition(5)
    return v, v.filter(f"question_id % {every} = 0").withColumnRenamed("question_id", "query_id")


def hits(df):
    return {(r.query_id, r.question_id, r.score, r["rank"]) for r in df.collect()}


def clustered(rng, n, dim, groups=12, noise=0.15):
    return rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, dim))


@pytest.mark.parametrize("shape", ["random", "clustered", "one point"])
@pytest.mark.parametrize("k, floor, part, block", [(7, 0.18, 8192, 4096), (3, 0.5, 16, 8)])
def test_cells_equal_the_scan(spark, tmp_path, shape, k, floor, part, block):
    rng = np.random.default_rng(4)
    m = {"random": rng.normal(size=(240, 8)), "clustered": clustered(rng, 240, 8), "one point": np.ones((240, 8))}[shape]
    v, q = tables(spark, m)
    store = cells.write(v, f"file://{tmp_path}/cells", 8, part=part)
    assert store.members.count() == 240
    got, want = (hits(x) for x in (cells.vector_topk(q, store, k, floor, block), S.vector_topk(q, v, k, floor)))
    assert got == want and got


def test_clusters_are_mostly_left_out(spark, tmp_path):
    rng = np.random.default_rng(6)
    v, q = tables(spark, clustered(rng, 800, 32, noise=0.05))
    r = cells.share_read(q, cells.write(v, f"file://{tmp_path}/cells", 32)).first()
    assert r.pairs == 800 * 160 and 0 < r.visited < r.pairs / 4


def test_odd_vectors_have_no_hits(spark, tmp_path):
    odd = [(1000, None), (1005, [0.0] * 4), (1010, [1.0, 2.0]), (1015, [1.0, None, 0.0, 1.0]), (1020, [float("nan")] * 4), (1025, [float("inf"), 0.0, 0.0, 0.0]), (1030, [])]
    v, q = tables(spark, np.random.default_rng(2).normal(size=(40, 4)), more=odd)
    store = cells.write(v, f"file://{tmp_path}/cells", 4)
    got = hits(cells.vector_topk(q, store, 5))
    assert got and all(a < 40 and b < 40 for a, b, *_ in got)
    clean = v.filter("question_id < 40")
    assert got == hits(S.vector_topk(clean.filter("question_id % 5 = 0").withColumnRenamed("question_id", "query_id"), clean, 5))
    with pytest.raises(ValueError):
        cells.vector_topk(q, store, floor=0.0)


def test_empty_tables(spark, tmp_path):
    v, q = tables(spark, np.eye(4))
    assert cells.vector_topk(q, cells.write(v.limit(0), f"file://{tmp_path}/none", 4)).count() == 0
    assert cells.vector_topk(q.limit(0), cells.write(v, f"file://{tmp_path}/some", 4)).count() == 0


def test_bounds_are_made_for_some_queries_at_a_time(spark, monkeypatch):
    """A query has a row for each cell at most, so what is held grows with neither the batch nor the table."""
    import pandas as pd
    from itemloom.operators import cells as C

    class Queries:
        sparkSession, dtypes = spark, [("query_id", "bigint")]
        mapInPandas = lambda self, f, schema: list(f(iter([frame])))

    cells = spark.createDataFrame([(i, [float(i == 0), float(i == 1), 1.0], 0.5, 9, 1, 0) for i in range(3)], "cell int, centre array<double>, angle double, n long, parts int, shelf int")
    frame = pd.DataFrame({"query_id": range(3 * C.ASKING + 1), "vector": [[1.0, 1.0, float(i)] for i in range(3 * C.ASKING + 1)]})
    monkeypatch.setattr(C, "usable", lambda q, *_: q)
    made = C.bounds(Queries(), C.Store(None, cells), 5)
    assert len(made) == 4 and max(map(len, made)) <= 3 * C.ASKING and set(pd.concat(made)["query_id"]) == set(frame["query_id"])
