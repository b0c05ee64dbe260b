"""Connected components and stored tables."""

import numpy as np

from itemloom.llm.common import components, discard, id_remainder, stored


def test_components_of_chains_stars_and_loops(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(200)] + [(500, 500)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1100, (60, 2))]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long"), "none").count() == 0


def test_stored_tables_and_remainders(spark):
    import os
    import zlib

    df = stored(spark.range(10), "t")
    assert df.count() == 10 and os.path.isdir(df.scratch_path)
    discard(df)
    assert not os.path.isdir(df.scratch_path)
    got = {r.id: r.m for r in spark.range(20).select("id", (id_remainder("id", 3)).alias("m")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 for i in range(20)}
