"""Overlap of all ids of two sides, by classes."""

import itertools

from itemloom.operators import relational


def test_overlap_of_every_pair_comes_back_from_classes(spark, monkeypatch):
    a = {1: "xy", 2: "yx", 3: "z", 4: "w", 5: "xyz"}
    b = {7: "x", 8: "x", 9: "yz", 6: "q", 10: "zxy"}
    rows = lambda side, key: spark.createDataFrame([(i, v) for i, vs in side.items() for v in vs] + [(99, None)], f"{key} long, v string")
    found = []
    for most in (100, 0):
        monkeypatch.setattr(relational, "MOST_CLASSES", most)
        got = relational.topic_overlaps(rows(a, "question_id"), rows(b, "paper_id"), "question_id", "paper_id", "v").collect()
        class_of = {(r.kind, r.a): r.b for r in got if r.kind != "pair"}
        pairs = {(r.a, r.b): r.overlap for r in got if r.kind == "pair"}
        for x, y in itertools.product(a, b):
            assert pairs.get((class_of["question_id", x], class_of["paper_id", y]), 0) == len(set(a[x]) & set(b[y]))
        assert len(pairs) == 8 and class_of["question_id", 2] == 1 and class_of["paper_id", 8] == 7
        found.append(pairs)
    assert found[0] == found[1]


def test_pairs_of_classes_compare_no_strings(spark, monkeypatch):
    """Classes are bits of as many words as their values need, or lists beyond that; the pairs are the same."""
    a = [(i, f"v{j:03d}") for i in range(40) for j in range(200) if j % (i + 2) == 0]
    b = [(i, f"v{j:03d}") for i in range(30) for j in range(0, 230) if j % (i + 3) == 1]
    one, other = spark.createDataFrame(a, "question_id long, v string"), spark.createDataFrame(b, "paper_id long, v string")
    found = []
    for most in (relational.MOST_VALUES, 10):
        monkeypatch.setattr(relational, "MOST_VALUES", most)
        df = relational.topic_overlaps(one, other, "question_id", "paper_id", "v")
        found.append(sorted(map(tuple, df.collect())))
        assert ("array_intersect" in df._jdf.queryExecution().optimizedPlan().toString()) == (most == 10)
    held = lambda rows: {i: {v for k, v in rows if k == i} for i, _ in rows}
    assert found[0] == found[1]
    assert {x[1:] for x in found[0] if x[0] == "pair"} == {(i, j, len(p & q)) for i, p in held(a).items() for j, q in held(b).items() if p & q}
