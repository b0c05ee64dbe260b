"""A tree of digests against plain comparison of its items, after changes, removals, returns and repeated batches."""

import random

from itemloom.operators import hashtree as H
from itemloom.operators import versions as V


def test_tree_follows_its_items(spark, tmp_path):
    rng, a, b = random.Random(5), str(tmp_path / "a"), str(tmp_path / "b")
    table = lambda rows: spark.createDataFrame(rows, "question_id long, content_hash string")
    roots = lambda p, v=None: tuple(H.root(spark, p, v).first())
    for p in (a, b):
        H.create(spark, p)
    assert roots(a) == (0, 0)
    held = {i: f"h{i}" for i in range(3000)}
    H.update(table(list(held.items())), a, "all")
    parts = list(held.items())
    rng.shuffle(parts)
    for k in range(2):
        H.update(table(parts[k::2]), b, f"part{k}")
    assert roots(a) == roots(b) and roots(a)[0] == 3000
    assert H.diff(spark, a, b).isEmpty()

    moves = {1: "new", 2: None, 5000: "h5000", 7: "h7"}
    for _ in range(2):
        H.update(table(list(moves.items())), b, "moves")
    assert roots(b)[0] == 3000
    got = {(r.question_id, r.hash_a, r.hash_b) for r in H.diff(spark, a, b).collect()}
    assert got == {(1, "h1", "new"), (2, "h2", None), (5000, None, "h5000")}
    assert H.visited(H.unequal(H.nodes(spark, a), H.nodes(spark, b))) == [1, 3, 3, 3, 3]

    before = V.commits(spark, f"{b}/items")[-1].version - 1
    assert roots(b, before) == roots(a)
    assert {r.question_id for r in H.diff(spark, b, b, (before, None)).collect()} == {1, 2, 5000}
    H.update(table([(1, "h1"), (2, "h2"), (5000, None)]), b, "back")
    assert roots(a) == roots(b) and H.diff(spark, a, b).isEmpty()


def test_differences_of_a_killed_update_are_made_up(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    H.create(spark, path, "string")
    rows = spark.createDataFrame([("x", "1"), ("y", "2"), (None, "3")], "question_id string, content_hash string")
    with monkeypatch.context() as m:
        m.setattr(H, "_settle", lambda *_: None)
        H.update(rows, path, "one")
    assert H.root(spark, path).first().n_items == 2
