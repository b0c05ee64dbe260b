"""Merges of merges and trees of parents against one merge after the other and plain recursion."""

import random

import pytest

from itemloom.operators import topics as T


def merged(items, pairs):
    """items {id: (name, aliases)}: one merge after the other."""
    items = {k: (n, set(a)) for k, (n, a) in items.items()}
    for source, target in pairs:
        name, aliases = items.pop(source)
        items[target][1].update(aliases | {name})
        items[target][1].discard(items[target][0])
    return sorted((k, n, tuple(sorted(a))) for k, (n, a) in items.items())


@pytest.mark.parametrize("shape", ["chain", "star", "both"])
def test_merges_of_merges(spark, shape):
    rng = random.Random(shape)
    n = 40
    items = {f"k{i}": (f"N{i % 37}", [f"a{i % 11}", f"N{(i + 1) % 37}"]) for i in range(n)}
    target = {"chain": lambda i: i + 1, "star": lambda i: n - 1, "both": lambda i: rng.randint(i + 1, n - 1)}[shape]
    pairs = [(f"k{i}", f"k{target(i)}") for i in range(n - 1) if shape != "both" or i % 4]  # in this order a source is still there
    topics = spark.createDataFrame([(k, name, a) for k, (name, a) in items.items()], "topic_id string, name string, aliases array<string>")
    got = T.merge_topics(topics, spark.createDataFrame(rng.sample(pairs, len(pairs)), "source string, target string"))
    assert sorted((r.topic_id, r.name, tuple(sorted(r.aliases))) for r in got.collect()) == [(k, name, a) for k, name, a in merged(items, pairs)]


@pytest.mark.parametrize("pairs", [[("a", "a")], [("a", "b"), ("a", "c")], [("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")]])
def test_circles_and_two_targets_are_told(spark, pairs):
    with pytest.raises(ValueError, match="merge"):
        T.merge_roots(spark.createDataFrame(pairs, "source string, target string"))


def test_no_merges(spark):
    topics = spark.createDataFrame([("a", "A", ["x"])], "topic_id string, name string, aliases array<string>")
    assert T.merge_topics(topics, spark.createDataFrame([], "source string, target string")).collect() == topics.collect()


def test_tree_is_recursion(spark):
    rng = random.Random(3)
    parent = {i: (None if i % 20 == 0 else rng.randint(max(0, i - 15), i - 1)) for i in range(120)} | {200 + i: 199 + i for i in range(1, 40)} | {200: None, 300: 999, 301: 300}
    path = {i: f"p{rng.randint(0, 30)}" for i in parent}
    n = {i: i % 5 for i in parent if i % 3}
    want = []

    def walk(of, level):
        total = 0
        below = sorted((i for i, p in parent.items() if p == of), key=lambda i: (path[i], i))
        for k, i in enumerate(below):
            more = walk(i, level + 1)
            want.append((i, of, level, k + 1, sum(p == i for p in parent.values()), n.get(i, 0), n.get(i, 0) + more))
            total += n.get(i, 0) + more
        return total

    walk(None, 1)
    nodes = spark.createDataFrame([(i, p, path[i]) for i, p in parent.items()], "topic_id long, parent_id long, path string")
    got = T.topic_tree(nodes, spark.createDataFrame(list(n.items()), "topic_id long, n long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    with pytest.raises(ValueError, match="circle"):
        T.topic_tree(spark.createDataFrame([(1, 2, ""), (2, 3, ""), (3, 1, "")], "topic_id long, parent_id long, path string"), spark.createDataFrame([], "topic_id long, n long"))
