"""Substrings by trigrams, pages far back and bigram candidates, against plain scans."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemloom.operators import ingest, substring
from itemloom.operators import relational as R

TEXTS = ["abcabc", "ABCD and more", "a", "", None, "x😀y abc", "ring, Ring, RING", "aaaa", "the mirror of light", "a\0b", "mirror\nof", "abcabc"]
ASKS = ["abc", "ABC", "a", "b", "😀", "x😀", "x😀y", "ng", "aaaa", "aaaaa", "", None, "zzz", "mirror\nof", "or of", "bca", "\0", "abc", "r"]


@pytest.mark.parametrize("stored", [True, False])
def test_holders_are_a_scan(spark, tmp_path, stored):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "question_id long, search_text string").withColumn("q", F.lit("clash"))
    queries = spark.createDataFrame(list(enumerate(ASKS)), "query_id long, q string").withColumn("gram", F.lit("clash"))
    tables = substring.write(texts, f"file://{tmp_path}/grams") if stored else ()
    got = [tuple(r) for r in substring.holders(queries, texts, *tables).select("query_id", "question_id").collect()]
    want = {(i, j) for i, q in enumerate(ASKS) for j, t in enumerate(TEXTS) if q and t is not None and q.lower() in t.lower()}
    assert len(got) == len(set(got)) and set(got) == want


def test_holders_of_random_strings(spark):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("ab c"), n))
    texts, asks = [word(int(rng.integers(0, 60))) for _ in range(150)], [word(int(rng.integers(1, 9))) for _ in range(60)]
    t = spark.createDataFrame(list(enumerate(texts)), "question_id long, search_text string")
    q = spark.createDataFrame(list(enumerate(asks)), "query_id long, q string")
    got = {(r.query_id, r.question_id) for r in substring.holders(q, t).collect()}
    assert got == {(i, j) for i, a in enumerate(asks) for j, x in enumerate(texts) if a in x}
    assert substring.holders(q, t.limit(0)).count() == substring.holders(q.limit(0), t).count() == 0


def test_holders_read_few_texts_and_join_by_keys(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"number {i} of all texts, whose end is {i * 7919 % 10007:05d}") for i in range(2000)], "question_id long, search_text string")
    postings, counts = substring.write(texts, f"file://{tmp_path}/grams")
    q = spark.createDataFrame([(1, "end is 00042"), (2, "of all texts, whose end is 0123")], "query_id long, q string")
    plan = substring.holders(q, texts, postings, counts)
    assert substring.candidates(q, postings, counts).count() < 100 and plan.count() == sum("end is 00042" in r.search_text or "end is 0123" in r.search_text for r in texts.collect())
    assert "NestedLoop" not in plan._jdf.queryExecution().toString() and "Cartesian" not in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("skip, limit", [(0, 5), (990, 20), (500, 100), (999, 5), (1000, 5), (5000, 5), (0, 0)])
def test_pages_far_back(spark, skip, limit):
    rows = [(i, i * 37 % 10 if i % 9 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, k long").repartition(7)
    got = [(r.id, r.k, r.total) for r in R.paged(df, [F.desc("k"), F.col("id")], skip, limit, near=0).collect()]
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == [(*r, 1000) for r in order[skip : skip + limit]]
    assert got == [(r.id, r.k, r.total) for r in R.paged(df, [F.desc("k"), F.col("id")], skip, limit).collect()]


def test_page_of_an_empty_table(spark):
    assert R.paged(spark.createDataFrame([], "id long"), [F.col("id")], 3, 5, near=0).count() == 0


@pytest.mark.parametrize("threshold, part", [(0.86, 20_000), (0.5, 3), (0.7, 7)])
def test_bigram_candidates_lose_no_pair_and_are_fewer_than_by_prefixes(spark, threshold, part):
    rng = np.random.default_rng(9)
    base = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 40))) for _ in range(60)]
    stems = list(dict.fromkeys(base + [s[: len(s) // 2] + "z" + s[len(s) // 2 :] for s in base] + [s + "tail" for s in base] + ["q", "r"]))
    grams = [{s[i : i + 2] for i in range(len(s) - 1)} or {s} for s in stems]
    want = {(i, j) for i, j in itertools.permutations(range(len(stems)), 2) if len(grams[i] & grams[j]) / len(grams[j]) > threshold}
    df = spark.createDataFrame(list(enumerate(stems)), "question_id long, stem string")
    met = {tuple(r) for r in ingest.near_candidates(df, threshold, part).select("a", "b").collect()}
    df_of = Counter(g for x in grams for g in x)
    prefix = [set(sorted(g, key=lambda w: (df_of[w], w))[: len(g) - math.ceil(len(g) * threshold) + 1]) for g in grams]
    by_prefix = {(i, j) for i, j in itertools.permutations(range(len(stems)), 2) if grams[i] & prefix[j]}
    assert want <= met < by_prefix
    assert {(r.a, r.b) for r in ingest.near_duplicates(df, threshold).collect()} == want


def test_postings_come_without_a_shuffle_and_strings_of_few_trigrams_are_found(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["abcd ef", "xabc", "bcde", "", None, "aaaa", "ab\U0001F600cd"])], "question_id long, search_text string")
    assert "Exchange" not in substring.gram_postings(texts)._jdf.queryExecution().executedPlan().toString()
    asks = ["abc", "BCD", "abcd ef", "aaa", "zzz", "ab", "b\U0001F600c", ""]
    q = spark.createDataFrame(list(enumerate(asks)), "query_id long, q string")
    got = {tuple(r) for r in substring.holders(q, texts).collect()}
    assert got == {(k, r.question_id) for k, s in enumerate(asks) if s for r in texts.collect() if r.search_text and s.lower() in r.search_text.lower()}


def test_many_strings_meet_each_text_once(spark, monkeypatch):
    """Strings of all lengths over pieces that cut texts, without a shuffle and without postings; characters of several bytes among them."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("ab \u00fc\U0001F600C"), n))
    texts = [word(int(rng.integers(0, 90))) for _ in range(120)] + [None, "", "a" * 70]
    asks = [word(int(rng.integers(1, 12))) for _ in range(60)] + [x[i : i + n] for x in texts[:40] if x for i, n in ((0, 80), (3, 24), (7, 33), (1, 16))] + ["a" * 33, "a" * 71, "A", "", None]
    t = spark.createDataFrame(list(enumerate(texts)), "question_id long, search_text string")
    q = spark.createDataFrame(list(enumerate(asks)), "query_id long, q string")
    want = sorted((i, j) for i, a in enumerate(asks) for j, x in enumerate(texts) if a and x and a.lower() in x.lower())
    assert sorted(map(tuple, substring.scan(q, t, block=50).collect())) == want
    assert "Exchange" not in substring.holders(q, t)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(substring, "PIECE", 64)
    bodies = [x.lower().encode() for x in texts if x]
    strings = [*{a.lower().encode() for a in asks if a}]
    which, row = substring.Strings(strings).within(np.frombuffer(b"".join(bodies), np.uint8), np.cumsum([0, *map(len, bodies)]))
    assert list(zip(which.tolist(), row.tolist(), strict=True)) == [(k, j) for k, s in enumerate(strings) for j, b in enumerate(bodies) if s in b]
