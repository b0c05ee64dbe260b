"""The Katz model against one process with plain dicts, its normalisation, and odd rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from itemloom.llm import katz, queries
from tests.llm.test_ops_a import ODD, ODD_ROWS


def tokens_of(text):
    return [*(text or "").encode().lower().split(), b"\n"]


class Plain:
    """Katz by its definition, recursively, over dicts of grams."""

    def __init__(self, texts, order=2):
        self.order, self.counts = order, [Counter() for _ in range(order)]
        for t in texts:
            w = [*[b"\t"] * (order - 1), *tokens_of(t)]
            for i in range(order - 1, len(w)):
                for k in range(order):
                    self.counts[k][tuple(w[i - k : i + 1])] += 1
        self.n, self.v = sum(self.counts[0].values()), len(self.counts[0])
        self.d = [katz.discounts(Counter(c.values())) for c in self.counts]
        self.after = defaultdict(dict)
        for c in self.counts[1:]:
            for g, m in c.items():
                self.after[g[:-1]][g[-1]] = m
        self.left = 1 - sum(self.disc(c, 0) for c in self.counts[0].values()) / self.n
        self.alpha = {}

    def disc(self, c, k):
        return self.d[k][c] * c if c <= 5 else c - self.d[k][-1]

    def p(self, h, w):
        if not h:
            return self.disc(self.counts[0][w,], 0) / self.n if (w,) in self.counts[0] else self.left
        seen = self.after.get(h)
        if seen is None:
            return self.p(h[1:], w)
        total = sum(seen.values())
        if w in seen:
            return self.disc(seen[w], len(h)) / total
        if h not in self.alpha:
            self.alpha[h] = (1 - sum(self.disc(c, len(h)) for c in seen.values()) / total) / (1 - sum(self.p(h[1:], x) for x in seen))
        return self.alpha[h] * self.p(h[1:], w)

    def score(self, text):
        w = [*[b"\t"] * (self.order - 1), *tokens_of(text)]
        return sum(math.log10(self.p(tuple(w[i - self.order + 1 : i]), w[i])) for i in range(self.order - 1, len(w)))


@pytest.mark.parametrize(("order", "heads"), [(2, (1 << 18, 1 << 20)), (2, (40, 30)), (2, (0, 0)), (1, (50, 0)), (3, (300, 200))])
def test_scores_are_those_of_plain_katz(spark, sf, order, heads):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    plain = Plain([t for i, t in texts.items() if i % 3], order)
    words = plain.counts[0]
    got = {r.doc_id: r for r in katz.score(docs, katz.fit(docs.filter("doc_id % 3 <> 0"), order, *heads)).collect()}
    for i, t in texts.items():
        w = tokens_of(t)
        assert got[i].n_tokens == len(w) and got[i].n_known == sum((x,) in words for x in w)
        assert abs(got[i].base_score - sum(math.log10((words[x,] + 0.5) / (plain.n + 0.5 * (plain.v + 1))) for x in w)) < 1e-4
        assert abs(got[i].score - plain.score(t)) < 1e-3 + 1e-6 * abs(plain.score(t))


def test_distributions_sum_to_one(spark, sf):
    plain = Plain([r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()], 3)
    for h in list(plain.after)[:80]:
        assert abs(sum(plain.p(h, w) for w in [*(g[0] for g in plain.counts[0]), b"never seen"]) - 1) < 1e-9
    d = katz.discounts({1: 100, 2: 40, 3: 20, 4: 12, 5: 9, 6: 7})
    assert (0 < d[1:6]).all() and (d[1:6] < 1).all() and 0 < d[6] < 1
    assert (katz.discounts({}) > 0).all()


def test_word_keys():
    """Words that a polynomial modulo 2^64 gives one key, and words that differ in one place or in length."""
    for k in (10, 11, 12):
        thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << k))
        words = [thue, thue.translate(str.maketrans("ab", "ba"))]
        assert len(set(katz.word_keys(" ".join(words).encode())[1][0].tolist())) == 2
    rng = np.random.default_rng(0)
    words = sorted({bytes(rng.integers(97, 100, rng.integers(1, 40)).astype(np.uint8)) for _ in range(20_000)} | {b"a" * n for n in range(1, 600)} | {b"\x00" * n for n in range(1, 20)})
    at, (keys,) = katz.word_keys(b" ".join(words))
    assert len(at) == len(words) == len(set(keys.tolist()))
    assert (katz.word_keys(b"\n ".join(w.upper() for w in words))[1][0] == keys).all()
    assert len(katz.word_keys(b" \n")[0]) == len(katz.word_keys(b"")[0]) == 0
    table = katz.Table({"w": keys})
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + 1) == -1).sum() > len(keys) - 5


def test_seed(spark):
    docs = spark.createDataFrame([("a b",), ("b a c",)], "text string")
    assert katz.fit(docs).seed == 0
    assert katz.fit(docs, seed=3).seed == 3


def test_query(spark, sf):
    got = queries.op7_katz(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    held = docs.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 1)
    assert len(got) == len(docs) and got.held_out.sum() == held.sum()
    assert (got.train_tokens == sum(len(tokens_of(t)) for t in docs.text[~held])).all()
    held_out = got[got.held_out]
    assert held_out.score.sum() > held_out.base_score.sum()


def test_odd(spark):
    odd = spark.createDataFrame(ODD_ROWS, ODD)
    out = katz.score(odd, katz.fit(odd)).collect()
    assert len(out) == len(ODD_ROWS) and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in out)
    assert len({r.score for r in out if r.doc_id == 5}) == 1
    empty = odd.limit(0)
    assert katz.score(empty, katz.fit(odd)).count() == 0
    assert {r.score for r in katz.score(odd, katz.fit(empty)).collect()} == {0.0}
