"""Importance resampling against a plain version that spells every n-gram out."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from itemloom.llm import importance, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def plain_resample(docs, target, percent=5, least=20):
    found = [(d, *plain_features(t)) for d, t in docs]
    s, t = Counter(b for _, f, _ in found for b in f), Counter(b for x in target for b in plain_features(x)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    rows = []
    for d, f, n in found:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append([d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((d, f, w, s, ranks.get(id(r))) for r in rows for d, f, w, s, _ in [r]), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("folder", ["0.001", "0.01"])
def test_query_is_brute_force(spark, sf, folder):
    sf = sf.replace("0.001", folder)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    assert got(queries.op13_importance(spark, sf)) == plain_resample(docs, target)


def test_odd_rows(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["Alpha", "béta", "x9", "東京", "w" * 200]) for _ in range(n))
    rows = [(k, text(rng.randint(15, 60)), 1, "a") for k in range(150)]
    rows += [(k, rows[0][1], 1, "b") for k in range(200, 260)] + [rows[3]] * 20 + [(None, text(30), 1, "c")] * 20 + [(301, None, None, None), (302, "", 1, ""), (303, "\x00\x7f ..", 1, ""), (304, "one", 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, weight int, rank string")
    target = [None, "", "béta alpha x9", text(40)]
    table = spark.createDataFrame([(t, "k") for t in target], "text string, n string")
    assert got(importance.resample(docs, table)) == plain_resample([r[:2] for r in rows], target)
    assert got(importance.resample(docs.limit(0), table)) == []
    empty = got(importance.resample(docs, table.limit(0)))
    assert empty == plain_resample([r[:2] for r in rows], [])


def test_pieces_and_batches_count_alike():
    """Texts of all lengths, cut into pieces and batches of a few bytes, have the n-grams of the whole."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab Z9é,\n") for _ in range(rng.randint(0, 400))).encode() for _ in range(60)] + [b"a b " * 3000, b"", None, b"q" * 5000 + b" r"]
    for chunk in (1, 10, 97, 1 << 20):
        counts, words = [Counter() for _ in texts], np.zeros(len(texts), int)
        for w, found, places in importance.Ngrams(chunk=chunk)(texts):
            words += w
            for x, k in zip(found, places, strict=True):
                for b, d in zip(x.tolist(), k.tolist(), strict=True):
                    counts[d][b] += 1
        want = [plain_features((t or b"").decode()) for t in texts]
        assert counts == [Counter(f) for f, _ in want] and words.tolist() == [n for _, n in want]


def test_invalid_utf8(spark):
    docs = spark.sql("select 1L doc_id, cast(x'41ff42' as string) text")
    assert [r.n_features for r in importance.resample(docs, docs).collect()] == [1]


def test_crc_of_long_words():
    a = np.array([zlib.crc32(b"abc"), 5], np.uint32)
    for n in (0, 1, 63, 64, 65, 1000):
        tail = bytes(range(256))[:200] * 5
        assert importance.shifted(a[:1], np.array([n]))[0] ^ zlib.crc32(tail[:n]) == zlib.crc32(b"abc" + tail[:n])
