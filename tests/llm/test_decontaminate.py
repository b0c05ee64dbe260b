"""Seeds hit every passage that counts; short items, repetitive texts and both ways of joining."""

import itertools
import time

import pytest

from itemloom.llm import decontaminate as dc

SENT = pytest.mark.parametrize("most_sent", [dc.MOST_SENT, 0])


def test_masks_hit_every_pattern():
    """All ways to replace as many words of 7 to 20 as SHARE allows."""
    for n in range(dc.SHORT, dc.RUN + 1):
        places = [sum(1 << (o + i) for i, m in enumerate(mask) if m == "1") for mask in dc.MASKS for o in range(n - len(mask) + 1)]
        most = max(s for s in range(n) if n - s >= dc.SHARE * n)
        for away in itertools.combinations(range(n), most):
            bad = sum(1 << i for i in away)
            assert any(not p & bad for p in places), (n, away)


@SENT
def test_short_items_and_all_patterns_of_seven_words(spark, most_sent):
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet".split()
    items = [(n, " ".join(f"{w}{n}" for w in words[:n])) for n in range(1, 11)] + [(11, None), (12, "--")]
    docs, want = [], set()
    for n, text in items[:10]:
        for k, away in enumerate([(), *((i,) for i in range(n)), *itertools.combinations(range(n), 2)]):
            docs.append((100 * n + k, " ".join(["so it begins", *("other" if i in away else w for i, w in enumerate(text.split())), "and ends"])))
            if n - len(away) >= dc.SHARE * n:
                want.add((100 * n + k, n, n, n - len(away)))
    found = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most_sent=most_sent)
    assert {(r.doc_id, r.item_id, r.item_words, r.matched) for r in found.collect()} == want


@SENT
def test_long_items_are_looked_at_chunk_by_chunk(spark, most_sent):
    """Passages of 25 words from anywhere in an item of 700, at a document's edges and across its pieces; repeated ids with other texts."""
    item = [f"w{i}x{i * i % 97}" for i in range(700)]
    docs = []
    for k, at in enumerate([0, 30, 44, 50, 63, 64, 100, 333, 660, 675]):
        cut = item[at : at + 25]
        cut[3] = cut[11] = "other"
        filler = [f"f{k}y{i}" for i in range(509 + k)]
        docs += [(10 * k, " ".join(cut)), (10 * k + 1, " ".join(filler + cut)), (10 * k + 2, " ".join(filler + cut + filler)), (7, f"{k} " + " ".join(cut[:9]))]
    docs += [(500, " ".join(item)), (501, " ".join(["x", *item])), (502, " ".join(item[:15])), (503, "one text"), (503, " ".join(item[5:40]))]
    found = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"), most_sent=most_sent)
    got = {r.doc_id: r.matched for r in found.collect()}
    assert got == {d: (20 if d in (500, 501, 503) else 19 if d < 500 else None) for d, _ in docs if d not in (7, 502)}


@SENT
def test_repetitive_texts_take_seconds(spark, most_sent):
    docs = [(1, "same " * 20_000), (2, "a b " * 1_000), (3, "a b c " * 3 + "same " * 5)]
    items = [(1, "same " * 60), (2, "b a " * 30), (3, "a b c " * 20)]
    tables = [spark.createDataFrame(rows, f"{key} long, text string") for rows, key in ((docs, "doc_id"), (items, "item_id"))]
    began = time.time()
    got = {(r.doc_id, r.item_id, r.matched) for r in dc.contaminated(*tables, most_sent=most_sent).collect()}
    assert got == {(1, 1, 20), (2, 2, 20)} and time.time() - began < 60
