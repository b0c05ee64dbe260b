"""Mixing, site quality, decontamination, line dedup and the pipeline, against brute force, labels and odd rows."""

import difflib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from itemloom.llm import decontaminate, evidence, line_dedup, mixing, queries, site_quality
from tests.llm.test_ops_a import ODD, ODD_ROWS


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, ODD)


@pytest.fixture(scope="module")
def medium(sf):
    return sf.replace("0.001", "0.01")


# --- decontamination


def plain_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def test_contaminated_is_brute_force(spark, medium):
    """Every window of every item along every diagonal."""
    docs = spark.read.parquet(f"{medium}/documents.parquet").toPandas()
    items = spark.read.parquet(f"{medium}/benchmark.parquet").toPandas()
    got = {(r.doc_id, r.item_id): r.matched for r in queries.op5_decontaminate(spark, medium).collect()}
    want = {}
    listed = [(i, plain_words(t)) for i, t in zip(items.item_id, items.text, strict=True)]
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        w = plain_words(t)
        at = defaultdict(list)
        for p, x in enumerate(w):
            at[x].append(p)
        for i, item in listed:
            k = min(len(item), 20)
            diagonals = {p - q for q, x in enumerate(item) for p in at.get(x, ())}
            for s in diagonals:
                same = [0 <= s + q < len(w) and w[s + q] == x for q, x in enumerate(item)]
                if sum(same) < 0.8 * k:
                    continue
                for a in range(len(item) - k + 1):
                    if sum(same[a : a + k]) >= 0.8 * k:
                        want[d, i] = max(want.get((d, i), 0), sum(same[a : a + k]))
    assert got == want and got


def test_contaminated_counts_words_around_the_hit(spark):
    """A long item that shares one phrase, and common words in line far from it, with documents that are not its passages."""
    rng = np.random.default_rng(3)
    common = [f"the{k}" for k in range(12)]
    item = rng.choice(common, 2000).tolist()
    phrase = [f"rare{k}" for k in range(8)]
    item[1000:1008] = phrase
    rows = [(i, " ".join([*rng.choice(common, 1000).tolist(), *phrase, *rng.choice(common, 992).tolist()])) for i in range(20)] + [(99, " ".join(item[990:1020]))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for most in (decontaminate.MOST_SENT, 0):
        assert [(r.doc_id, r.matched) for r in decontaminate.contaminated(docs, bench, most_sent=most).collect()] == [(99, 20)]


def test_contaminated_with_substitutions_and_odd_rows(spark, odd):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango"
    swapped = item.replace("delta", "xx").replace("juliet", "yy").replace("papa", "zz")
    docs = spark.createDataFrame([(1, f"Before. {swapped.upper()}, after", 1), (2, item.replace(" ", "\n"), 1), (3, " ".join(item.split()[:10]), 1), (4, " ".join(item.split()[2:]), 1), (4, None, 1), (None, item, 1)], "doc_id long, text string, w int")
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.matched) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 7, 17), (2, 7, 20), (4, 7, 18), (None, 7, 20)}
    assert {tuple(r) for r in decontaminate.contaminated(docs, bench, most_sent=0).collect()} == {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()}
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.contaminated(odd.limit(0), bench).count() == 0 and decontaminate.contaminated(odd, bench.limit(0)).count() == 0


# --- quality and mixing


def test_evidence_finds_labels(spark, medium):
    docs, labels = spark.read.parquet(f"{medium}/documents.parquet"), spark.read.parquet(f"{medium}/labels.parquet")
    got = queries.op3_site_quality(spark, medium).join(labels.select("doc_id", F_quality()), "doc_id").toPandas()
    assert len(got) == labels.count() and ((got.quality >= 0.5) == (got.label > 0)).mean() > 0.95
    assert got.keep[got.label > 0].mean() > 0.98
    assert docs.count() == queries.op3_site_quality(spark, medium).count()


def F_quality():
    from pyspark.sql import functions as F

    return F.col("quality").alias("label")


def test_site_priors_shrink(spark):
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    rows = [(i, "good words here" if i % 4 else "bad ### signs", "a" if i < 300 else "b", "a/x") for i in range(400)]
    rows += [(1000 + i, "good words here", "small", "small/1") for i in range(1)] + [(1001 + i, "bad ### signs", "junk", f"junk/{i % 2}") for i in range(60)] + [(None, None, None, None)]
    got = {r.doc_id: r for r in site_quality.site_quality(spark.createDataFrame(rows, "doc_id long, text string, host string, path string"), labels).collect()}
    assert len(got) == 462 and got[None].host == ""
    assert got[1010].host_prior < got[1000].host_prior and got[1010].path_prior < got[1].path_prior
    assert got[1].keep and not got[0].keep and got[1000].keep


def test_site_quality_is_brute_force(spark, medium):
    """All columns of the query again from its evidence, in one process."""
    got = queries.op3_site_quality(spark, medium).toPandas()
    docs = spark.read.parquet(f"{medium}/documents.parquet").toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{medium}/labels.parquet").toPandas()
    prior = ((labels.quality > 0).sum() + 0.5) / (len(labels) + 1)
    got["q"] = 1 / (1 + np.exp(-(got.evidence + np.log(prior / (1 - prior)))))

    def strength(g, center):
        g, center = g[g.n > 1], center[g.n > 1]
        inside = max((g.n * center * (1 - center)).sum() / g.n.sum(), 1e-12)
        spread = ((g.n * (g.s / g.n - center) ** 2).sum() - (len(g) - 1) * inside) / max(g.n.sum() - (g.n**2).sum() / g.n.sum(), 1e-9)
        return min(max(inside / spread - 1, 2.0), 10_000.0) if spread > 0 else 10_000.0

    assert (got.host == docs.source.reindex(got.doc_id).fillna("").to_numpy()).all()
    mean = got.q.mean()
    hosts = got.groupby("host").q.agg(n="size", s="sum")
    h = strength(hosts, np.full(len(hosts), mean))
    paths = got.groupby(["host", "path"]).q.agg(n="size", s="sum").reset_index()
    of = hosts.loc[paths.host]
    p = strength(paths, ((h * mean + of.s) / (h + of.n)).to_numpy())
    hn, hs = (hosts[c].reindex(got.host).to_numpy() for c in "ns")
    keyed = paths.set_index(["host", "path"])
    pn, ps = (keyed[c].reindex(list(zip(got.host, got.path, strict=True))).to_numpy() for c in "ns")
    host_prior = (h * mean + hs - got.q) / (h + hn - 1)
    path_prior = (p * host_prior + ps - got.q) / (p + pn - 1)
    quality = 1 / (1 + np.exp(-(got.evidence + np.log(path_prior / (1 - path_prior)))))
    for name, want in (("host_prior", host_prior), ("path_prior", path_prior), ("quality", quality)):
        assert np.allclose(got[name], want, atol=1e-3), name
    assert (got.keep == (got.quality >= 0.5)).all()


def test_no_labels_and_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = odd.selectExpr("doc_id", "text", "source as host", "lang as path", "1 as q", "2 as rate")
    assert site_quality.site_quality(docs, none).count() == len(ODD_ROWS)
    assert site_quality.site_quality(docs.limit(0), none).count() == 0
    some = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (6, None, 1), (None, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert mixing.mix(docs, some).count() == len(ODD_ROWS)
    assert mixing.mix(docs.limit(0), some).count() == 0 and mixing.mix(docs, none).count() == len(ODD_ROWS)
    assert site_quality.site_quality(docs, some).count() == len(ODD_ROWS)


def test_rates_meet_targets_like_plain_descent(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.2] * 4, 500).round(9)
    t = rng.integers(0, 1000, 500)
    members = spark.createDataFrame([(i, int(n), x.tolist()) for i, (n, x) in enumerate(zip(t, p, strict=True))], "doc_id long, n_tokens long, p array<double>").repartition(5)
    targets = {"clean": 0.5, "low": 0.3, "toxic": 0.1, "low_toxic": 0.1}
    descent, report = mixing.fit_rates(members, list(targets.values()))
    assert np.abs(report["totals"] - report["targets"]).max() < 0.02 * t.sum()
    x = np.array([r.rate for r in mixing.with_rates(members, descent).orderBy("doc_id").collect()])
    assert (x >= 0).all() and np.allclose((x * t) @ p, report["totals"], rtol=1e-4)
    # the optimum by plain projected gradients in one process
    share = np.array(list(targets.values()))
    now = t @ p
    goal, n = share * now[0] / share[0], t.sum()
    y = np.ones(500)
    for _ in range(20_000):
        y = np.maximum(0, y - 0.2 * (p @ ((n / now) * ((y * t) @ p - goal) / n) + mixing.RIDGE * (y - 1)))
    cost = lambda z: (((z * t) @ p - goal) ** 2 * n / now).sum() / n**2 / 2 + mixing.RIDGE / 2 * (t * (z - 1) ** 2).sum() / n
    assert cost(x) <= cost(y) * 1.05 + 1e-6
    copies = mixing.taken(spark.range(20_000).selectExpr("id as doc_id", "1.25D as rate"), most=5).toPandas().copies
    assert set(copies) == {1, 2} and abs(copies.mean() - 1.25) < 0.02


def plain_rates(p, t, share, steps=20_000):
    """The optimum by plain projected gradients in one process."""
    now, n = t @ p, t.sum()
    goal, w = share * now[share.argmax()] / share.max(), n / np.maximum(now, 1e-9 * n)
    step = 1 / (np.linalg.eigvalsh(np.sqrt(w)[:, None] * (p.T * t @ p / n) * np.sqrt(w)).max() + mixing.RIDGE)
    x = y = np.ones(len(t))
    for k in range(steps):
        new = np.maximum(0, y - step * (p @ (w * ((y * t) @ p - goal) / n) + mixing.RIDGE * (y - 1)))
        x, y = new, new + k / (k + 3) * (new - x)
    return x


def test_mix_with_domains_of_its_own_is_brute_force(spark):
    """Three domains of one label column, and targets that need rates above 1: the whole operator against exact rates from its exact posteriors."""
    rng = np.random.default_rng(5)
    kinds = rng.choice(3, 600, p=[0.7, 0.2, 0.1])
    words = [[f"w{k}x{j}" for j in range(30)] for k in range(3)]
    texts = [" ".join(rng.choice(words[k], 12 + k).tolist() + rng.choice(words[(k + 1) % 3], int(rng.integers(0, 9))).tolist()) for k in kinds]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, "news wiki code".split()[k]) for i, k in enumerate(kinds.tolist()) if i % 2], "doc_id long, kind string")
    domains, targets = {d: (d,) for d in ("news", "wiki", "code")}, {"news": 0.34, "wiki": 0.33, "code": 0.33}
    members = {r.doc_id: r for r in mixing.posteriors(docs, labels, domains=domains, label_columns=["kind"]).collect()}
    got = {r.doc_id: r for r in mixing.mix(docs, labels, targets, budget=None, domains=domains, label_columns=["kind"]).collect()}
    ids = sorted(members)
    p, t = np.array([members[i].p for i in ids]), np.array([members[i].n_tokens for i in ids], float)
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == kinds).mean() > 0.95 and t.tolist() == [len(x.split()) for x in texts]
    x = np.array([got[i].rate for i in ids])
    want = plain_rates(p, t, np.array(list(targets.values())))
    assert np.abs((x * t) @ p - (want * t) @ p).max() < 0.02 * t.sum() and x.max() > 1.5 and x.min() >= 0
    assert np.allclose([[got[i][f"p_{d}"] for d in domains] for i in ids], p, atol=1e-6)


@pytest.mark.parametrize("there", [(0, 1, 2, 3), (0, 1, 3), (0, 3), (0, 2)])
def test_default_domains_some_of_them_empty(spark, there):
    """The four default domains, of which some have no document: exact rates from the operator's posteriors, by plain descent."""
    rng = np.random.default_rng(sum(there))
    share = np.array([0.7, 0.12, 0.03, 0.15])[list(there)]
    kinds = rng.choice(there, 600, p=share / share.sum())
    texts = [" ".join(rng.choice([f"w{k}x{j}" for j in range(30)], 14).tolist() + rng.choice([f"all{j}" for j in range(30)], int(rng.integers(0, 9))).tolist()) for k in kinds]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, *list(mixing.DOMAINS.values())[k]) for i, k in enumerate(kinds.tolist()) if i % 3], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in mixing.mix(docs, labels).collect()}
    p, t = np.array([[got[i][f"p_{d}"] for d in mixing.DOMAINS] for i in range(600)]), np.array([len(x.split()) for x in texts], float)
    assert (p.argmax(axis=1) == kinds).all() and all(k in there or not p[:, k].any() for k in range(4))
    wanted = np.array([0.98, 0.02, 0, 0])
    now, n = t @ p, t.sum()
    goal = np.minimum(wanted * now[0] / 0.98, mixing.MOST_TIMES * now)
    w = np.where(now > 0, n / np.maximum(now, mixing.LEAST_SHARE * n), 0.0) * (((now >= mixing.LEAST_SHARE * n) | (wanted == 0)))
    step = 1 / (np.linalg.eigvalsh(np.sqrt(w)[:, None] * (p.T * t @ p / n) * np.sqrt(w)).max() + mixing.RIDGE)
    x = y = np.ones(600)
    for k in range(20_000):
        new = np.maximum(0, y - step * (p @ (w * ((y * t) @ p - goal) / n) + mixing.RIDGE * (y - 1)))
        x, y = new, new + k / (k + 3) * (new - x)
    rates = np.array([got[i].rate for i in range(600)])
    assert np.abs((rates * t) @ p - (x * t) @ p).max() < 0.01 * n
    assert rates[kinds >= 2].max(initial=0) < 0.1 and rates[kinds == 0].min() > 0.85
    for near in np.unique(p.round(2), axis=0):  # like documents have like rates
        own = rates[(p.round(2) == near).all(axis=1)]
        assert own.max() - own.min() < 0.1


def test_rare_toxic_documents_are_driven_out(spark):
    """One document in a thousand, of a domain with the target 0; a domain that is asked for and isn't there is told."""
    rows = [(i, 10, [1.0 - 2e-8, 1e-8, 0.0, 1e-8]) for i in range(999)] + [(999, 10, [0.0, 0.0, 0.0, 1.0])]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>")
    descent, report = mixing.fit_rates(members, list(mixing.TARGETS.values()))
    rates = {r.doc_id: r.rate for r in mixing.with_rates(members, descent).collect()}
    assert rates[999] < 0.05 and min(rates[i] for i in range(999)) > 0.9 and report["unreached"] == [1]


def test_features_are_those_of_one_regular_expression():
    import re

    import xxhash

    texts = ["", None, "Hello, world!! ---- ===== x\ny", "A" * 5 + " é中 …!?..;;,,\x00\x01", "one two " * 300_000, " \n\t", "?"]
    places, n_tokens = evidence.Features()(texts)
    for t, own, n in zip(texts, places, n_tokens, strict=True):
        raw = (t or "").encode()
        names = set(re.findall(rb"[a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff\s]{1,4}", raw.lower()))
        plain = {xxhash.xxh64_intdigest(w, 1) % evidence.PLACES for w in names}
        assert plain <= set(own.tolist()) and len(own) <= len(plain) + 5 and n == len(raw.split()) and (np.diff(own) > 0).all()


def test_logistic_separates():
    w, b = evidence.logistic([np.array([0, 1]), np.array([1]), np.array([0]), np.array([], np.int64)] * 50, np.array([1, 0, 1, 0] * 50, float), 2)
    assert w[0] > 2 and abs(w[1]) < 0.5 and b < -1


# --- line dedup


def plain_line_dedup(rows, least):
    """Every document against every earlier one, by one process: all blocks of neighbouring lines with enough words that both have."""
    docs = sorted({(i is None, i, t) for i, t in rows}, key=lambda x: (x[0], x[1] or 0, x[2] or ""))
    lines = {d: [(k, x.strip(" \t\n\v\f\r")) for k, x in enumerate((d[2] or "").split("\n")) if x.strip(" \t\n\v\f\r")] for d in docs}
    places = {}
    for d in docs:
        places[d] = defaultdict(list)
        for k, (_, x) in enumerate(lines[d]):
            places[d][x].append(k)
    drop = defaultdict(set)
    for n, d in enumerate(docs):
        for f in docs[:n]:
            for j, (_, x) in enumerate(lines[d]):
                for i in places[f].get(x, ()):
                    if i and j and lines[f][i - 1][1] == lines[d][j - 1][1]:
                        continue  # not the beginning of a block
                    k = 0
                    while i + k < len(lines[f]) and j + k < len(lines[d]) and lines[f][i + k][1] == lines[d][j + k][1]:
                        k += 1
                    if sum(len(lines[d][j + m][1].split()) for m in range(k)) >= least:
                        drop[d] |= {lines[d][j + m][0] for m in range(k)}
    return {(d[1], d[2]): sorted(drop[d]) for d in docs}


def patience(a, b, a0, a1, b0, b1):
    if a0 >= a1 or b0 >= b1:
        return []
    if a[a0] == b[b0]:
        return [(a0, b0), *patience(a, b, a0 + 1, a1, b0 + 1, b1)]
    if a[a1 - 1] == b[b1 - 1]:
        return [*patience(a, b, a0, a1 - 1, b0, b1 - 1), (a1 - 1, b1 - 1)]
    anchors = [(i, b.index(a[i], b0, b1)) for i in range(a0, a1) if a[a0:a1].count(a[i]) == 1 and b[b0:b1].count(a[i]) == 1]
    if not anchors:
        return []
    weight = lambda run: sum(len(b[j].split()) for _, j in run)
    best = [[x] for x in anchors]
    for k, x in enumerate(anchors):
        for m in range(k):
            if anchors[m][1] < x[1] and weight(best[m]) + weight([x]) > weight(best[k]):
                best[k] = [*best[m], x]
    out, at = [], (a0, b0)
    for i, j in [*max(best, key=weight), (a1, b1)]:
        out += patience(a, b, at[0], i, at[1], j)
        at = (i, j)
    return out


def test_line_dedup_is_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    block = "\n".join(f"line {k} of a passage that stands in many documents" for k in range(8))
    rows += [(10_000 + i, f"own {i}\n{block}\nend {i}") for i in range(30)] + [(20_000, block + "\n" + block), (20_001, "a b\nc d"), (20_002, "a b\nc d")]
    want = plain_line_dedup(rows, 10)
    got = {(r.doc_id): r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert {k: list(got[k[0]].dropped) for k in want} == want
    assert got[10_000].n_dropped == 0 and got[10_005].n_dropped == 8 and got[10_005].text == "own 5\nend 5" and got[20_002].n_dropped == 0


def test_line_dedup_finds_blocks_whose_lines_stand_apart_before(spark):
    """Six documents hold a line each, two later ones all six; a hub and many short documents; a common licence beside a rare block."""
    six = [f"a line of five{k}" for k in range(6)]
    rows = [(i + 1, six[i]) for i in range(6)] + [(20, "\n".join(six)), (21, "\n".join(["x", *six]))]
    hub = [f"line {k} of the hub that every one of these documents quotes in part" for k in range(60)]
    rows += [(100, "\n".join(hub))] + [(101 + k, f"own {k}\n{hub[k]}\nlast {k}") for k in range(60)]
    licence = "this licence line has more than ten words and stands in very many documents"
    rows += [(200 + k, f"{licence}\nunlike {k // 2} any other line here with its words {k // 2}\nlast {k}") for k in range(40)]
    want = plain_line_dedup(rows, 10)
    assert sum(map(len, want.values())) > 60 and want[21, rows[7][1]] == [1, 2, 3, 4, 5, 6]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert {k: list(got[k[0]].dropped) for k in want} == want


def test_patience_order():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 12, rng.integers(0, 15)), rng.integers(0, 12, rng.integers(0, 15))
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    a = np.arange(50)
    b = np.delete(a, [7, 8, 30])
    assert len(line_dedup.patience(a, b)) == sum(m.size for m in difflib.SequenceMatcher(None, a.tolist(), b.tolist()).get_matching_blocks())


def test_line_dedup_odd(spark, odd):
    got = line_dedup.line_dedup(odd)
    assert got.count() == len(ODD_ROWS) and got.filter("text is null").count() == 1
    assert line_dedup.line_dedup(odd.limit(0)).count() == 0
    long = "\n".join(["one two three four five six seven eight nine ten eleven"] * 3)
    rows = spark.createDataFrame([(3, long), (3, long), (None, long), (2, long)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_dropped) for r in line_dedup.line_dedup(rows).collect()), key=repr) == [(2, 0), (3, 3), (3, 3), (None, 3)]


# --- pipeline


def test_pipeline_stages(spark, medium):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{medium}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    toxic = {r.doc_id for r in spark.read.parquet(f"{medium}/labels.parquet").filter("toxic = 1").collect()}
    for name, stage in cp.STAGES[:-1]:
        before, docs = docs, cp.stored(stage(spark, docs, medium), f"test-{name}")
        assert docs.columns == columns, name
        assert docs.join(before, columns, "left_anti").count() == 0
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True)
    last = cp.token_output(spark, docs, medium).collect()
    assert len(last) == seen[-1] and sum(r.doc_id in toxic for r in last) <= 0.3 * len(toxic)
    # the groups by brute force over all pairs: one row of each, the smallest id's
    rows = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()
    sets = {r.doc_id: shingle_set(r.text) for r in rows}
    group = {i: i for i in sets}
    inverted = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for x in sets[i] for j in inverted[x])
        for j, n in shared.items():
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(group, i), root(group, j)
                group[max(a, b)] = min(a, b)
        for x in sets[i]:
            inverted[x].append(i)
    got = {r.doc_id for r in cp.near_duplicates(spark, spark.read.parquet(f"{medium}/documents.parquet"), medium).collect()}
    assert got == {root(group, i) for i in sets}


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}


def root(group, i):
    while group[i] != i:
        i = group[i]
    return i


def test_pipeline_odd(spark, tmp_path):
    import corpus_pipeline as cp

    columns = "doc_id long, text string, lang string, source string, n_chars long"
    labels, bench = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = spark.createDataFrame([r[:5] for r in ODD_ROWS], columns)
    for docs in (odd, odd.limit(0)):
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            docs.count()
