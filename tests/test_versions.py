"""A versioned table against a loop over rows in order; streams into it with restarts, repeats and batches killed half way."""

import json
import random

import pytest
from pyspark.sql import functions as F

from itemloom.operators import versions as V
from itemloom.streaming import jobs

ROWS = "question_id string, question_body string, metadata string"


def batch_of(spark, rows):
    return spark.createDataFrame([(*r, k, e) for k, (r, e) in enumerate(rows)], ROWS + ", seq int, errors array<string>")


def by_hand(bank, rows, overwrite):
    """Rows one after the other; of the actions with overwrite only each key's last is compared."""
    out, start = [], dict(bank)
    for (q, body, meta), errors in rows:
        if errors or q is None:
            out.append((q, "reject" if errors else "no key"))
        elif q not in bank:
            bank[q] = (body, meta)
            out.append((q, "insert"))
        elif not overwrite:
            out.append((q, "skip" if bank[q] == (body, meta) else "conflict"))
        else:
            bank[q] = (body, meta if meta is not None else bank[q][1])
            out.append((q, "replace"))
    if overwrite:
        last = {q: k for k, ((q, _, _), e) in enumerate(rows) if not e and q is not None}
        name = lambda q: "insert" if q not in start else "skip" if start[q] == bank[q] else "replace"
        out = [(q, a if a in {"reject", "no key"} else name(q) if last[q] == k else "superseded") for k, (q, a) in enumerate(out)]
    return out


def test_batches_equal_rows_in_order(spark, tmp_path):
    rng, path, bank, snapshots = random.Random(3), str(tmp_path / "bank"), {}, {}
    V.create(spark.createDataFrame([], ROWS), path)
    live = lambda v=None: {r.question_id: (r.question_body, r.metadata) for r in V.read(spark, path, v).collect()}
    for n, overwrite in enumerate((False, False, True, True)):
        pick = lambda: (rng.choice([None, *(f"q{i}" for i in range(25))]), rng.choice("ab"), rng.choice([None, "m", "n"]))
        rows = [(pick(), rng.choice([[], [], [], ["bad"]])) for _ in range(40)]
        rows += rows[:3]
        want = by_hand(bank, rows, overwrite)
        got = V.apply(batch_of(spark, rows), path, f"b{n}", overwrite=overwrite, keep=("metadata",), errors="errors").orderBy("seq").collect()
        assert [(r.question_id, r.action) for r in got] == want
        assert live() == bank
        snapshots[V.commits(spark, path)[-1].version] = dict(bank)
        if n == 1:
            V.compact(spark, path)
    assert len(snapshots) == 4 and all(live(v) == s for v, s in snapshots.items())
    assert V.commits(spark, path)[-1].counts == {a: sum(x[1] == a for x in want) for a in {x[1] for x in want}}
    first = min(snapshots)
    moved = {r.question_id for r in V.changed(spark, path, first).collect()}
    assert {q for q in bank if bank[q] != snapshots[first].get(q)} <= moved


def test_repeated_and_killed_batches(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "bank")
    with pytest.raises(ValueError):
        V.create(spark.createDataFrame([], "question_id string, bucket int"), path)
    V.create(spark.createDataFrame([], ROWS), path)
    rows = batch_of(spark, [(("a", "x", None), []), (("b", "y", None), [])])

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(V, "_commit", killed)
        with pytest.raises(RuntimeError):
            V.apply(rows, path, "one")
    assert V.read(spark, path).isEmpty() and len(V.commits(spark, path)) == 1
    for _ in range(2):
        assert {r.action for r in V.apply(rows, path, "one").collect()} == {"insert"}
    assert V.read(spark, path).count() == 2 and len(V.commits(spark, path)) == 2
    V.apply(rows.limit(0), path, "empty")
    assert V.read(spark, path).count() == 2
    assert {r.action for r in V.apply(rows, path, "again", idempotent=False).collect()} == {"conflict"}
    V.compact(spark, path, keep=F.col("question_id") == "a")
    assert [r.question_id for r in V.read(spark, path).collect()] == ["a"]


def test_stream_to_bank_with_all_actions(spark, tmp_path, monkeypatch):
    inbox, bank = tmp_path / "in", str(tmp_path / "bank")
    inbox.mkdir()
    record = lambda q, body, title="T": {"question_id": q, "question_body": f"a long enough body {body}", "answer_body": "", "metadata": {"title": title, "knowledge_points": ["k"]}}
    write = lambda name, *rs: (inbox / name).write_text(json.dumps(rs))
    run = lambda c, **kw: jobs.stream_to_bank(spark, str(inbox), bank, str(tmp_path / c), **kw)
    counts = lambda: V.commits(spark, bank)[-1].counts
    write("a.json", record("q1", 1), record("q2", 2), record("q3", 3, ""))
    real = V._commit

    def killed(*args):
        if not args[5]:
            raise RuntimeError("killed")
        real(*args)

    with monkeypatch.context() as m:
        m.setattr(V, "_commit", killed)
        with pytest.raises(Exception):
            run("c")
    assert V.read(spark, bank).isEmpty()
    run("c")
    assert counts() == {"insert": 2, "reject": 1}
    write("b.json", record("q1", 1), record("q2", "two"), record("q4", 4))
    run("c")
    assert counts() == {"skip": 1, "conflict": 1, "insert": 1}
    n = len(V.commits(spark, bank))
    run("c")
    assert len(V.commits(spark, bank)) == n
    run("new checkpoint")
    assert counts() == {"skip": 4, "conflict": 1, "reject": 1}
    write("c.json", record("q2", "new"))
    run("c", overwrite=True)
    assert counts() == {"replace": 1}
    held = {r.question_id: r.question_body[-3:] for r in V.read(spark, bank).collect()}
    assert set(held) == {"q1", "q2", "q4"} and held["q2"] == "new"


def test_progress_counts_each_event_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    kind = "event_id long, job_id long, outcome string, time long"
    put = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
    run = lambda c: jobs.stream_progress(spark.readStream.schema(kind).parquet(source), out, str(tmp_path / c))
    state = lambda v=None: {r.job_id: (r.processed, r.imported, r.review, r.errors, r.status) for r in jobs.progress(spark, out, v).collect()}
    put([(1, 1, "imported", 10), (2, 1, "error", 11), (3, 2, "review", 12), (1, 1, "imported", 10)])
    run("c")
    assert state() == {1: (2, 1, 0, 1, "partial"), 2: (1, 0, 1, 0, "needs_review")}
    put([(2, 1, "error", 11), (4, 3, "imported", 1), (5, 1, "imported", 13)])
    run("c")
    want = {1: (3, 2, 0, 1, "partial"), 2: (1, 0, 1, 0, "needs_review"), 3: (1, 1, 0, 0, "succeeded")}
    assert state() == want
    last = V.commits(spark, f"{out}/jobs")[-1]
    assert last.counts == {"replace": 1, "insert": 1}, "only the jobs of the batch are written"
    run("from the beginning")
    assert state() == want
    jobs.forget(spark, out, 11)
    assert {r.event_id for r in V.read(spark, f"{out}/seen", key="event_id").collect()} == {2, 3, 5}
    assert state() == want and state(1) == {1: (2, 1, 0, 1, "partial"), 2: (1, 0, 1, 0, "needs_review")}
