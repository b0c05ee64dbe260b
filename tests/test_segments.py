"""An index of a base and deltas against one that is written at once."""

import uuid

import pytest
from pyspark.sql import functions as F

from itemloom.operators import search as S
from itemloom.operators import segments as G

KIND = "question_id string, title string, search_text string"


def table(spark, texts):
    docs = spark.createDataFrame([(i, t.split()[0] if t else "", t) for i, t in texts.items()], KIND)
    return docs, docs.select("question_id", F.sha2("search_text", 256).alias("content_hash"))


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def same(spark, path, texts, tmp):
    """Postings, words, items, vectors, statistics and hits are those of a fresh index."""
    docs, hashes = table(spark, texts)
    fresh, now = S.index_tables(docs, hashes), G.read(spark, path)
    for name, columns in (("postings", ("bucket", "token", "question_id", "len", "title_pos", "text_pos")), ("terms", ("term", "df")), ("items", ("question_id", "title", "search_text", "content_hash", "len"))):
        assert rows(getattr(now, name), *columns) == rows(getattr(fresh, name), *columns), name
    assert rows(now.vectors, "question_id", "vector") == rows(fresh.vectors, "question_id", "vector")
    assert rows(now.manifest, "n_items", "sum_len", "checksum") == rows(G.checksum(fresh.items), "n_items", "sum_len", "checksum")
    asked = spark.createDataFrame([(0, "mass light"), (1, "mirror"), (2, "old words"), (3, "nothing")], "query_id long, q string")
    assert rows(S.lexical_topk(asked, now), "query_id", "question_id", "score", "rank") == rows(S.lexical_topk(asked, S.write_index(docs, f"file://{tmp}/fresh-{uuid.uuid4().hex}", hashes)), "query_id", "question_id", "score", "rank")


@pytest.fixture(scope="module")
def texts():
    words = "mass light mirror force old words energy wave".split()
    return {f"q{i}": " ".join(words[(i * k + k) % 8] for k in range(1, 3 + i % 9)) for i in range(60)}


def test_changes_write_deltas_alone(spark, tmp_path, texts):
    path, now = f"file://{tmp_path}/index", dict(texts)
    G.create(*table(spark, now), path)
    assert G.refresh(*table(spark, now), path) == 0 and len(G.commits(spark, path)) == 1
    now |= {"q3": "mirror mass light", "q5": "new words of mass", "x1": "a new item of light"}
    del now["q7"]
    assert G.refresh(*table(spark, now), path) == 4
    base, delta = G.commits(spark, path)
    assert sorted(r[0] for r in spark.read.parquet(f"{path}/segment={delta.segment}/items").select("question_id").collect()) == ["q3", "q5", "x1"]
    same(spark, path, now, tmp_path)
    now |= {"q7": "back again", "q3": "changed once more mirror"}  # a deleted id returns, a replaced one is replaced again
    del now["x1"]
    assert G.refresh(*table(spark, now), path) == 3 and len(G.commits(spark, path)) == 3
    same(spark, path, now, tmp_path)
    G.compact(spark, path)
    assert len(G.commits(spark, path)) == 1
    same(spark, path, now, tmp_path)
    assert G.refresh(*table(spark, {}), path) == len(now) and G.read(spark, path).items.count() == 0


def test_a_segment_without_its_commit_is_not_read(spark, tmp_path, texts, monkeypatch):
    path, now = f"file://{tmp_path}/index", dict(texts)
    G.create(*table(spark, now), path)
    now["q1"] = "changed mirror"

    def killed(items):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(G, "checksum", killed)
        with pytest.raises(RuntimeError):
            G.refresh(*table(spark, now), path)
    same(spark, path, texts, tmp_path)
    assert G.refresh(*table(spark, now), path) == 1
    same(spark, path, now, tmp_path)


def test_own_hashes(spark, texts, tmp_path):
    """Documents that carry their hash need no table of hashes: the same index, and no text is shuffled for it."""
    path = f"file://{tmp_path}/index"
    own = lambda t: table(spark, t)[0].withColumn("content_hash", F.sha2("search_text", 256))
    before = dict(texts) | {"q1": "mass", "gone": "old words"}
    G.create(own(before), None, path)
    assert G.refresh(own(texts), None, path) == 2 and G.refresh(own(texts), None, path) == 0
    same(spark, path, texts, tmp_path)
    assert "Exchange" not in S.items_of(own(texts))._jdf.queryExecution().executedPlan().toString()


def test_plain_body_once(spark):
    """A body's plain text is made once for the title and the text, which stay as they were."""
    from itemloom.functions import text as X

    bank = spark.createDataFrame([(1, "# A\n`b`  c", ""), (2, "  **d**\n\n> e [f](g)", None), (3, " \n ", "x"), (4, None, "y")], "question_id long, question_body string, answer_body string")
    docs, none = S.searchable(bank, F.lit("m")), F.lit(None).cast("string")
    title = X.title(F.col("question_body"), none, F.col("question_id").cast("string"))
    assert rows(docs, *docs.columns) == rows(bank.select("question_id", title.alias("title"), X.search_text(title, F.col("question_body"), F.col("answer_body"), F.lit("m")).alias("search_text")), *docs.columns)
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("{1,6}") == 2  # the marks of headings: once in the body, once in the answer


def test_removed_ids_go_to_the_rows(spark, tmp_path, monkeypatch):
    """A refresh shuffles no posting, text or vector of older segments as they are read, however small Spark's own broadcasts are; beyond the bound the rows are the same."""
    docs = spark.createDataFrame([(i, f"title {i}", f"light and mass {i % 5}") for i in range(40)], "question_id long, title string, search_text string")
    hashed = lambda df, h: df.withColumn("content_hash", h)
    path = f"file://{tmp_path}/grown"
    G.create(hashed(docs.filter("question_id < 30"), F.lit("old")), None, path)
    G.refresh(hashed(docs.filter("question_id > 9"), F.when(F.col("question_id") % 2 == 0, "new").otherwise("old")), None, path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        x = G.read(spark, path)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (x.postings, x.items, x.vectors)]
        found = [sorted(map(str, df.collect())) for df in (x.postings, x.items, x.vectors)]
        assert all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)
        monkeypatch.setattr(G, "MOST_SENT", 3)
        y = G.read(spark, path)
        assert "SortMergeJoin" in y.postings._jdf.queryExecution().executedPlan().toString()
        assert [sorted(map(str, df.collect())) for df in (y.postings, y.items, y.vectors)] == found and len(found[1]) == 30
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
