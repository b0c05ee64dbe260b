"""An index that grows by segments: a change writes a delta for its items alone, searches read base and deltas as one index.

A path holds `segment=<n>/` folders, each with the tables of search.Index for its own items, and `removed` (ids of which older segments no longer
count); and `commits/`, one row for each segment, written last. A segment without its commit, left by a killed job, isn't read. Statistics are
sums of the segments' own, which count a replaced or deleted item as minus one. compact() writes one new base.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.operators import search as S
from itemloom.sources.workspace import kept, tidied

TABLES = ("postings", "items", "vectors")
#: Removed ids that are sent to every task, so that no row of an older segment is dealt to meet them; beyond that rows are, until compact() makes one base.
MOST_SENT = 1 << 22
COMMIT = "version long, segment string, base boolean, n_items long, sum_len long, checksum decimal(38,0)"


def checksum(items: DataFrame) -> DataFrame:
    """One row (n_items, sum_len, checksum) of items(question_id, content_hash, len); checksum is a sum of 60-bit hashes, so parts add up."""
    line = F.sha2(F.concat_ws(":", F.col("question_id").cast("string"), "content_hash"), 256)
    number = F.conv(F.substring(line, 1, 15), 16, 10).cast("decimal(20,0)")
    zero = F.lit(0)
    return items.agg(F.count("*").alias("n_items"), F.coalesce(F.sum("len"), zero).alias("sum_len"), F.coalesce(F.sum(number), zero).cast("decimal(38,0)").alias("checksum"))


def commits(spark: SparkSession, path: str) -> list:
    """The commits from the last base on, in order: one for each change since it was written."""
    rows = spark.read.schema(COMMIT).parquet(f"{path}/commits").orderBy("version").collect()
    last = max(k for k, r in enumerate(rows) if r.base)
    return rows[last:]


def _table(spark: SparkSession, at: str, name: str) -> DataFrame:
    """A table of the segment at a path; one without items has no files of postings, so these need a schema."""
    if name != "postings":
        return spark.read.parquet(f"{at}/{name}")
    kind = dict(spark.read.parquet(f"{at}/items").dtypes)["question_id"]
    return S.with_bucket(spark.read.schema(f"token string, question_id {kind}, len long, title_pos array<int>, text_pos array<int>").parquet(f"{at}/postings"))


def _union(spark: SparkSession, path: str, segments: list, name: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (_table(spark, f"{path}/segment={r.segment}", name).withColumn("version", F.lit(r.version)) for r in segments))


def _live(rows: DataFrame, removed: DataFrame, few: bool) -> DataFrame:
    """rows(question_id, version) that no later segment has removed; removed is as large as the changes since the last base. few: it may go to every task."""
    until = removed.groupBy("question_id").agg(F.max("version").alias("until"))
    until = F.broadcast(until) if few else until
    return rows.join(until, "question_id", "left").filter(F.col("until").isNull() | (F.col("version") >= F.col("until"))).drop("until", "version")


def read(spark: SparkSession, path: str) -> S.Index:
    """All live rows as one index: searches don't tell it from one that was written at once."""
    segments = commits(spark, path)
    removed = _union(spark, path, segments, "removed")
    few = removed.count() <= MOST_SENT
    postings, items, vectors = (_live(_union(spark, path, segments, name), removed, few) for name in TABLES)
    terms = _union(spark, path, segments, "terms").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
    return S.Index(postings, terms, items, vectors, statistics(spark, path).withColumn("dimension", F.lit(S.DIM).cast("long")))


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """One row (n_items, sum_len, checksum): sums over the commits, no item is read."""
    segments = [r.segment for r in commits(spark, path)]
    rows = spark.read.schema(COMMIT).parquet(f"{path}/commits").filter(F.col("segment").isin(segments))
    return rows.agg(F.sum("n_items").alias("n_items"), F.sum("sum_len").alias("sum_len"), F.sum("checksum").cast("decimal(38,0)").alias("checksum"))


def _write(spark: SparkSession, path: str, version: int, base: bool, docs: DataFrame, hashes: DataFrame | None, removed: DataFrame, old: DataFrame | None) -> str:
    """A segment of docs(question_id, title, search_text), and its commit. old: items that it takes the place of."""
    segment = f"{version}-{uuid.uuid4().hex[:8]}"
    at = f"{path}/segment={segment}"
    S.write_index(docs, at, hashes, ("items", "postings", "vectors"))
    with tidied(spark):
        removed.select("question_id").write.parquet(f"{at}/removed")
    items = spark.read.parquet(f"{at}/items")
    terms = _table(spark, at, "postings").groupBy(F.col("token").alias("term")).agg(F.count("*").alias("df"))
    sums = checksum(items)
    if old is not None:
        gone = S.term_stats(S.doc_tokens(old)).select("term", (-F.col("df")).alias("df"))
        terms = terms.unionByName(gone).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
        less = checksum(old).toDF("n", "l", "c")
        sums = sums.crossJoin(F.broadcast(less)).select((F.col("n_items") - F.col("n")).alias("n_items"), (F.col("sum_len") - F.col("l")).alias("sum_len"), (F.col("checksum") - F.col("c")).cast("decimal(38,0)").alias("checksum"))
    with tidied(spark):
        terms.write.parquet(f"{at}/terms")
    commit = sums.select(F.lit(version).cast("long").alias("version"), F.lit(segment).alias("segment"), F.lit(base).alias("base"), "n_items", "sum_len", "checksum")
    commit.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return segment


def create(docs: DataFrame, hashes: DataFrame | None, path: str) -> None:
    """The first base of docs(question_id, title, search_text) with hashes(question_id, content_hash), or with docs' own content_hash, which shuffles no text."""
    _write(docs.sparkSession, path, 0, True, docs, hashes, docs.select("question_id").limit(0), None)


def stale(spark: SparkSession, path: str, hashes: DataFrame) -> DataFrame:
    """(question_id, there): ids of hashes(question_id, content_hash) that the index lacks or holds with another hash, and ids that are no longer there."""
    held = read(spark, path).items.select("question_id", F.col("content_hash").alias("held"))
    both = hashes.select("question_id", "content_hash").join(held, "question_id", "full")
    return both.filter(~F.col("content_hash").eqNullSafe(F.col("held"))).select("question_id", F.col("content_hash").isNotNull().alias("there"))


def refresh(docs: DataFrame, hashes: DataFrame | None, path: str) -> int:
    """Brings the index to docs(question_id, title, search_text) with hashes(question_id, content_hash), or docs' own content_hash, by one delta; how many ids changed.

    Ids and hashes of all items are compared; only changed texts are looked at, and only their rows are written. Nothing is written where nothing changed.
    """
    spark = docs.sparkSession
    changed = kept(stale(spark, path, docs if hashes is None else hashes), "segment-changed")
    n = changed.count()
    if n:
        new = docs.join(changed.filter("there").select("question_id"), "question_id", "left_semi")
        old = kept(read(spark, path).items.join(changed.select("question_id"), "question_id", "left_semi"), "segment-old")
        version = commits(spark, path)[-1].version + 1
        _write(spark, path, version, False, new, None if hashes is None else hashes.join(changed.select("question_id"), "question_id", "left_semi"), changed, old)
    return n


def compact(spark: SparkSession, path: str) -> None:
    """A new base of all live items; what came before it stays for readers that have begun, but isn't read any more."""
    items = read(spark, path).items
    _write(spark, path, commits(spark, path)[-1].version + 1, True, items.select("question_id", "title", "search_text", "content_hash"), None, items.select("question_id").limit(0), None)
