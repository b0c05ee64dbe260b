"""A versioned table of keyed rows: each batch is one commit, readers see whole commits only and merge them as they read.

A path holds `rows/commit=<version>-<random>/bucket=<hash of the key>/` (what a batch inserted or replaced), `actions/commit=.../` (what became of
each row that it was given), `schema/`, and `commits/`, one row a commit, written last. Rows of a batch that was killed have no commit and aren't
read. A batch has a name; given again after its commit it changes nothing and tells the actions recorded then. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.sources.workspace import discard, exists, new_path

COMMIT = "version long, name string, batch string, base boolean, counts map<string,long>"

#: Folders of a commit, by a hash of the key: a batch is compared only with those that its keys fall in.
BUCKETS = 64


def fingerprint(columns: list[str]) -> Column:
    """A hash over the values of columns, with the keys of objects and maps in order."""
    return F.sha2(F.to_json(F.parse_json(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))), 256)


def create(empty: DataFrame, path: str) -> None:
    """An empty table with the columns of a DataFrame, whose rows aren't looked at. The names fingerprint, bucket, version, commit and seq are the table's own."""
    taken = {"fingerprint", "bucket", "version", "commit", "seq"} & set(empty.columns)
    if taken:
        raise ValueError(f"columns of the table's own names: {sorted(taken)}")
    spark = empty.sparkSession
    empty.limit(0).withColumn("fingerprint", F.lit("")).write.parquet(f"{path}/schema")
    _commit(spark, path, 0, f"{0:012d}-{uuid.uuid4().hex[:8]}", "", True, {})


def commits(spark: SparkSession, path: str, version: int | None = None) -> list:
    """The commits that a reader at a version, or the latest one, has to look at: the last base, and those after it, in order."""
    rows = [r for r in _all(spark, path).orderBy("version").collect() if version is None or r.version <= version]  # one small row a batch
    last = max(k for k, r in enumerate(rows) if r.base)
    return rows[last:]


def _all(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMIT).parquet(f"{path}/commits")


def _commit(spark: SparkSession, path: str, version: int, name: str, batch: str, base: bool, counts: dict) -> None:
    spark.createDataFrame([(version, name, batch, base, counts)], COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def _rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """One scan over the commits' folders."""
    schema = spark.read.parquet(f"{path}/schema").schema
    folders = [f"{path}/rows/commit={n}" for n in names if exists(spark, f"{path}/rows/commit={n}")]
    if not folders:
        return spark.createDataFrame([], schema).withColumns({"bucket": F.lit(0), "version": F.lit(0).cast("long")})
    rows = spark.read.schema(schema.add("commit", "string").add("bucket", "integer")).option("basePath", f"{path}/rows").parquet(*folders)
    return rows.withColumn("version", F.substring("commit", 1, 12).cast("long")).drop("commit")


def read(spark: SparkSession, path: str, version: int | None = None, key: str = "question_id") -> DataFrame:
    """The live rows at a version, or the latest one: of each key the row of the latest commit. Carries fingerprint, bucket and version.

    Only keys of commits after the base are gathered, as many as have changed since; the base is read as it lies.
    """
    found = commits(spark, path, version)
    base, names = found[0].version, [r.name for r in found]
    rows = _rows(spark, path, names)
    if len(found) == 1:
        return rows
    until = rows.filter(F.col("version") > base).groupBy(key).agg(F.max("version").alias("until"))
    return rows.join(until, key, "left").filter(F.col("until").isNull() | (F.col("version") == F.col("until"))).drop("until")


def actions(spark: SparkSession, path: str, since: int = 0, batch: str | None = None) -> DataFrame:
    """What became of the rows that commits after a version were given, or a batch: the key, seq, action, errors and version."""
    found = [r for r in _all(spark, path).filter(F.col("version") > since).collect() if not r.base and (batch is None or r.batch == batch)]
    if not found:
        raise ValueError("no such commits")
    df = spark.read.option("basePath", f"{path}/actions").parquet(*(f"{path}/actions/commit={r.name}" for r in found))
    return df.withColumn("version", F.substring("commit", 1, 12).cast("long")).drop("commit")


def changed(spark: SparkSession, path: str, since: int, key: str = "question_id") -> DataFrame:
    """(key, version): the keys that were inserted or replaced after a version, with the last of their versions."""
    return actions(spark, path, since).filter("action in ('insert', 'replace')").groupBy(key).agg(F.max("version").alias("version"))


def written(spark: SparkSession, path: str, batch: str) -> DataFrame:
    """The rows that a batch inserted or replaced."""
    return _rows(spark, path, [r.name for r in _all(spark, path).filter(F.col("batch") == batch).collect()])


def apply(incoming: DataFrame, path: str, batch: str, key: str = "question_id", overwrite: bool = False, idempotent: bool = True, keep: tuple = (), errors: str | None = None) -> DataFrame:
    """Takes a batch into the table as one commit; what became of each of its rows: (key, seq, action, errors, version).

    incoming: the table's columns and `seq`, which orders rows of one key (ties: as they are stored). errors names a column of its own, an array
    of texts: rows that have some are `reject`, those with a null key `no key`. Without overwrite the first row of a new key is `insert`; any
    other is `skip` where it equals the row held or just inserted (and idempotent), else `conflict`. With overwrite the last row of a key counts:
    `insert`, `skip` where nothing would change, else `replace`; earlier ones are `superseded`. A replaced row keeps the columns of `keep` that
    no new row gives. Rows of one key, however many, meet in partial aggregates alone.
    """
    spark = incoming.sparkSession
    if _all(spark, path).filter(F.col("batch") == batch).isEmpty():
        _take(incoming, path, batch, key, overwrite, idempotent, keep, errors)
    return actions(spark, path, batch=batch)


def _take(incoming: DataFrame, path: str, batch: str, key: str, overwrite: bool, idempotent: bool, keep: tuple, errors: str | None) -> None:
    spark = incoming.sparkSession
    columns = [c for c in spark.read.parquet(f"{path}/schema").columns if c != "fingerprint"]
    values = [c for c in columns if c != key]
    staged = new_path(spark, "versions-batch")
    none = F.array().cast("array<string>")
    given = incoming.select(*columns, "seq", (F.coalesce(errors, none) if errors else none).alias("_errors"), F.monotonically_increasing_id().alias("_row"))
    given.withColumns({"fingerprint": fingerprint(values), "bucket": F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"), "_at": F.struct("seq", "_row")}).select(*columns, "fingerprint", "bucket", "_at", "_errors").write.parquet(staged)
    given = spark.read.parquet(staged)
    good = given.filter((F.size("_errors") == 0) & F.col(key).isNotNull())
    touched = [r[0] for r in good.select("bucket").distinct().collect()]  # BUCKETS at most
    held = read(spark, path, key=key).filter(F.col("bucket").isin(touched)).select(key, F.col("fingerprint").alias("_old"), *(F.col(c).alias(f"_old_{c}") for c in keep))

    # the row of each key that counts, by keys and places alone
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(f"_last_{c}") for c in keep] if overwrite else []
    chosen = good.groupBy(key).agg((F.max if overwrite else F.min)("_at").alias("_win"), *last).join(held, key, "left")
    # places differ from row to row, so this keeps one row of each key, and a key of many rows is dealt by them
    winners = good.withColumnRenamed("_at", "_win").join(chosen, [key, "_win"])
    if overwrite:
        winners = winners.withColumns({c: F.coalesce(f"_last_{c}", f"_old_{c}") for c in keep}).withColumn("fingerprint", fingerprint(values))
    same = (F.col("_old") == F.col("fingerprint")) & F.lit(idempotent)
    decided = winners.withColumn("_action", F.when(F.col("_old").isNull(), "insert").when(same, "skip").when(F.lit(overwrite), "replace").otherwise("conflict"))

    version = commits(spark, path)[-1].version + 1
    name = f"{version:012d}-{uuid.uuid4().hex[:8]}"
    decided.filter("_action in ('insert', 'replace')").select(*columns, "fingerprint", "bucket").write.partitionBy("bucket").parquet(f"{path}/rows/commit={name}")
    now = decided.select(key, "_win", "_action", F.coalesce("_old", "fingerprint").alias("_now"))
    other = F.lit("superseded") if overwrite else F.when((F.col("fingerprint") == F.col("_now")) & F.lit(idempotent), "skip").otherwise("conflict")
    each = good.select(key, "_at", "_errors", "fingerprint").join(now, key).select(key, "_at", "_errors", F.when(F.col("_at") == F.col("_win"), F.col("_action")).otherwise(other).alias("action"))
    bad = given.filter((F.size("_errors") > 0) | F.col(key).isNull()).select(key, "_at", "_errors", F.when(F.size("_errors") > 0, "reject").otherwise("no key").alias("action"))
    each.unionByName(bad).select(key, F.col("_at.seq").alias("seq"), "action", F.col("_errors").alias("errors")).write.parquet(f"{path}/actions/commit={name}")
    counts = spark.read.parquet(f"{path}/actions/commit={name}").groupBy("action").count().collect()  # a row for each kind of action
    _commit(spark, path, version, name, batch, False, {r["action"]: r["count"] for r in counts})
    discard(spark, staged)


def compact(spark: SparkSession, path: str, key: str = "question_id", keep: Column | None = None) -> None:
    """A new base of all live rows, or of those that a condition keeps (rows past their time go). Readers of older versions find theirs as before."""
    live = read(spark, path, key=key)
    version = commits(spark, path)[-1].version + 1
    name = f"{version:012d}-{uuid.uuid4().hex[:8]}"
    (live if keep is None else live.filter(keep)).drop("version").hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/rows/commit={name}")
    _commit(spark, path, version, name, "", True, {})
