"""A tree of digests over a table of ids and hashes: kept up to date along changed paths, and walked to tell where two tables differ.

An id's leaf is its hash modulo the number of leaves, and a node's parent is its own number modulo the next smaller width, so a tree needs no
order of ids. A node holds the number of its items and the sum of their 60-bit hashes; sums add up, so a change is a row of differences for
each level of its path, and parts of a table can be summed anywhere. Items are a versioned table whose folders the leaves share. Equal sums
mean equal items but by chance, one in about 10^18; they don't guard against items made to collide.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.operators import versions as V
from itemloom.sources.workspace import exists, kept

#: Levels under the root; the root's children are the folders of the items, and each further level has so many times as many nodes.
LEVELS, FAN = 4, 16


def width(level: int) -> int:
    """Nodes of a level; the root is level 0."""
    return 1 if level == 0 else V.BUCKETS * FAN ** (level - 1)


def node(level: int) -> Column:
    return F.pmod(F.xxhash64("question_id"), F.lit(width(level)))


def create(spark: SparkSession, path: str, kind: str = "long") -> None:
    V.create(spark.createDataFrame([], f"question_id {kind}, content_hash string"), f"{path}/items")


def update(items: DataFrame, path: str, batch: str) -> DataFrame:
    """Takes changed items(question_id, content_hash) into the tree; a null hash removes an item. What became of each, as in versions.apply.

    Items that are the same already cost no path. A batch that is repeated adds nothing.
    """
    spark = items.sparkSession
    done = V.apply(items.withColumn("seq", F.col("content_hash")), f"{path}/items", batch, overwrite=True)
    _settle(spark, path)
    return done


def _settle(spark: SparkSession, path: str) -> None:
    """Differences of every level, for commits of items that have none yet: also those of a job that was killed after its commit."""
    for c in V._all(spark, f"{path}/items").orderBy("version").collect():
        at = f"{path}/nodes/version={c.version}"
        if c.base or exists(spark, f"{at}/_SUCCESS"):
            continue
        new = V.written(spark, f"{path}/items", c.batch).select("question_id", "content_hash", "bucket")
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
        old = V.read(spark, f"{path}/items", c.version - 1).filter(F.col("bucket").isin(touched)).join(new.select("question_id"), "question_id", "left_semi")
        signed = new.withColumn("sign", F.lit(1)).unionByName(old.select("question_id", "content_hash", "bucket").withColumn("sign", F.lit(-1)))
        _sums(signed).write.mode("overwrite").parquet(at)


def _sums(items: DataFrame) -> DataFrame:
    """(level, node, n, digest) of items(question_id, content_hash, sign); removed items count nothing. Leaves first, then their sums."""
    line = F.sha2(F.concat_ws(":", F.col("question_id").cast("string"), "content_hash"), 256)
    number = F.conv(F.substring(line, 1, 15), 16, 10).cast("decimal(38,0)")
    leaves = items.filter("content_hash is not null").groupBy(node(LEVELS).alias("leaf")).agg(F.sum("sign").cast("long").alias("n"), F.sum(number * F.col("sign")).cast("decimal(38,0)").alias("digest"))
    path = F.array(*(F.struct(F.lit(k).alias("level"), F.pmod("leaf", F.lit(width(k))).alias("node")) for k in range(LEVELS + 1)))
    each = leaves.select(F.explode(path).alias("x"), "n", "digest").select("x.*", "n", "digest")
    return _added(each)


def _added(nodes: DataFrame) -> DataFrame:
    g = nodes.groupBy("level", "node").agg(F.sum("n").alias("n"), F.sum("digest").cast("decimal(38,0)").alias("digest"))
    return g.filter("n <> 0 or digest <> 0")


def nodes(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(level, node, n, digest) of the tree, now or at a version of its items: the sums of the commits' differences."""
    _settle(spark, path)
    there = [r.version for r in V._all(spark, f"{path}/items").collect() if not r.base and (version is None or r.version <= version)]
    if not there:
        return spark.createDataFrame([], "level int, node long, n long, digest decimal(38,0)")
    return _added(spark.read.parquet(*(f"{path}/nodes/version={v}" for v in there)))


def root(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One row (n_items, digest); items of equal trees have equal rows, in whatever order and batches they came."""
    top = nodes(spark, path, version).filter("level = 0")
    return top.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("digest"), F.lit(0)).cast("decimal(38,0)").alias("digest"))


def unequal(a: DataFrame, b: DataFrame) -> list[DataFrame]:
    """Of two trees' nodes, level by level, the nodes(node) that differ; below equal nodes nothing is looked at."""
    out: list[DataFrame] = []
    for level in range(LEVELS + 1):
        x, y = (t.filter(F.col("level") == level).select("node", F.col("n").alias(f"n{k}"), F.col("digest").alias(f"d{k}")) for k, t in enumerate((a, b)))
        if out:
            up = out[-1].select(F.col("node").alias("up"))
            x, y = (t.join(up, F.pmod("node", F.lit(width(level - 1))) == F.col("up"), "left_semi") for t in (x, y))
        differ = x.join(y, "node", "full").filter(~(F.col("n0").eqNullSafe(F.col("n1")) & F.col("d0").eqNullSafe(F.col("d1"))))
        out.append(kept(differ.select("node"), "unequal"))
        if out[-1].isEmpty():
            break
    return out


def diff(spark: SparkSession, a: str, b: str, versions: tuple = (None, None)) -> DataFrame:
    """(question_id, hash_a, hash_b): the items in which two trees, or two versions of one, differ; null where one has none.

    Only items of unequal leaves are compared, read from the folders that these leaves are in.
    """
    found = unequal(nodes(spark, a, versions[0]), nodes(spark, b, versions[1]))
    leaves = found[-1]
    touched = [r[0] for r in leaves.select((F.col("node") % V.BUCKETS).alias("bucket")).distinct().collect()]  # BUCKETS at most

    def items(path: str, version: int | None, name: str) -> DataFrame:
        live = V.read(spark, f"{path}/items", version).filter(F.col("bucket").isin(touched) & F.col("content_hash").isNotNull())
        return live.withColumn("node", node(LEVELS)).join(leaves, "node", "left_semi").select("question_id", F.col("content_hash").alias(name))

    both = items(a, versions[0], "hash_a").join(items(b, versions[1], "hash_b"), "question_id", "full")
    return both.filter(~F.col("hash_a").eqNullSafe(F.col("hash_b")))


def visited(levels: list[DataFrame]) -> list[int]:
    """How many nodes differ on each level that a walk has come to."""
    counts = reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).withColumn("level", F.lit(k)) for k, df in enumerate(levels)))
    return [r.n for r in counts.orderBy("level").collect()]
