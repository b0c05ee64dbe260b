"""What several corpus operators share: scratch tables, confs, word hashing, components."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, a folder of this process, which only a local master can share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        if not _OWN_DIRS:
            _OWN_DIRS.append(tempfile.mkdtemp(prefix="itemloom-"))
            spark.sparkContext.setCheckpointDir(_OWN_DIRS[0])
        base = _OWN_DIRS[0]
    return f"{base.rstrip('/')}/itemloom/{re.sub(r'\W', '_', name)}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def session_conf(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs inside the block, set back afterwards."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


#: Few records in an Arrow batch, as texts can be long; shuffle files go when their job has been written.
JOB_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def stored(df: DataFrame, name: str, batch: int = 256, by: str | None = None, path: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: what follows doesn't depend on df's lineage.

    batch: rows in an Arrow batch; more than the default is for narrow rows. by: a column to partition the table by.
    """
    spark, path = df.sparkSession, path or scratch(df.sparkSession, name)
    with session_conf(spark, JOB_CONF | {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)}):
        (df.write.partitionBy(by) if by else df.write).option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes what stored() wrote; nothing that still has to run may read it."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(column) -> list[str | None]:
    """The texts of an Arrow column of strings or bytes; bytes that aren't UTF-8 become U+FFFD, as Java reads them."""
    import pyarrow as pa

    return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def cut_long(text: bytes, size: int) -> Iterator[bytes]:
    """text in pieces of about `size` bytes that end at white space; a longer word stays whole."""
    at = 0
    while len(text) - at > size:
        space = re.compile(rb"[\t-\r ]").search(text, at + size)
        if not space:
            break
        yield text[at : space.start()]
        at = space.start()
    yield text[at:]


def id_remainder(column: str, divisor: int) -> F.Column:
    """crc32 of an id as text, modulo divisor; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


class BoundedCache(dict):
    """A dict that makes missing values and starts anew beyond `most` entries, so a worker's memory stays bounded."""

    def __init__(self, make, most: int = 200_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b): every node with the smallest node that it reaches, as (node, component).

    Alternating large-star and small-star passes; each pass is written to the shared folder, so lineage stays short.
    Both passes only group by node and keep as many edges as there are. Self-loops are kept as single nodes.
    A hub with many neighbours is met with a minimum per node and a join on it, both of which Spark can split.
    """
    edges = stored(edges.select("a", "b"), f"{name}-links")
    loops = edges.filter("a = b").select("a").distinct()
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    last = None
    for i in range(rounds):
        # large star: every larger neighbour of a node links to the smallest of the node and its neighbours
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: every smaller neighbour and the node itself link to the smallest
        large = stored(large, f"{name}-large{i}")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        e = stored(small, f"{name}-small{i}")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components of {name} did not settle in {rounds} rounds")
    found = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    known = found.unionByName(roots)
    alone = loops.select(F.col("a").alias("node")).join(known.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    return known.unionByName(alone)
