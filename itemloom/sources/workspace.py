"""Folders for tables that a job writes: under spark.checkpoint.dir; a local master without it uses a folder of its own."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession

_OWN: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="itemloom-work-"))
        base = _OWN[0]
    return f"{base.rstrip('/')}/bank/{name}-{uuid.uuid4().hex}"


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet under path."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


#: What Spark escapes in the names of folders of partitions.
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{[\]^]""")


def folder_name(column: str, value: object) -> str:
    text = "" if value is None else str(value)
    return f"{column}={_ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', text) or '__HIVE_DEFAULT_PARTITION__'}"


def _store(uri: str) -> tuple:
    """pyarrow's filesystem of a qualified path, and the path in it."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, path: str) -> str:
    """path with its store's scheme."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()


def store_of(uri: str) -> tuple | None:
    """_store of a qualified path; None for a kind that pyarrow doesn't know or has no library for."""
    try:
        return _store(uri)
    except (ValueError, OSError, NotImplementedError):
        return None


def folder_names(uri: str) -> Iterator[str]:
    """Names of the folders in a qualified path; of a local one no list is made."""
    from pyarrow import fs

    store, root = _store(uri)
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(root) as found:
            yield from (x.name for x in found if x.is_dir())
    else:
        yield from (f.base_name for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory)


def write_text_files(df: DataFrame, path: str, by: list[str], name: str = "/part.txt") -> None:
    """df(value, by...) as a text file for each different `by`, in folders as partitionBy makes them; rows of a file have to stand together in one task.

    name ends the path: with ".txt" the last of `by` is the file's name, not a folder's, as folders of one file each cost more to list
    than to read. Tasks write their files themselves through pyarrow, where it knows path's kind of store (file, hdfs, s3, gs): Hadoop's local one
    starts a process for each folder, file and checksum, and the driver moves every file once more. A task that is done again
    writes the same files anew. Other stores are written by Spark.
    """
    spark = df.sparkSession
    uri = qualified(spark, path)
    try:
        store, root = _store(uri)
        store.create_dir(root)  # is there without any rows, too
    except (ValueError, OSError, NotImplementedError):  # no such kind of store, or no library for it
        df.select(*by, "value").write.partitionBy(*by).text(path)
        return

    def write(rows: Iterator[Row]) -> None:
        store, root = _store(uri)
        last, out = None, None
        for r in rows:
            at = "/".join(folder_name(c, r[c]) for c in by)
            if at != last:
                if out is not None:
                    out.close()
                file = f"{root}/{at}{name}"
                store.create_dir(file.rpartition("/")[0])
                last, out = at, store.open_output_stream(file, compression=None)
            out.write(((r["value"] or "") + "\n").encode("utf-8", "surrogatepass"))
        if out is not None:
            out.close()

    df.select(*by, "value").foreachPartition(write)


@contextlib.contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of tables written inside the block go as each has been written, not when its plan is forgotten."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written and read again, so that several consumers don't compute it anew."""
    path = new_path(df.sparkSession, name)
    with tidied(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table that its job wrote for itself and has read to the end."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
