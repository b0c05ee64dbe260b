"""Reading item records: JSON batches, text files, bank folders, manifests, CSV templates and model replies."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemloom.functions import text as X
from itemloom.sources.workspace import folder_names, qualified, store_of

RAW_METADATA = "title string, knowledge_points variant, tags array<string>, source_pages array<string>, human_review_needed boolean, original_problem_number string, paper_set string, source_filename string"
RAW = f"question_id string, question_body string, question string, answer_body string, answer string, source_pages array<string>, knowledge_points variant, concepts variant, human_review_needed boolean, metadata struct<{RAW_METADATA.replace(' ', ':').replace(',:', ', ')}>"
LEAST_BODY = 10
#: Question folders whose files a task holds at a time.
FILES = 256
# fixed values: suffixes, source types and text formats
SOURCE_TYPES = {
    "md": "markdown", "markdown": "markdown", "tex": "latex", "txt": "text", "json": "json", "pdf": "pdf", "docx": "docx", "png": "image", "jpg": "image", "jpeg": "image", "webp": "image", "bmp": "image", "tif": "image", "tiff": "image", "csv": "csv", "xlsx": "xlsx",
}
TEXT_FORMATS = {"md": "markdown", "markdown": "markdown", "tex": "latex", "txt": "text"}
BODY_FILES = ("question.md", "question.tex", "question.txt", "content.md", "content.tex", "content.txt")
ANSWER_FILES = ("answer.md", "answer.tex", "answer.txt")


def by_suffix(path: Column, kinds: dict[str, str]) -> Column:
    suffix = F.lower(F.substring_index(X.base_name(path), ".", -1))
    found = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    return F.when(F.locate(".", X.base_name(path)) > 0, F.element_at(found, suffix))


def _topic_list(v: Column) -> Column:
    """A topic given as a string or as a list of strings."""
    json = F.to_json(v)
    return F.coalesce(F.from_json(json, "array<string>"), F.when(v.isNotNull(), F.array(F.try_variant_get(v, "$", "string"))))


def normalize(df: DataFrame) -> DataFrame:
    """Raw records to (question_id, question_body, answer_body, title, topics, source_pages, human_review_needed, ...).

    The body falls back to `question`, the answer to `answer`; both are stripped, and bodies under ten characters go. Pages that
    aren't whole numbers are dropped; topics and the review flag come from the record where its metadata has none.
    """
    m = F.col("metadata")
    nonempty = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    body = X.strip(F.coalesce(nonempty(F.col("question_body")), nonempty(F.col("question")), F.lit("")))
    answer = X.strip(F.coalesce(nonempty(F.col("answer_body")), nonempty(F.col("answer")), F.lit("")))
    pages = F.filter(F.transform(F.coalesce(F.col("source_pages"), m["source_pages"], F.array().cast("array<string>")), lambda p: p.try_cast("int")), lambda p: p.isNotNull())
    own_topics = F.coalesce(_topic_list(m["knowledge_points"]), _topic_list(F.col("knowledge_points")), _topic_list(F.col("concepts")), F.array().cast("array<string>"))
    out = df.select(
        *(c for c in df.columns if c not in {"question_id", "question_body", "question", "answer_body", "answer", "source_pages", "knowledge_points", "concepts", "human_review_needed", "metadata"}),
        "question_id", body.alias("question_body"), answer.alias("answer_body"), m["title"].alias("title"), own_topics.alias("topics"), m["tags"].alias("tags"), pages.alias("source_pages"),
        F.coalesce(m["human_review_needed"], F.col("human_review_needed")).alias("human_review_needed"), m["original_problem_number"].alias("original_problem_number"), m["paper_set"].alias("paper_set"), m["source_filename"].alias("source_filename"),
    )
    return out.filter(F.length("question_body") >= LEAST_BODY)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of records."""
    return normalize(spark.read.schema(RAW).option("multiLine", True).option("mode", "PERMISSIVE").json(path))


def parse_model_replies(df: DataFrame, column: str) -> DataFrame:
    """df with `items`: the records of a model's reply in `column`, by the rules of read_records; none where it holds no valid array."""
    parsed = F.from_json(X.model_json(F.col(column)), "array<struct<question_id:string,question_body:string,question:string,answer_body:string,answer:string>>")
    nonempty = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    item = lambda r: F.struct(r["question_id"].alias("question_id"), X.strip(F.coalesce(nonempty(r["question_body"]), nonempty(r["question"]), F.lit(""))).alias("question_body"), X.strip(F.coalesce(nonempty(r["answer_body"]), nonempty(r["answer"]), F.lit(""))).alias("answer_body"))
    kept = F.filter(F.transform(F.filter(parsed, lambda r: r.isNotNull()), item), lambda r: F.length(r["question_body"]) >= LEAST_BODY)
    return df.withColumn("items", F.coalesce(kept, F.array().cast("array<struct<question_id:string,question_body:string,answer_body:string>>")))


def read_text_sources(spark: SparkSession, path: str) -> DataFrame:
    """(path, body, format) of Markdown, TeX and text files under path; bytes that aren't UTF-8 are replaced."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    return files.withColumn("format", by_suffix(F.col("path"), TEXT_FORMATS)).filter("format is not null")


def source_manifest(spark: SparkSession, path: str, max_mb: int = 100) -> DataFrame:
    """(path, source_type, size, sha256, error) of every file under path; unknown types and large files are rows with an error.

    Contents of files over the limit aren't read: the filter on length goes to the scan, and the one on the size that was listed
    leaves each file to one of both scans.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind, most, listed = by_suffix(F.col("path"), SOURCE_TYPES), max_mb << 20, F.col("_metadata.file_size")
    small = files.filter((listed <= most) & (F.col("length") <= most)).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.filter((listed > most) & (F.col("length") > most)).select("path", "length", F.lit(None).cast("string").alias("sha256"))
    error = F.when(kind.isNull(), F.lit("unsupported type")).when(F.col("length") > most, F.lit("too large"))
    return small.unionByName(large).select("path", kind.alias("source_type"), F.col("length").alias("size"), "sha256", error.alias("error"))


def _yaml_columns(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import json

    import yaml

    for f in frames:
        out = []
        for raw in f["metadata_raw"]:
            try:
                value = yaml.safe_load(raw) if raw else {}
            except yaml.YAMLError:
                value = {}
            out.append(json.dumps(value if isinstance(value, dict) else {}, sort_keys=True, ensure_ascii=False, default=str))
        f = f.drop(columns="metadata_raw")
        f["metadata"] = out
        yield f


def _visible(name: str) -> bool:
    """What Spark's own listing of folders shows."""
    hidden = (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")
    return not hidden or name.startswith(("_metadata", "_common_metadata"))


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, path, name, folder) of the files in path's folders: one task names the folders, all tasks list what they hold, so the driver holds no list."""
    uri = qualified(spark, path)

    def folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            names = (n for n in folder_names(uri) if _visible(n))
            while some := list(islice(names, 4096)):
                yield pa.RecordBatch.from_arrays([pa.array(some)], names=["question_id"])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(uri)
        for name in (n for batch in batches for n in batch.column(0).to_pylist()):
            inside = [f.path for f in store.get_file_info(fs.FileSelector(f"{root.rstrip('/')}/{name}", recursive=True)) if f.type == fs.FileType.File]
            parts = [(p, p[len(root.rstrip("/")) + 1 :].split("/")) for p in inside]
            shown = [(p, x) for p, x in parts if all(map(_visible, x))]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(shown), pa.string()), pa.array([p for p, _ in shown], pa.string()), pa.array([x[-1] for _, x in shown], pa.string()), pa.array([x[-2] for _, x in shown], pa.string())], names=["question_id", "path", "name", "folder"])

    tasks = 4 * spark.sparkContext.defaultParallelism
    return spark.range(1, numPartitions=1).mapInArrow(folders, "question_id string").repartition(tasks).mapInArrow(files, "question_id string, path string, name string, folder string")


def _with_contents(df: DataFrame, uri: str, columns: list[str]) -> DataFrame:
    """df with the bytes of the files that its columns name, few files at a time; null where there is none."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(uri)
        for batch in batches:
            for at in range(0, batch.num_rows, FILES):
                some = batch.slice(at, FILES)
                for c in columns:
                    data = [None if p is None else store.open_input_file(p).read() for p in some.column(c).to_pylist()]
                    some = some.set_column(some.schema.get_field_index(c), c, pa.array(data, pa.binary()))
                yield some

    return df.mapInArrow(read, T.StructType([T.StructField(f.name, T.BinaryType()) if f.name in columns else f for f in df.schema.fields]))


def read_bank_dir(spark: SparkSession, path: str, role=None) -> DataFrame:
    """(question_id, question_body, question_format, answer_body, metadata, assets) of a folder with one folder for each question.

    The first body and answer file by precedence counts; hidden folders and those without a body are left out; metadata that
    can't be read is {}; assets are sorted by name. role: a function of the file name's column, where files have other names.
    Where pyarrow knows the kind of store, tasks list the folders and read the files that count; others are listed and read by Spark.
    """
    own = store_of(qualified(spark, path)) is not None
    if own:
        named, content = _listed(spark, path), F.col("path")
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        parts = F.split("path", "/")
        inside = F.substring("path", F.locate("/", F.col("path"), 1), F.length("path"))
        depth = len([p for p in path.replace("file://", "").split("/") if p])
        named, content = files.select(F.get(F.filter(F.split(F.regexp_replace(inside, "^file:/*", "/"), "/"), lambda x: x != ""), F.lit(depth)).alias("question_id"), F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("folder"), "path", "content"), F.col("content")
    if role is not None:
        named = named.withColumn("name", role(F.col("name")))
    named = named.filter("question_id is not null and not startswith(question_id, '.') and question_id <> name")
    rank = lambda names: F.array_position(F.array(*map(F.lit, names)), F.col("name"))
    suffixed = by_suffix(F.col("name"), TEXT_FORMATS)
    pick = lambda names, what: F.min_by(what, F.when(rank(names) > 0, F.struct(rank(names), "path")))
    grouped = named.groupBy("question_id").agg(
        pick(BODY_FILES, content).alias("question_body"), pick(BODY_FILES, suffixed).alias("question_format"), pick(ANSWER_FILES, content).alias("answer_body"), pick(("metadata.yaml",), content).alias("metadata_raw"),
        F.array_sort(F.collect_list(F.when((F.col("folder") == "assets") & F.lower("name").rlike(r"\.(svg|pdf|jpg|jpeg|png|gif|webp)$"), F.col("name")))).alias("assets"),
    )
    texts = ["question_body", "answer_body", "metadata_raw"]
    kept = grouped.filter("question_body is not null")
    kept = _with_contents(kept.repartition(4 * spark.sparkContext.defaultParallelism), qualified(spark, path), texts) if own else kept
    kept = kept.withColumns({c: F.col(c).cast("string") for c in texts}).withColumn("answer_body", F.coalesce("answer_body", F.lit("")))
    schema = T.StructType([*(x for x in kept.schema.fields if x.name != "metadata_raw"), T.StructField("metadata", T.StringType())])
    return kept.mapInPandas(_yaml_columns, schema)


# fixed values: the template's columns
CSV_COLUMNS = "question_id string, question_type string, stem string, option_a string, option_b string, option_c string, option_d string, answer string, answer_type string, unit string, difficulty int, grade string, chapter string, score double, knowledge_points string, tags string, solution string, source string"
CSV_REQUIRED = ("question_type", "stem", "answer", "answer_type", "difficulty")


def read_csv_template(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the tabular template with lists for topics (between ;), tags (between ,) and options, and the missing required columns in `error`."""
    raw = spark.read.schema(CSV_COLUMNS).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    split = lambda c, by: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), by), X.strip), lambda x: x != "")
    options = F.filter(F.array(*(F.struct(F.lit(x.upper()).alias("label"), F.col(f"option_{x}").alias("content")) for x in "abcd")), lambda o: F.coalesce(o["content"], F.lit("")) != "")
    missing = F.array_compact(F.array(*(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in CSV_REQUIRED)))
    return raw.withColumns({"topics": split(F.col("knowledge_points"), ";"), "tag_list": split(F.col("tags"), ","), "options": options, "error": F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))}).drop("knowledge_points", "tags", "option_a", "option_b", "option_c", "option_d")
