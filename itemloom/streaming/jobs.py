"""Streams: an inbox of record files, records kept once, running job status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.functions import text as X
from itemloom.operators import versions
from itemloom.operators.ingest import job_rollup, record_errors, with_status
from itemloom.sources import records
from itemloom.sources.workspace import discard, exists, new_path


#: Folders of the bank, by a hash of the id: a batch is compared only with those that its ids fall in.
BUCKETS = 64


def parse_files(files: DataFrame) -> DataFrame:
    """Records of files(path, value), each a JSON array of records or one JSON record a line, with stable ids for those that bring none.

    Files of other types, hidden, empty or unreadable ones give nothing. `raw` is the record's own text.
    """
    name = X.base_name(F.col("path"))
    shown = ~name.startswith(".") & ~name.startswith("_") & (records.by_suffix(F.col("path"), records.SOURCE_TYPES) == "json") & (X.strip("value") != "")
    whole = F.from_json("value", "array<variant>")
    lines = F.transform(F.filter(F.split("value", "\n"), lambda x: X.strip(x) != ""), F.try_parse_json)
    items = F.when(X.strip("value").startswith("["), whole).otherwise(lines)
    # the file is hashed and left behind before its records are rows: beside posexplode it would be hashed and copied for each of them
    whole_files = files.filter(shown).select("path", F.sha2("value", 256).alias("source_hash"), items.alias("items"))
    each = whole_files.select("path", "source_hash", F.posexplode_outer("items").alias("at", "v")).filter("v is not null")  # outer: no filter on their number parses files beforehand
    each = each.select("path", "source_hash", "at", F.to_json("v").alias("raw"))
    parsed = each.withColumn("r", F.from_json("raw", records.RAW)).select("path", "source_hash", "at", "raw", "r.*")
    out = records.normalize(parsed)
    made = X.stable_question_id(F.col("question_id"), F.col("source_hash"), F.col("path"), F.col("original_problem_number"), F.transform("source_pages", lambda p: p.cast("string")), F.col("title"), F.col("at") + 1)
    return out.withColumn("question_id", made)


def stream_ingest(spark: SparkSession, inbox: str, bank: str, checkpoint: str, rejects: str | None = None) -> None:
    """Takes the new JSON files of the inbox into the bank (Parquet in folders by a hash of the id), then stops.

    Ids are the records' own or made from source, file and place, so files seen again, or a restart after a failed batch, add
    nothing: a batch only appends ids that the bank doesn't hold. Records that break a rule go to the folder `rejects`, if one is
    given, with their errors; without it they aren't checked.
    """

    def batch(df: DataFrame, number: int) -> None:
        staged, new = new_path(spark, "ingest-batch"), parse_files(df)
        if rejects is not None:
            new = new.withColumn("errors", record_errors(F.col("raw")))
        new.drop("raw", "source_hash", "at").write.parquet(staged)  # files are parsed once
        new = spark.read.parquet(staged)
        if rejects is not None:
            new.filter("size(errors) > 0").select("path", "question_id", "errors").write.mode("overwrite").json(f"{rejects}/batch={number}")
            new = new.filter("size(errors) = 0").drop("errors")
        new = new.drop("path").dropDuplicates(["question_id"]).withColumn("bucket", F.pmod(F.xxhash64("question_id"), F.lit(BUCKETS)).cast("int"))
        if exists(spark, bank):
            touched = [r[0] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
            held = spark.read.schema(new.schema).option("ignoreMissingFiles", True).parquet(bank).filter(F.col("bucket").isin(touched))
            new = new.join(held.select("bucket", "question_id"), ["bucket", "question_id"], "left_anti")
        new.write.mode("append").partitionBy("bucket").parquet(bank)
        discard(spark, staged)

    source = spark.readStream.format("text").option("wholetext", True).load(inbox).select(F.col("_metadata.file_path").alias("path"), "value")
    source.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()


#: What a bank of stream_to_bank holds of a record.
BANK = """question_id string, question_body string, answer_body string,
  metadata struct<title:string,topics:array<string>,tags:array<string>,source_pages:array<int>,human_review_needed:boolean,original_problem_number:string,paper_set:string,source_filename:string>"""


def _batch_name(spark: SparkSession, number: int) -> str:
    """A batch's name: that of its stream, which a new checkpoint changes, and its number, which a restart repeats."""
    return f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number}"


def stream_to_bank(spark: SparkSession, inbox: str, bank: str, checkpoint: str, overwrite: bool = False) -> None:
    """Takes the new JSON files of the inbox into a versioned bank, a commit for each batch, then stops.

    Records that break a rule are rejected with their errors; others are inserted, skipped, conflict, or with overwrite replace what is held,
    whose metadata stays where the new record gives none (`versions.apply`; rows of one id in the order of path and place). A batch that is
    repeated after a failure commits once: before its commit nothing of it counts, after it nothing is added.
    """
    if not exists(spark, f"{bank}/commits"):
        versions.create(spark.createDataFrame([], BANK), bank)

    def batch(df: DataFrame, number: int) -> None:
        new = parse_files(df).withColumns({"errors": record_errors(F.col("raw")), "source_pages": F.col("source_pages").cast("array<int>"), "tags": F.col("tags").cast("array<string>")})
        fields = ["title", "topics", "tags", "source_pages", "human_review_needed", "original_problem_number", "paper_set", "source_filename"]
        blank = [F.coalesce(F.size(c), F.lit(0)) <= 0 if c in {"topics", "tags", "source_pages"} else F.col(c).isNull() for c in fields]
        given = F.lit(False)
        for b in blank:
            given = given | ~b
        metadata = F.when(given, F.struct(*fields)).cast(spark.createDataFrame([], BANK).schema["metadata"].dataType)
        rows = new.select("question_id", "question_body", "answer_body", metadata.alias("metadata"), "errors", F.struct("path", "at").alias("seq"))
        versions.apply(rows, bank, _batch_name(spark, number), overwrite=overwrite, keep=("metadata",), errors="errors")

    source = spark.readStream.format("text").option("wholetext", True).load(inbox).select(F.col("_metadata.file_path").alias("path"), "value")
    source.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()


COUNTERS = ("processed", "imported", "review", "errors")


def stream_progress(file_events: DataFrame, path: str, checkpoint: str) -> None:
    """Takes the new events of a stream(event_id, job_id, outcome, time) into `seen` and `jobs`, versioned tables under path, then stops.

    An event counts once, however often or late it comes. A batch is joined with the buckets of its own ids, adds its counters to those of its
    jobs and writes these jobs alone; the stream itself holds no state. forget() lets old events go.
    """
    spark = file_events.sparkSession
    if not exists(spark, f"{path}/seen/commits"):
        versions.create(spark.createDataFrame([], file_events.select("event_id", "job_id", "outcome", "time").schema), f"{path}/seen")
    if not exists(spark, f"{path}/jobs/commits"):
        kind = file_events.schema["job_id"].dataType.simpleString()
        versions.create(spark.createDataFrame([], f"job_id {kind}, {', '.join(f'{c} long' for c in COUNTERS)}"), f"{path}/jobs")

    def batch(df: DataFrame, number: int) -> None:
        name = _batch_name(spark, number)
        versions.apply(df.select("event_id", "job_id", "outcome", "time", F.col("time").alias("seq")), f"{path}/seen", name, "event_id")
        more = job_rollup(versions.written(spark, f"{path}/seen", name)).select("job_id", *(F.col(c).alias(f"more_{c}") for c in COUNTERS))
        held = versions.read(spark, f"{path}/jobs", key="job_id").select("job_id", *COUNTERS)
        added = more.join(held, "job_id", "left").select("job_id", *((F.coalesce(c, F.lit(0)) + F.col(f"more_{c}")).alias(c) for c in COUNTERS), F.lit(0).alias("seq"))
        versions.apply(added, f"{path}/jobs", name, "job_id", overwrite=True)

    file_events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()


def progress(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Counters and status of each job that stream_progress has met, now or at a version."""
    return with_status(versions.read(spark, f"{path}/jobs", version, "job_id").select("job_id", *COUNTERS))


def forget(spark: SparkSession, path: str, before) -> None:
    """Events of a time before a point are remembered no longer: a copy that comes later would count again. Counters stay."""
    versions.compact(spark, f"{path}/seen", "event_id", F.col("time") >= F.lit(before))


def stream_dedup(records_stream: DataFrame, key: str = "question_id", time: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first record of each id. With a time column, ids are only remembered as long as copies may come late."""
    if time is None:
        return records_stream.dropDuplicates([key])
    return records_stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def stream_once(stream: DataFrame, path: str, checkpoint: str, key: str = "question_id", seq: str | None = None) -> DataFrame:
    """The first record of each id, in a versioned table at path: what is remembered is the table, not memory of the stream. Returns the table's rows.

    seq orders the records of one batch, the id itself if not given. `versions.compact` with a condition forgets.
    """
    spark = stream.sparkSession
    if not exists(spark, f"{path}/commits"):
        versions.create(spark.createDataFrame([], stream.schema), path)
    batch = lambda df, n: versions.apply(df.withColumn("seq", F.col(seq or key)), path, _batch_name(spark, n), key) and None
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    return versions.read(spark, path, key=key)


def stream_job_progress(file_events: DataFrame) -> DataFrame:
    """Running counters and status of each job, for output mode complete or update."""
    return job_rollup(file_events)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and returns its result; complete results replace one another."""
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer.format("parquet").option("path", path).start().awaitTermination()
    else:
        writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


