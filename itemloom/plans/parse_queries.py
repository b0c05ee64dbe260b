"""Queries of parsing, rendering and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.functions import text as X
from itemloom.operators import parse as P
from itemloom.operators import versions as V
from itemloom.plans.ingest_queries import OUTCOME
from itemloom.plans.registry import query
from itemloom.plans.text_queries import d_strip
from itemloom.sources.adapters import EVENTS, marked, table, with_sql
from itemloom.sources.workspace import new_path, write_text_files
from itemloom.streaming import jobs

NUMBERED = "numbered AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: concat(i, '. ', x)), chr(10)) AS text FROM documents)"


def numbered(spark: SparkSession, d: str, mark: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(mark), x))
    return table(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


SEGMENTS = f"""cut AS (SELECT doc_id, text, string_split(regexp_replace(text, '(?:^|\\n)\\s*(\\d+)[.、）)]\\s*', concat(chr(1), '\\1', chr(2)), 'g'), chr(1)) AS p FROM numbered),
seg AS (SELECT doc_id, text, list_filter(list_transform(p[2:], lambda x: concat(string_split(x, chr(2))[1], '. ', {d_strip("string_split(x, chr(2))[-1]")})), lambda x: length(x) > 20) AS s FROM cut),
chosen AS (SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[（(]\\d+[）)]')) >= 2 AND length({d_strip("substr(text, 1, strpos(text, regexp_extract(text, '[（(]\\d+[）)]')) - 1)")}) > 10 THEN [text] WHEN len(s) > 1 THEN s ELSE [text] END AS s FROM seg), segments AS (SELECT doc_id, CAST(unnest(range(len(s))) AS BIGINT) AS segment, unnest(s) AS body FROM chosen)"""


@query(with_sql(NUMBERED, SEGMENTS, body="SELECT doc_id, segment, md5(body) AS body_md5 FROM segments"))
def g1_segment_questions(spark: SparkSession, d: str) -> DataFrame:
    return P.segment_questions(numbered(spark, d, ". ")).select("doc_id", F.col("segment").cast("long").alias("segment"), F.md5("body").alias("body_md5"))


@query(f"""WITH t AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: concat(i, '.', {d_strip("x")})) AS l FROM documents), k AS (SELECT doc_id, list_filter(l, lambda x: length(x) >= 20) AS l FROM t)
SELECT doc_id, CAST(unnest(range(len(l))) AS BIGINT) AS item, md5(unnest(l)) AS body_md5 FROM k""")
def g2_split_scored_problems(spark: SparkSession, d: str) -> DataFrame:
    return P.split_scored_problems(numbered(spark, d, ".（10 分）")).select("doc_id", F.col("item").cast("long").alias("item"), F.md5("body").alias("body_md5"))


@query("""SELECT doc_id, md5(text) AS stem_md5, CASE WHEN lang = 'en' THEN 'composite' WHEN lang = 'fr' THEN 'essay' ELSE 'single_choice' END AS question_type, CASE WHEN lang = 'en' THEN 'text:' || source WHEN lang = 'fr' THEN 'text:AB' ELSE 'choice:B' END AS answers,
CAST(length(lang) AS BIGINT) AS difficulty, source AS grade, 'A:0:false,B:1:true' AS options, '1:$x=1$,2:-' AS steps, concat('力学/', lang, ':true,光学/', source, ':false') AS points, '易|基础' AS tags FROM (SELECT doc_id, lang, source, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents)""")
def g3_parse_content_md(spark: SparkSession, d: str) -> DataFrame:
    """Items around each text: types by name, an answer section that gives a key or text, marked options, steps, paths and tags."""
    kind = F.when(F.col("lang") == "en", "综合题").when(F.col("lang") == "fr", "简答题").otherwise("没有这种题")
    given = F.when(F.col("lang") == "en", F.col("source")).otherwise("**AB** 因为")
    text = F.concat(
        F.lit("难度："), F.expr("repeat('★', length(lang))"), F.lit("\n类型："), kind, F.lit(" 年级: "), F.col("source"), F.lit("\n## 题干\n"), F.col("text"), F.lit("\n## 选项\n- A. 一\n- ✅ **B**. 二\n## 答案\n"), given,
        F.lit("\n## 解析\n1. $x=1$ 因为\n2. 所以\n## 知识点\n力学/"), F.col("lang"), F.lit("，光学/"), F.col("source"), F.lit("\n## 标签\n易, 基础"),
    )
    c = P.parse_content_md(table(spark, d, "documents").select("doc_id", text.alias("text"))).withColumnRenamed("item", "c")
    flat = lambda a, f, sep=",": F.array_join(F.transform(a, f), sep)
    text_of = lambda x: x.cast("string")
    return c.select(
        "doc_id", F.md5("c.stem").alias("stem_md5"), "c.question_type", flat("c.answers", lambda x: F.concat_ws(":", x["answer_type"], x["content"])).alias("answers"), F.col("c.difficulty").cast("long").alias("difficulty"), "c.grade",
        flat("c.options", lambda x: F.concat_ws(":", x["option_label"], text_of(x["order_index"]), text_of(x["is_correct"]))).alias("options"), flat("c.solution_steps", lambda x: F.concat_ws(":", text_of(x["step_order"]), F.coalesce(x["formula"], F.lit("-")))).alias("steps"),
        flat("c.knowledge_points", lambda x: F.concat_ws(":", x["path"], text_of(x["is_primary"]))).alias("points"), F.array_join("c.tags", "|").alias("tags"),
    )


@query(f"""SELECT doc_id, block, block_type, md5(t) AS text_md5 FROM (SELECT doc_id, unnest([0, 1, 2]) AS block, unnest(['heading', 'paragraph', 'formula']) AS block_type, unnest([lang, {d_strip("text")}, '$$' || chr(10) || 'x' || chr(10) || '$$']) AS t FROM documents WHERE {d_strip("text")} <> '')""")
def g4_markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The formula closes with the line that ends with $$; a text without words has no paragraph and is left out."""
    t = table(spark, d, "documents").filter(F.regexp_replace("text", r"^\s+|\s+$", "") != "")
    body = F.concat(F.lit("## "), F.col("lang"), F.lit("\n"), F.col("text"), F.lit("\n$$\nx\n$$ "))
    b = t.select("doc_id", F.posexplode(P.markdown_blocks(F.regexp_replace(body, r"\$\$ $", " \\$\\$"))).alias("block", "b"))
    return b.select("doc_id", "block", "b.block_type", F.md5(F.regexp_replace("b.text", r" \$\$$", "\\$\\$")).alias("text_md5"))


@query(f"SELECT doc_id, CAST(unnest([0, 1]) AS BIGINT) AS item, md5(unnest([{d_strip('text')}, lang])) AS stem_md5 FROM documents")
def g5_tex_questions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit("\\section{A} x \\begin{problem}\n"), F.col("text"), F.lit("\\end{problem} y \\begin{problem}"), F.col("lang"), F.lit("\\end{problem}")).alias("text"))
    return P.tex_questions(t).select("doc_id", F.col("item").cast("long").alias("item"), F.md5("stem").alias("stem_md5"))


@query("SELECT doc_id, CAST(unnest([0, 0, 1]) AS BIGINT) AS section, unnest(['A', 'A', 'B']) AS title, CAST(unnest([0, 1, 0]) AS BIGINT) AS block, md5(unnest([lang, 'x=1', source])) AS body_md5 FROM documents")
def g5_tex_sections(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit("pre \\section{A} "), F.col("lang"), F.lit("$$x=1$$ \\subsection*{B}\n"), F.col("source")).alias("text"))
    return P.tex_sections(t).select("doc_id", F.col("section").cast("long").alias("section"), "title", F.col("block").cast("long").alias("block"), F.md5("body").alias("body_md5"))


@query(with_sql(NUMBERED, SEGMENTS, body=f"SELECT doc_id, segment, md5({d_strip('body')}) AS stem_md5, 'pending_classification' AS question_type, CAST(6 AS BIGINT) AS n_review FROM segments"))
def g6_raw_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = P.raw_candidates(P.segment_questions(numbered(spark, d, ". ")))
    return c.select("doc_id", F.col("segment").cast("long").alias("segment"), F.md5("stem").alias("stem_md5"), "question_type", F.size("needs_review").cast("long").alias("n_review"))


OCR = """tok AS (SELECT doc_id, 1 AS page, bn AS block_num, unnest(range(len(ws))) AS i, unnest(ws) AS text FROM (SELECT doc_id, bn, list_filter(string_split(l, ' '), lambda w: w <> '') AS ws FROM (SELECT doc_id, unnest(range(len(ls))) AS bn, unnest(ls) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))))"""


@query(with_sql(OCR, body="SELECT doc_id, CAST(block_num AS BIGINT) AS block_num, md5(string_agg(text, ' ' ORDER BY i)) AS text_md5, round(avg(0.5 + (i % 5) / 10.0), 6) AS confidence, CAST(0 AS BIGINT) AS x1, CAST(max(i * 10 + 8) AS BIGINT) AS x2 FROM tok GROUP BY doc_id, block_num"))
def a13_ocr_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_num", "l"))
    t = lines.select("doc_id", F.lit(1).alias("page"), F.col("block_num").cast("long").alias("block_num"), F.lit(1).alias("par_num"), F.posexplode(F.filter(F.split("l", " "), lambda w: w != "")).alias("i", "text"))
    i = F.col("i")
    t = t.withColumns({"conf": 0.5 + (i % 5) / 10, "left": (i * 10).cast("long"), "top": F.col("block_num") * 12, "width": F.lit(8), "height": F.lit(10)})
    return P.ocr_paragraphs(t).select("doc_id", "block_num", F.md5("text").alias("text_md5"), F.round("confidence", 6).alias("confidence"), "x1", "x2")


@query("SELECT conv_id AS doc_id, md5(string_agg(p, concat(chr(10), chr(10)) ORDER BY turn, p)) AS text_md5 FROM (SELECT conv_id, turn, concat('[Page ', turn, ']', chr(10), text) AS p FROM conversations) GROUP BY conv_id")
def a14_assemble_document(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), "text")
    return P.assemble_document(pages).select("doc_id", F.md5("text").alias("text_md5"))


@query()
def f8_clean_ocr(spark: SparkSession, d: str) -> DataFrame:
    return marked(spark, d).select("doc_id", P.clean_ocr(F.col("body")).alias("text"))


@query()
def f11_body_to_tex(spark: SparkSession, d: str) -> DataFrame:
    return marked(spark, d).select("doc_id", P.body_to_tex(F.col("body"), F.when(F.col("doc_id") % 5 == 0, "latex").otherwise("markdown"), F.col("doc_id").cast("string")).alias("tex"))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN concat('q', doc_id) END AS given, md5(body) AS body_md5, 'bank' AS side FROM (SELECT doc_id, lang, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM documents) WHERE length(body) >= 10 AND lang <> 'de' UNION ALL SELECT CASE WHEN doc_id % 2 = 0 THEN concat('q', doc_id) END, NULL, 'title must be a non-empty string' FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 10 AND lang = 'de'")
def st1_stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The inbox is read twice, and the second time adds nothing; half of the records bring no id, German ones no title, and files of other types are passed over."""
    path = new_path(spark, "stream")
    i = F.col("doc_id")
    t = table(spark, d, "documents").select(
        F.when(i % 2 == 0, F.concat(F.lit("q"), i.cast("string"))).alias("question_id"), F.col("text").alias("question_body"), F.lit("").alias("answer_body"), F.struct(F.when(F.col("lang") != "de", F.concat(F.lit("t"), i.cast("string"))).alias("title"), F.array("source").alias("knowledge_points")).alias("metadata"),
    )
    t.write.option("maxRecordsPerFile", 10_000).json(f"{path}/inbox")
    spark.range(3).select(F.lit("no record").alias("value")).write.mode("append").text(f"{path}/inbox")
    for run in ("a", "b"):
        jobs.stream_ingest(spark, f"{path}/inbox", f"{path}/bank", f"{path}/checkpoint-{run}", f"{path}/rejects-{run}")
    given = F.when(F.col("question_id").startswith("q") & ~F.col("question_id").startswith("qf_"), F.col("question_id")).alias("given")
    held = spark.read.parquet(f"{path}/bank").select(given, F.md5("question_body").alias("body_md5"), F.lit("bank").alias("side"))
    rejects = spark.read.schema("question_id string, errors array<string>").json(f"{path}/rejects-a")
    return held.unionByName(rejects.select(given, F.lit(None).cast("string").alias("body_md5"), F.array_join("errors", "; ").alias("side")))


VERSIONED = """d AS (SELECT doc_id, coalesce(lang, 'de') AS lang, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 10)"""


@query(with_sql(VERSIONED, body="""SELECT concat('q', doc_id) AS question_id, CASE lang WHEN 'de' THEN 'reject' ELSE 'insert' END AS what, NULL AS body_md5, CAST(1 AS BIGINT) AS version FROM d WHERE lang <> 'fr'
UNION ALL SELECT concat('q', doc_id), CASE lang WHEN 'de' THEN 'reject' WHEN 'fr' THEN 'insert' WHEN 'es' THEN 'conflict' ELSE 'skip' END, NULL, 2 FROM d WHERE doc_id % 3 = 0
UNION ALL SELECT concat('q', doc_id), CASE WHEN lang = 'de' THEN 'reject' WHEN lang = 'fr' AND doc_id % 3 <> 0 THEN 'insert' ELSE 'replace' END, NULL, 3 FROM d WHERE doc_id % 5 = 0
UNION ALL SELECT concat('q', doc_id), 'bank', md5(CASE WHEN doc_id % 5 = 0 THEN concat('new ', t) ELSE t END), CASE WHEN doc_id % 5 = 0 THEN 3 WHEN lang = 'fr' THEN 2 ELSE 1 END FROM d WHERE lang <> 'de' AND (lang <> 'fr' OR doc_id % 3 = 0 OR doc_id % 5 = 0)"""))
def st1_versioned_bank(spark: SparkSession, d: str) -> DataFrame:
    """Three batches into a versioned bank: all but French records, then some again with Spanish ones changed, then some that overwrite; German ones have no title. Every record's fate, and the bank afterwards."""
    path, i = new_path(spark, "versioned"), F.col("doc_id")
    t = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("de")).alias("lang"), X.strip(F.col("text")).alias("t")).filter("length(t) >= 10")
    record = lambda body: (F.concat(F.lit("q"), i.cast("string")).alias("question_id"), body.alias("question_body"), F.lit("").alias("answer_body"), F.struct(F.when(F.col("lang") != "de", "title").alias("title"), F.array("lang").alias("knowledge_points")).alias("metadata"))
    changed = F.when(F.col("lang") == "es", F.concat("t", F.lit(" changed"))).otherwise(F.col("t"))
    for body, rows, overwrite in ((F.col("t"), F.col("lang") != "fr", False), (changed, i % 3 == 0, False), (F.concat(F.lit("new "), F.col("t")), i % 5 == 0, True)):
        t.filter(rows).select(*record(body)).write.mode("append").option("maxRecordsPerFile", 10_000).json(f"{path}/inbox")
        jobs.stream_to_bank(spark, f"{path}/inbox", f"{path}/bank", f"{path}/checkpoint", overwrite)
    held = V.read(spark, f"{path}/bank").select("question_id", F.lit("bank").alias("what"), F.md5("question_body").alias("body_md5"), "version")
    return V.actions(spark, f"{path}/bank").select("question_id", F.col("action").alias("what"), F.lit(None).cast("string").alias("body_md5"), "version").unionByName(held)


@query("SELECT DISTINCT md5(text) AS question_id FROM documents WHERE text IS NOT NULL")
def st2_table_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Each different text once, in two batches of which the second repeats most of the first; what was met is a table."""
    path = new_path(spark, "once")
    t = table(spark, d, "documents").select(F.md5("text").alias("question_id"), "doc_id").filter("question_id is not null")
    for rows in ("doc_id % 3 > 0", "doc_id % 4 < 3"), ("doc_id % 3 = 0 or doc_id % 4 = 3 or doc_id % 2 = 0",):
        t.filter(" and ".join(rows)).select("question_id").write.mode("append").parquet(f"{path}/in")
        out = jobs.stream_once(spark.readStream.schema("question_id string").parquet(f"{path}/in"), f"{path}/out", f"{path}/checkpoint")
    return out.select("question_id")


@query("SELECT DISTINCT md5(text) AS question_id FROM documents")
def st2_stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "dedup")
    t = table(spark, d, "documents").select(F.md5("text").alias("question_id"))
    t.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(t.schema).parquet(f"{path}/in")
    return jobs.run_to_table(jobs.stream_dedup(stream), f"{path}/out", f"{path}/checkpoint")


@query(with_sql(EVENTS, body=f"SELECT *, CASE WHEN review > 0 THEN 'needs_review' WHEN imported > 0 AND errors > 0 THEN 'partial' WHEN imported > 0 THEN 'succeeded' ELSE 'failed' END AS status FROM (SELECT job_id, count(*) AS processed, count(*) FILTER (o = 'imported') AS imported, count(*) FILTER (o = 'review') AS review, count(*) FILTER (o = 'error') AS errors FROM (SELECT job_id, {OUTCOME} AS o FROM job_events) GROUP BY job_id)"))
def st3_stream_job_progress(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "progress")
    table(spark, d, "events").select(F.col("user_id").alias("job_id"), "event_type").write.parquet(f"{path}/in")
    stream = spark.readStream.schema("job_id long, event_type string").parquet(f"{path}/in").select("job_id", F.expr(OUTCOME).alias("outcome"))
    return jobs.run_to_table(jobs.stream_job_progress(stream), f"{path}/out", f"{path}/checkpoint", "complete")


@query(with_sql(EVENTS, body=f"SELECT *, CASE WHEN review > 0 THEN 'needs_review' WHEN imported > 0 AND errors > 0 THEN 'partial' WHEN imported > 0 THEN 'succeeded' ELSE 'failed' END AS status FROM (SELECT job_id, count(*) AS processed, count(*) FILTER (o = 'imported') AS imported, count(*) FILTER (o = 'review') AS review, count(*) FILTER (o = 'error') AS errors FROM (SELECT job_id, {OUTCOME} AS o FROM job_events WHERE event_id IS NOT NULL) GROUP BY job_id)"))
def st3_progress_table(spark: SparkSession, d: str) -> DataFrame:
    """Events in two batches out of order of time, the second with many of the first again; each counts once, and a batch writes its own jobs alone."""
    path, i = new_path(spark, "progress"), F.col("event_id")
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("job_id"), F.expr(OUTCOME).alias("outcome"), F.expr("unix_micros(cast(ts as timestamp))").alias("time"))
    for rows in (i % 3 > 0), ((i % 3 == 0) | (i % 2 == 0)):
        e.filter(rows).write.mode("append").parquet(f"{path}/in")
        jobs.stream_progress(spark.readStream.schema(e.schema).parquet(f"{path}/in"), path, f"{path}/checkpoint")
    return jobs.progress(spark, path)


@query("SELECT concat('question=q', doc_id) AS question_id, length(text) + 1 AS n, 'text' AS question_format FROM documents WHERE text IS NOT NULL")
def s3_read_bank_dir(spark: SparkSession, d: str) -> DataFrame:
    """The bank as a folder for each question, read back: written by tasks, a question's folder named as a partition."""
    from itemloom.sources import records

    path = new_path(spark, "bank_dir")
    t = table(spark, d, "documents").select(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question"), F.col("text").alias("value")).filter("value is not null")
    write_text_files(t.repartition("question").sortWithinPartitions("question"), path, ["question"])
    return records.read_bank_dir(spark, path, lambda name: F.when(name.endswith(".txt"), "question.txt").otherwise(name)).select("question_id", F.length("question_body").cast("long").alias("n"), "question_format")
