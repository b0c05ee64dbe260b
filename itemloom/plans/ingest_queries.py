"""Queries of ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.functions import text as X
from itemloom.operators import ingest as I
from itemloom.plans.registry import query
from itemloom.sources import records
from itemloom.sources.adapters import BANK, EVENTS, FLAGS, bank, events, review_flags, table, with_sql
from itemloom.sources.workspace import new_path, write_text_files


@query(with_sql(FLAGS, body="SELECT CASE WHEN human_review_needed OR question_id % 5 = 0 OR question_id % 7 = 0 THEN 'queued' ELSE 'accepted' END AS gate, question_id FROM flags"))
def p7_review_gate(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("question_id")
    r = review_flags(spark, d).withColumns({"warnings": F.when(i % 5 == 0, F.array(F.lit("check"))).otherwise(F.array().cast("array<string>")), "import_method": F.lit("structured"), "source_type": F.when(i % 7 == 0, "pdf").otherwise("json")})
    ok, queued = I.review_gate(r)
    return ok.select(F.lit("accepted").alias("gate"), "question_id").unionByName(queued.select(F.lit("queued").alias("gate"), "question_id"))


@query("""SELECT doc_id AS question_id, concat_ws('; ', CASE WHEN source LIKE '%0' THEN 'question_body must be a non-empty string' END, CASE WHEN source LIKE '%1' THEN 'answer_body must be a string' END, CASE WHEN lang = 'de' THEN 'title must be a non-empty string' END, CASE WHEN source LIKE '%2' THEN 'knowledge_points must be a list of strings' END,
 CASE WHEN n_chars % 5 = 0 THEN 'question_type must be a non-empty string' END, CASE WHEN n_chars % 5 = 1 THEN 'tags must be a list of strings' END, CASE WHEN n_chars % 5 = 2 THEN 'source_pages must be a list of positive integers' END, CASE WHEN n_chars % 5 = 3 THEN 'human_review_needed must be a boolean' END,
 CASE WHEN source NOT LIKE '%0' AND lang = 'fr' AND NOT contains(text, '$') AND NOT contains(text, '\\[') THEN 'LaTeX without delimiters' END, CASE WHEN source NOT LIKE '%0' AND lang = 'es' THEN 'reference to a rendered page' END) AS errors FROM documents""")
def p8_validate_records(spark: SparkSession, d: str) -> DataFrame:
    """Records as JSON, whose sources, languages and lengths tell what is wrong with them."""
    n, lang, source = F.col("n_chars") % 5, F.col("lang"), F.col("source")
    json = lambda c: F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)
    body = F.concat(F.when(lang == "fr", F.lit("\\frac12 ")).when(lang == "es", F.lit("![p](a/page_01.png) ")).otherwise(F.lit("")), F.col("text"))
    record = F.concat(
        F.lit('{"question_body":'), F.when(source.endswith("0"), F.lit('" "')).otherwise(json(body)), F.lit(',"answer_body":'), F.when(source.endswith("1"), F.lit("7")).otherwise(F.lit('""')), F.lit(',"metadata":{"title":'), F.when(lang == "de", F.lit("5")).otherwise(F.lit('"t"')),
        F.lit(',"knowledge_points":'), F.when(source.endswith("2"), F.lit('["a"," "]')).otherwise(F.lit('["a"]')), F.lit(',"question_type":'), F.when(n == 0, F.lit('" "')).otherwise(F.lit("null")), F.lit(',"tags":'), F.when(n == 1, F.lit('"x"')).otherwise(F.lit('["x"]')),
        F.lit(',"source_pages":'), F.when(n == 2, F.lit("[1,0]")).otherwise(F.lit("[]")), F.lit(',"human_review_needed":'), F.when(n == 3, F.lit('"yes"')).otherwise(F.lit("true")), F.lit("}}"),
    )
    return table(spark, d, "documents").select(F.col("doc_id").alias("question_id"), F.array_join(I.record_errors(record), "; ").alias("errors"))


@query("SELECT conv_id AS doc_id, CAST(sum(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS BIGINT) AS n_chars, CASE WHEN sum(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) <= 100 THEN 'scanned' ELSE 'text' END AS route FROM conversations GROUP BY conv_id")
def p13_route_pages(spark: SparkSession, d: str) -> DataFrame:
    return I.route_pages(pages(spark, d))


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), "text")


@query("SELECT source AS batch, id AS question_id, 'duplicate id' AS error FROM (SELECT source, concat('q', substr(md5(text), 1, 12)) AS id FROM documents) GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT source, concat('.bad ', doc_id), 'invalid id' FROM documents WHERE doc_id % 100 = 0")
def u2_preflight_batch(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    own = t.select(F.col("source").alias("batch"), F.concat(F.lit("q"), F.substring(F.md5("text"), 1, 12)).alias("question_id"))
    bad = t.filter("doc_id % 100 = 0").select(F.col("source").alias("batch"), F.concat(F.lit(".bad "), F.col("doc_id").cast("string")).alias("question_id"))
    return I.preflight(own.unionByName(bad))


@query("""SELECT doc_id, concat('fqc_', substr(sha256(encode(concat('{"metadata":{"title":"', source, '"},"question_body":"', md5(text), '","source_type":', CASE WHEN lang = 'de' THEN 'null' ELSE concat('"', lang, '"') END, '}')) || encode('a.png') || '\\x00'::BLOB || unhex(sha256(lang)) || encode('b.png') || '\\x00'::BLOB || unhex(sha256(source))), 1, 20)) AS candidate_id FROM documents""")
def f3_candidate_id(spark: SparkSession, d: str) -> DataFrame:
    """Lifecycle fields and the order of assets and keys change nothing."""
    t = table(spark, d, "documents")
    asset = lambda name, c: F.struct(F.lit(name).alias("name"), F.sha2(c, 256).alias("sha256"))
    assets = F.when(F.col("n_chars") % 2 == 0, F.array(asset("b.png", F.col("source")), asset("a.png", F.col("lang")))).otherwise(F.array(asset("a.png", F.col("lang")), asset("b.png", F.col("source"))))
    record = t.select(
        "doc_id", F.md5("text").alias("question_body"), F.when(F.col("lang") != "de", F.col("lang")).alias("source_type"), F.create_map(F.lit("title"), F.col("source"), F.lit("imported_at"), F.col("n_chars").cast("string")).alias("metadata"),
        F.when(F.col("n_chars") % 3 == 0, "committed").otherwise("pending").alias("state"), F.current_timestamp().alias("updated_at"), assets.alias("assets"),
    )
    return record.select("doc_id", I.candidate_id(record.drop("doc_id")).alias("candidate_id"))


@query("SELECT doc_id AS question_id, sha256(concat('answer.md', chr(0), sha256('x'), chr(10), 'question.md', chr(0), sha256(text))) AS fingerprint FROM documents")
def f4_record_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    files = F.array(F.struct(F.lit("question.md").alias("path"), F.col("text").alias("content")), F.struct(F.lit("answer.md").alias("path"), F.lit("x").alias("content")))
    return I.record_fingerprint(t.select(F.col("doc_id").alias("question_id"), F.explode(files).alias("f")).select("question_id", "f.path", "f.content"))


@query("SELECT conv_id AS doc_id, turn AS segment, coalesce((SELECT min(turn) FROM conversations p WHERE p.conv_id = c.conv_id AND contains(p.text, substr(c.text, 1, 50))), 1) AS page FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL HAVING count(*) = 1) c")
def j11_page_of_segment(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    segments = p.groupBy("doc_id", F.col("page_number").alias("segment")).agg(F.min("text").alias("body"), F.count("*").alias("n")).filter("n = 1").drop("n")
    return I.page_of_segment(segments, p)


@query(with_sql(FLAGS, body="SELECT question_id AS candidate_id, CASE WHEN question_id % 4 = 0 THEN 'new' WHEN question_id % 5 = 0 THEN 'conflict' WHEN question_id % 4 = 1 THEN 'reuse' WHEN question_id % 4 = 2 THEN 'warn' ELSE 'queued' END AS action FROM flags"))
def j12_reuse_reviewed(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("candidate_id")
    incoming = review_flags(spark, d).select(F.col("question_id").alias("candidate_id"), F.lit("s").alias("source"))
    state = F.get(F.array(F.lit("x"), F.lit("committed"), F.lit("rejected"), F.lit("needs_review")), (i % 4).cast("int"))
    old = incoming.filter(i % 4 != 0).select("candidate_id", state.alias("state"), F.when(i % 5 == 0, "other").otherwise("s").alias("source"), i.cast("string").alias("question_id"))
    return I.reuse_reviewed(incoming, old).select("candidate_id", "action")


@query(with_sql(FLAGS, body="""SELECT question_id AS candidate_id, CASE WHEN question_id % 2 = 0 AND question_id % 3 = 0 THEN 'refused: rejected' WHEN question_id % 2 = 0 AND human_review_needed AND question_id % 5 > 0 THEN 'refused: warnings' WHEN question_id % 2 = 0 THEN 'committed'
  WHEN question_id % 3 = 1 THEN 'refused: committed' ELSE 'rejected' END AS outcome, CASE WHEN question_id % 7 = 0 THEN 'edited' ELSE 'body' END AS question_body, CASE WHEN question_id % 7 = 0 THEN 'new' ELSE 'old' END AS title FROM flags"""))
def j13_commit_candidates(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("candidate_id")
    c = review_flags(spark, d).select(F.col("question_id").alias("candidate_id"), "human_review_needed")
    cands = c.select(
        "candidate_id", F.get(F.array(F.lit("rejected"), F.lit("committed"), F.lit("needs_review")), (i % 3).cast("int")).alias("state"), F.when(F.col("human_review_needed"), F.array(F.lit("w"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
        F.lit("body").alias("question_body"), F.create_map(F.lit("title"), F.lit("old"), F.lit("human_review_needed"), F.lit("true")).alias("metadata"),
    )
    edit = i % 7 == 0
    decisions = c.select("candidate_id", F.when(i % 2 == 0, "approve").otherwise("reject").alias("decision"), (i % 5 == 0).alias("acknowledged"), F.when(edit, "edited").alias("question_body"), F.when(edit, F.create_map(F.lit("title"), F.lit("new"))).alias("metadata"))
    return I.commit_candidates(cands, decisions).select("candidate_id", "outcome", "question_body", F.col("metadata")["title"].alias("title"))


@query("""SELECT CAST(coalesce(b.id, c.id) AS VARCHAR) AS question_id, CASE WHEN c.ok THEN coalesce(c.edited, c.body) ELSE b.body END AS question_body, CASE WHEN c.ok THEN coalesce(c.new_title, c.title) ELSE b.title END AS title FROM (SELECT doc_id AS id, md5(text) AS body, lang AS title FROM documents WHERE lang <> 'fr') b
FULL JOIN (SELECT d.doc_id AS id, md5(concat('c', text)) AS body, source AS title, CASE WHEN lang = 'de' THEN 'edited' END AS edited, CASE WHEN lang = 'de' THEN 'new' END AS new_title, quality = 1 AND (toxic = 0 OR lang = 'es') AS ok FROM documents d JOIN labels USING (doc_id)) c USING (id) WHERE c.ok OR b.body IS NOT NULL""")
def j13_commit_to_bank(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents are candidates: those of low quality are rejected, toxic ones have a warning that only Spanish ones' decisions acknowledge; German ones are edited."""
    t = table(spark, d, "documents")
    held = t.filter("lang <> 'fr'").select(F.col("doc_id").cast("string").alias("question_id"), F.md5("text").alias("question_body"), F.create_map(F.lit("title"), F.col("lang")).alias("metadata"))
    c = t.join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    none = F.array().cast("array<string>")
    cands = c.select(
        F.col("doc_id").alias("candidate_id"), F.col("doc_id").cast("string").alias("question_id"), F.lit("needs_review").alias("state"), F.when(F.col("toxic") == 1, F.array(F.lit("w"))).otherwise(none).alias("warnings"), F.md5(F.concat(F.lit("c"), "text")).alias("question_body"), F.create_map(F.lit("title"), F.col("source")).alias("metadata"),
    )
    german = F.col("lang") == "de"
    decisions = c.select(F.col("doc_id").alias("candidate_id"), F.when(F.col("quality") == 1, "approve").otherwise("reject").alias("decision"), (F.col("lang") == "es").alias("acknowledged"), F.when(german, "edited").alias("question_body"), F.when(german, F.create_map(F.lit("title"), F.lit("new"))).alias("metadata"))
    return I.commit_to_bank(held, cands, decisions).filter("question_body is not null").select("question_id", "question_body", F.col("metadata")["title"].alias("title"))


@query(with_sql(BANK, body="SELECT question_id, CASE WHEN question_id % 4 = 0 THEN 'insert' WHEN question_id % 3 = 0 THEN 'keep' WHEN question_id % 5 = 0 THEN 'conflict' ELSE 'skip' END AS action FROM bank"))
def s6_upsert_bank(spark: SparkSession, d: str) -> DataFrame:
    b = bank(spark, d).select("question_id", X.content_hash(F.col("question_body"), F.col("answer_body")).alias("fingerprint"))
    i = F.col("question_id")
    incoming = b.filter((i % 4 == 0) | (i % 3 != 0)).withColumn("fingerprint", F.when(i % 5 == 0, "changed").otherwise(F.col("fingerprint")))
    return I.upsert_bank(b.filter(i % 4 != 0), incoming)


@query("SELECT doc_id AS question_id, md5(CASE WHEN lang = 'de' OR source LIKE '%1' THEN concat('new ', text) ELSE text END) AS body_md5, CASE WHEN lang = 'de' AND source NOT LIKE '%1' THEN source WHEN source LIKE '%1' THEN concat('new ', source) ELSE source END AS metadata FROM documents")
def s6_upserted(spark: SparkSession, d: str) -> DataFrame:
    """The bank after an upsert that overwrites: German texts and those of some sources are new, the former without metadata of their own."""
    t = table(spark, d, "documents")
    own = F.col("source").endswith("1")
    old = t.filter("lang = 'de' or not endswith(source, '1')").select(F.col("doc_id").alias("question_id"), F.col("text").alias("question_body"), F.col("source").alias("metadata"))
    new = t.filter((F.col("lang") == "de") | own).select(F.col("doc_id").alias("question_id"), F.concat(F.lit("new "), F.col("text")).alias("question_body"), F.when(own, F.concat(F.lit("new "), F.col("source"))).alias("metadata"))
    return I.upserted(old, new).select("question_id", F.md5("question_body").alias("body_md5"), "metadata")


OUTCOME = "CASE event_type WHEN 'click' THEN 'imported' WHEN 'view' THEN 'imported' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'review' ELSE 'imported' END"
ROLLED = f"""rolled AS (SELECT *, CASE WHEN review > 0 THEN 'needs_review' WHEN imported > 0 AND errors > 0 THEN 'partial' WHEN imported > 0 THEN 'succeeded' ELSE 'failed' END AS status FROM (SELECT job_id, count(*) AS processed, count(*) FILTER (o = 'imported') AS imported, count(DISTINCT item) FILTER (o = 'review') AS review, count(*) FILTER (o = 'error') AS errors, count(DISTINCT item) FILTER (o = 'imported') AS created
 FROM (SELECT job_id, {OUTCOME} AS o, CAST(floor(value) AS BIGINT) AS item FROM job_events) GROUP BY job_id))"""


def rolled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, d).select("job_id", F.expr(OUTCOME).alias("outcome"), F.floor("value").alias("item"), "event_id")
    return I.job_rollup(e), e


@query(with_sql(EVENTS, body=f"SELECT *, CASE WHEN review > 0 THEN 'needs_review' WHEN imported > 0 AND errors > 0 THEN 'partial' WHEN imported > 0 THEN 'succeeded' ELSE 'failed' END AS status FROM (SELECT job_id, count(*) AS processed, count(*) FILTER (o = 'imported') AS imported, count(*) FILTER (o = 'review') AS review, count(*) FILTER (o = 'error') AS errors FROM (SELECT job_id, {OUTCOME} AS o FROM job_events) GROUP BY job_id)"))
def a9_job_rollup(spark: SparkSession, d: str) -> DataFrame:
    return I.job_rollup(rolled(spark, d)[1].select("job_id", "outcome"))


@query(with_sql(EVENTS, ROLLED, body=f"""SELECT job_id, imported + coalesce(made, 0) AS imported, greatest(review - coalesce(resolved, 0), 0) AS review, errors, CASE WHEN status = 'needs_review' AND review - coalesce(resolved, 0) <= 0 THEN CASE WHEN errors > 0 OR coalesce(rej, false) THEN CASE WHEN imported + coalesce(made, 0) > 0 THEN 'partial' ELSE 'failed' END ELSE 'succeeded' END ELSE status END AS status FROM rolled
LEFT JOIN (SELECT job_id, count(DISTINCT item) AS resolved, count(DISTINCT CASE WHEN item % 2 = 0 THEN item END) AS made, bool_or(item % 2 = 1) AS rej FROM (SELECT job_id, {OUTCOME} AS o, CAST(floor(value) AS BIGINT) AS item FROM job_events) WHERE o = 'review' AND (job_id < 100 OR item < 10) GROUP BY job_id) USING (job_id)"""))
def a9_resolved_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Events name items by their value, so jobs meet some twice. Candidates are resolved in the first hundred jobs, elsewhere those of small values; odd ones are rejected."""
    jobs, e = rolled(spark, d)
    c = e.filter("outcome = 'review' and (job_id < 100 or item < 10)").select("job_id", F.col("item").alias("candidate_id"), F.when(F.col("item") % 2 == 0, F.col("item")).alias("question_id"), (F.col("item") % 2 == 1).alias("rejected"))
    return I.resolve_jobs(jobs, c)


J10 = """st AS (SELECT p_partkey AS id, concat(p_name, ' ', p_brand) AS s FROM part), c AS (SELECT min(id) AS id, s FROM st GROUP BY s), g AS (SELECT id, list_distinct(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS g FROM c)"""


@query(f"WITH {J10} SELECT 'pair' AS kind, x.id AS a, y.id AS b, round(len(list_intersect(x.g, y.g)) / len(y.g), 6) AS ratio FROM g x, g y WHERE x.id <> y.id AND len(list_intersect(x.g, y.g)) / len(y.g) > 0.86 UNION ALL SELECT 'member', st.id, c.id, NULL FROM st JOIN c USING (s)")
def j10_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of classes of equal stems, and every question's class."""
    stems = table(spark, d, "part").select(F.col("p_partkey").alias("question_id"), F.concat_ws(" ", "p_name", "p_brand").alias("stem"))
    members = I.stem_classes(stems).select(F.lit("member").alias("kind"), F.col("question_id").alias("a"), F.col("class_id").alias("b"), F.lit(None).cast("double").alias("ratio"))
    return I.near_duplicates(stems).select(F.lit("pair").alias("kind"), "a", "b", "ratio").unionByName(members)


@query("SELECT doc_id, length(body) AS n, lang AS topic, doc_id % 3 = 0 AS human_review_needed FROM (SELECT doc_id, lang, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM documents) WHERE length(body) >= 10")
def s1_read_records(spark: SparkSession, d: str) -> DataFrame:
    """The bank as JSON batches, read back."""
    path = new_path(spark, "records")
    i = F.col("doc_id")
    out = table(spark, d, "documents").select(F.concat(F.lit("q"), i.cast("string")).alias("question_id"), F.when(i % 2 == 0, F.col("text")).alias("question_body"), F.when(i % 2 == 1, F.col("text")).alias("question"), (i % 3 == 0).alias("human_review_needed"), F.when(i % 5 < 2, F.array("lang")).alias("concepts"), F.when(i % 5 >= 2, F.struct(F.array("lang").alias("knowledge_points"), F.array(F.lit("1"), F.lit("x")).alias("source_pages"))).alias("metadata"))
    out.write.json(path)
    r = records.normalize(spark.read.schema(records.RAW).json(path))
    return r.select(F.substring("question_id", 2, 20).cast("long").alias("doc_id"), F.length("question_body").cast("long").alias("n"), F.get("topics", F.lit(0)).alias("topic"), "human_review_needed")


def _text_files(spark: SparkSession, d: str) -> str:
    """Documents as text files: one file for each thousand ids of a language and source, so none grows with the table."""
    path = new_path(spark, "texts")
    t = table(spark, d, "documents").withColumn("part", F.expr("doc_id div 1000")).groupBy("lang", "source", "part").agg(F.expr("listagg(text, '\n') within group (order by doc_id)").alias("value"))
    write_text_files(t, path, ["lang", "source", "part"], ".txt")
    return path


def _file_keys() -> list:
    part = lambda k: F.regexp_extract("path", f"{k}=([^/.]*)", 1)
    return [part("lang").alias("lang"), part("source").alias("source"), part("part").cast("long").alias("part")]


@query("SELECT lang, source, doc_id // 1000 AS part, 'text' AS format, CAST(sum(length(text) + 1) AS BIGINT) AS n FROM documents GROUP BY ALL")
def s2_read_text_sources(spark: SparkSession, d: str) -> DataFrame:
    return records.read_text_sources(spark, _text_files(spark, d)).select(*_file_keys(), "format", F.length("body").cast("long").alias("n"))


@query("SELECT lang, source, part, 'text' AS source_type, CASE WHEN n <= 1048576 THEN h END AS sha256, CASE WHEN n > 1048576 THEN 'too large' END AS error FROM (SELECT lang, source, doc_id // 1000 AS part, sum(strlen(text) + 1) AS n, sha256(concat(string_agg(text, chr(10) ORDER BY doc_id), chr(10))) AS h FROM documents GROUP BY ALL)")
def s4_source_manifest(spark: SparkSession, d: str) -> DataFrame:
    """With a limit of a megabyte, files beyond it are rows with an error."""
    return records.source_manifest(spark, _text_files(spark, d), 1).select(*_file_keys(), "source_type", "sha256", "error")


@query("SELECT p_partkey AS question_id, p_name AS stem, CASE WHEN p_partkey % 10 = 0 THEN 'missing: answer' END AS error, 'A:yes B:no' AS options, concat(p_brand, '|', p_type) AS topics FROM part")
def s5_read_csv_template(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "csv")
    p = table(spark, d, "part")
    names = [c.split(" ")[0] for c in records.CSV_COLUMNS.split(", ")]
    given = {"question_id": F.col("p_partkey").cast("string"), "question_type": F.col("p_type"), "stem": F.col("p_name"), "option_a": F.lit("yes"), "option_b": F.lit("no"), "answer": F.when(F.col("p_partkey") % 10 > 0, "A"), "answer_type": F.lit("choice"), "difficulty": F.lit("3"), "knowledge_points": F.concat_ws("; ", "p_brand", "p_type")}
    p.select(*(given.get(n, F.lit(None).cast("string")).alias(n) for n in names)).write.option("header", True).csv(path)
    r = records.read_csv_template(spark, path)
    return r.select(F.col("question_id").cast("long").alias("question_id"), "stem", "error", F.array_join(F.transform("options", lambda o: F.concat_ws(":", o["label"], o["content"])), " ").alias("options"), F.array_join("topics", "|").alias("topics"))
