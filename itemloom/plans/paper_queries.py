"""Queries of paper assembly, validation and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.functions import text as X
from itemloom.operators import papers as P
from itemloom.plans.registry import query
from itemloom.sources.adapters import PAPERS, PQ, QUESTIONS, SECTIONS, paper_questions, papers, questions, sections, with_sql
from itemloom.sources.workspace import kept, new_path

TYPED = "typed AS (SELECT pq.*, question_type, status, stem, difficulty FROM pq JOIN questions USING (question_id))"
NTH = "nth AS (SELECT *, row_number() OVER (PARTITION BY paper_id, question_type ORDER BY order_index, question_id, price) AS n FROM typed)"
CAP = "cap AS (SELECT *, sum(need) OVER (PARTITION BY paper_id, question_type ORDER BY section_index) AS hi FROM sections)"
ASSIGNED = "assigned AS (SELECT n.paper_id, n.question_id, n.question_type, n.order_index, c.section_index FROM nth n LEFT JOIN cap c ON n.paper_id = c.paper_id AND n.question_type = c.question_type AND c.hi - c.need < n.n AND n.n <= c.hi)"
BASE = (QUESTIONS, PAPERS, PQ, SECTIONS, TYPED, NTH, CAP, ASSIGNED)


def typed(spark: SparkSession, d: str) -> DataFrame:
    return paper_questions(spark, d).join(questions(spark, d).select("question_id", "question_type", "status", "stem", "difficulty"), "question_id")


def assigned(spark: SparkSession, d: str) -> DataFrame:
    return P.assign_sections(typed(spark, d), sections(spark, d))


SCORE = "least(least(CASE WHEN topic % 5 = p THEN 1 ELSE 0 END * 0.3 + CASE WHEN topic % 3 = 0 THEN 0.3 ELSE 0 END, 0.6) + CASE WHEN 1 - abs(difficulty - round_even(1.5 + p, 0)) / 4 > 0 THEN (1 - abs(difficulty - round_even(1.5 + p, 0)) / 4) * 0.3 ELSE 0 END + CASE WHEN tag IN ('Brand#1', 'Brand#2') THEN 0.1 ELSE 0 END, 1.0)"
PROFILES = f"profiles AS (SELECT p AS profile, question_type, question_id, round(CAST({SCORE} AS DOUBLE), 6) AS score FROM questions, (SELECT unnest([0, 1, 2, 3]) AS p) WHERE status = 'approved')"


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """Every approved question scored for four sets of constraints."""
    q = questions(spark, d).filter("status = 'approved'").withColumn("profile", F.explode(F.array(*(F.lit(x).cast("long") for x in range(4)))))
    matches = F.when(F.col("topic") % 5 == F.col("profile"), 1).otherwise(0) + F.when(F.col("topic") % 3 == 0, 1).otherwise(0)
    score = P.candidate_score(matches, F.col("difficulty"), F.col("profile") + 1.5, F.col("tag").isin("Brand#1", "Brand#2"))
    return q.select("profile", "question_type", "question_id", F.round(score, 6).alias("score"), F.concat_ws(" ", "stem", "tag", "size").alias("stem"), F.lit(True).alias("constrained"))


@query(with_sql(QUESTIONS, PROFILES, body="SELECT profile, question_id, score FROM profiles"))
def f12_candidate_score(spark: SparkSession, d: str) -> DataFrame:
    return profiles(spark, d).select("profile", "question_id", "score")


@query(with_sql(QUESTIONS, body="SELECT s.question_type, question_id, least, most FROM (SELECT DISTINCT question_type, CAST(1 + ascii(question_type) % 3 AS BIGINT) AS least, CAST(3 + ascii(question_type) % 3 AS BIGINT) AS most, ascii(question_type) % 2 = 0 AS narrow FROM questions) s JOIN questions q ON s.question_type = q.question_type WHERE status = 'approved' AND difficulty BETWEEN least AND most AND (NOT narrow OR topic IN (1, 2, 3, 4, 5, 6, 7, 8))"))
def j1_candidates_for_sections(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d)
    code = F.ascii("question_type")
    s = q.select("question_type").distinct().select("question_type", (1 + code % 3).cast("long").alias("least"), (3 + code % 3).cast("long").alias("most"), F.when(code % 2 == 0, F.array(*(F.lit(x).cast("long") for x in range(1, 9)))).otherwise(F.array().cast("array<long>")).alias("topics"))
    return P.candidates_for_sections(s, q).select("question_type", "question_id", "least", "most")


@query(with_sql(QUESTIONS, PQ, body="SELECT DISTINCT paper_id, question_id FROM pq WHERE NOT is_locked AND (paper_id, question_id) NOT IN (SELECT paper_id, question_id FROM pq WHERE is_locked)"))
def j2_exclude_assigned(spark: SparkSession, d: str) -> DataFrame:
    pq = paper_questions(spark, d)
    return P.exclude_assigned(pq.filter("not is_locked").select("paper_id", "question_id").distinct(), pq.filter("is_locked"))


@query(with_sql(*BASE, body="SELECT * FROM (SELECT paper_id, question_id, question_type, order_index, coalesce(section_index, -1) AS section_index FROM assigned)"))
def j8_assign_sections(spark: SparkSession, d: str) -> DataFrame:
    return assigned(spark, d).na.fill(-1, ["section_index"])


@query(with_sql(PAPERS, SECTIONS, body="SELECT paper_id, question_type, section_index, CAST(sum(need) OVER (PARTITION BY paper_id, question_type ORDER BY section_index) AS BIGINT) AS hi FROM sections"))
def w4_section_capacity(spark: SparkSession, d: str) -> DataFrame:
    return P.section_capacity(sections(spark, d)).select("paper_id", "question_type", "section_index", "hi")


@query(with_sql(*BASE, body="SELECT *, greatest(need - filled, 0) AS shortfall FROM (SELECT s.paper_id, s.section_index, need, count(a.question_id) AS filled FROM sections s LEFT JOIN assigned a ON s.paper_id = a.paper_id AND s.section_index = a.section_index GROUP BY s.paper_id, s.section_index, need)"))
def a6_section_fill(spark: SparkSession, d: str) -> DataFrame:
    return P.section_fill(assigned(spark, d), sections(spark, d)).select("paper_id", "section_index", "need", "filled", "shortfall")


PLACED = "placed AS (SELECT pq.*, CASE WHEN question_id % 7 = 0 THEN 100 - order_index END AS manual_position, CAST(coalesce(ascii(question_type) % 5, 9) AS BIGINT) AS section_index FROM pq LEFT JOIN (SELECT question_id, question_type FROM questions WHERE status <> 'rejected') USING (question_id))"


@query(with_sql(QUESTIONS, PQ, PLACED, body="SELECT paper_id, question_id, order_index, price, row_number() OVER (PARTITION BY paper_id ORDER BY ph, CASE WHEN ph = 0 THEN order_index WHEN ph = 1 THEN manual_position END NULLS FIRST, CASE WHEN ph = 2 THEN nullif(section_index, 9) END NULLS LAST, score DESC, order_index, question_id, price) AS place FROM (SELECT *, CASE WHEN is_locked THEN 0 WHEN manual_position IS NOT NULL THEN 1 ELSE 2 END AS ph FROM placed)"))
def w2_order_paper(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh question was asked for, the last lines first; sections are by type, and rejected questions have none."""
    types = questions(spark, d).filter("status <> 'rejected'").select("question_id", (F.ascii("question_type") % 5).cast("long").alias("section_index"))
    pq = paper_questions(spark, d).join(types, "question_id", "left").withColumn("manual_position", F.when(F.col("question_id") % 7 == 0, 100 - F.col("order_index")))
    return P.order_paper(pq).select("paper_id", "question_id", "order_index", "price", "place")


@query(with_sql(QUESTIONS, PAPERS, PQ, body="SELECT n.paper_id, n.question_id, greatest(coalesce(last, 0), 0) + row_number() OVER (PARTITION BY n.paper_id ORDER BY n.question_id) AS order_index FROM (SELECT paper_id, unnest([paper_id % 1000, paper_id % 1000 + 1000]) AS question_id FROM papers) n LEFT JOIN (SELECT paper_id, max(order_index) AS last FROM pq GROUP BY paper_id) USING (paper_id)"))
def w3_append_order(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("paper_id") % 1000
    return P.append_order(paper_questions(spark, d), papers(spark, d).select("paper_id", F.explode(F.array(k, k + 1000)).alias("question_id")))


FILL = "fill AS (SELECT s.paper_id, s.section_index, need, count(a.question_id) AS filled FROM sections s LEFT JOIN assigned a ON s.paper_id = a.paper_id AND s.section_index = a.section_index GROUP BY s.paper_id, s.section_index, need)"


@query(with_sql(*BASE, FILL, body="""SELECT paper_id, n, not_approved, locked, n > 0 AND not_approved = 0 AND n = need AND abs(total - points) < 0.01 AND images = 0 AS is_valid, concat_ws('; ', CASE WHEN not_approved > 0 THEN 'questions not approved' END, CASE WHEN n <> need THEN 'wrong number of questions' END, CASE WHEN abs(total - points) >= 0.01 THEN 'wrong total score' END) AS errors,
concat_ws('; ', short, CASE WHEN images > 0 THEN concat(images, ' images missing') END) AS warnings
FROM (SELECT p.paper_id, coalesce(n, 0) AS n, coalesce(not_approved, 0) AS not_approved, coalesce(total, 0) AS total, coalesce(locked, 0) AS locked, need, points, short, coalesce(images, 0) AS images FROM papers p
LEFT JOIN (SELECT paper_id, count(*) AS n, count(*) FILTER (NOT coalesce(status = 'approved', false)) AS not_approved, sum(pq.score) AS total, count(*) FILTER (is_locked) AS locked, count(*) FILTER (size > 45) AS images FROM pq LEFT JOIN questions USING (question_id) GROUP BY paper_id) USING (paper_id)
LEFT JOIN (SELECT paper_id, sum(need) AS need, sum(need * score_each) AS points FROM sections GROUP BY paper_id) USING (paper_id)
LEFT JOIN (SELECT paper_id, string_agg(concat('section ', section_index, ': ', filled, '/', need, ' filled'), '; ' ORDER BY section_index) AS short FROM fill WHERE filled < need GROUP BY paper_id) USING (paper_id))"""))
def a7_validate_papers(spark: SparkSession, d: str) -> DataFrame:
    """The images of large questions are missing."""
    q = questions(spark, d)
    placed = assigned(spark, d).join(q.select("question_id", "status", "size"), "question_id")
    scores = P.assign_sections(typed(spark, d), sections(spark, d), ["score", "is_locked"])
    missing = placed.filter("size > 45").select("paper_id")
    v = P.validate_papers(papers(spark, d), sections(spark, d), scores, q, missing)
    return v.select("paper_id", "n", "not_approved", "locked", "is_valid", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


@query(with_sql(*BASE, body="""SELECT paper_id, layout_warnings, wide_formulas, avg_difficulty, n_unanswered, first_unanswered, difficulty_note, coalesce(uneven, false) AS uneven FROM (SELECT paper_id, count(*) FILTER (length(stem) < 15) AS layout_warnings, count(*) FILTER (size % 3 = 0 AND size > 30) AS wide_formulas, round(avg(CASE WHEN difficulty > 0 THEN difficulty END), 6) AS avg_difficulty, count(*) FILTER (question_id % 3 = 0) AS n_unanswered,
 coalesce(array_to_string(list_sort(list(order_index) FILTER (question_id % 3 = 0))[1:5], ','), '') AS first_unanswered, coalesce(CASE WHEN avg(difficulty) < 2 THEN 'easy' WHEN avg(difficulty) > 8 THEN 'hard' END, '') AS difficulty_note FROM (SELECT pq.paper_id, question_id, order_index, difficulty, size, CASE WHEN size % 3 = 0 THEN concat(stem, ' with a display formula') ELSE stem END AS stem FROM pq JOIN questions USING (question_id)) GROUP BY paper_id)
 LEFT JOIN (SELECT paper_id, max(filled) - min(filled) > 5 AND count(*) >= 2 AS uneven FROM (SELECT paper_id, question_type, count(*) * 3 AS filled FROM typed GROUP BY ALL) GROUP BY paper_id) USING (paper_id)"""))
def a8_review_papers(spark: SparkSession, d: str) -> DataFrame:
    """Every third size brings a display formula four characters long for each unit of size; fills count a question three times."""
    formula = F.concat("stem", F.lit(" with a display formula $$"), F.expr("repeat('x+1=', cast(size as int))"), F.lit("$$"))
    t = paper_questions(spark, d).join(questions(spark, d).select("question_id", "question_type", "size", "difficulty", F.when(F.col("size") % 3 == 0, formula).otherwise(F.col("stem")).alias("stem")), "question_id")
    t = t.withColumn("num", F.col("order_index")).withColumn("has_answers", F.col("question_id") % 3 != 0)
    fills = t.groupBy("paper_id", "question_type").agg((F.count("*") * 3).alias("filled"))
    r = P.review_papers(t, fills)
    return r.select("paper_id", "layout_warnings", "wide_formulas", F.round("avg_difficulty", 6).alias("avg_difficulty"), "n_unanswered", F.array_join("first_unanswered", ",").alias("first_unanswered"), F.coalesce("difficulty_note", F.lit("")).alias("difficulty_note"), F.coalesce("uneven", F.lit(False)).alias("uneven"))


@query(with_sql(PQ, body="SELECT paper_id AS export_id, order_index, question_id, price, count(*) OVER (PARTITION BY paper_id, order_index) > 1 AND order_index IS NOT NULL AS duplicated FROM pq"))
def a15_duplicate_numbers(spark: SparkSession, d: str) -> DataFrame:
    s = paper_questions(spark, d).select(F.col("paper_id").alias("export_id"), F.col("order_index").alias("number"), "question_id", "price")
    return P.duplicate_numbers(s).withColumnRenamed("number", "order_index")


RESOLVED = """resolved AS (SELECT export_id, question_id, row_number() OVER (PARTITION BY export_id ORDER BY origin, position, question_id) AS place FROM (SELECT paper_id AS export_id, question_id, min(CASE WHEN is_locked THEN 0 ELSE 1 END) AS origin, CASE WHEN min(CASE WHEN is_locked THEN 0 ELSE 1 END) = 0 THEN min(order_index) FILTER (is_locked) ELSE min(order_index) END AS position FROM pq GROUP BY ALL) QUALIFY place <= 4)"""


def resolved(spark: SparkSession, d: str) -> DataFrame:
    pq = paper_questions(spark, d).withColumnRenamed("paper_id", "export_id")
    return P.resolve_export(pq.filter("is_locked").withColumn("position", F.col("order_index")), pq.filter("not is_locked").withColumn("rank", F.col("order_index")), 4)


@query(with_sql(PQ, RESOLVED, body="SELECT * FROM resolved"))
def t7_resolve_export(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d)


HEADED = "headed AS (SELECT export_id, question_id, place, number, CASE WHEN count(*) OVER (PARTITION BY export_id, number) > 1 THEN concat('第 ', place, ' 题（', tag, '原第 ', number, ' 题）') ELSE concat('第 ', number, ' 题') END AS heading, stem FROM (SELECT *, size AS number FROM resolved JOIN questions USING (question_id)))"


def headed(spark: SparkSession, d: str) -> DataFrame:
    r = resolved(spark, d).join(questions(spark, d).select("question_id", "tag", "stem", F.col("size").cast("string").alias("number")), "question_id")
    label = F.concat("tag", F.lit("原第 "), F.col("number"), F.lit(" 题"))
    return P.duplicate_numbers(r).withColumn("heading", X.paper_heading(F.col("number"), F.col("duplicated"), F.col("place"), label))


@query(with_sql(PQ, QUESTIONS, RESOLVED, HEADED, body="SELECT export_id, question_id, place, heading FROM headed"))
def f17_paper_heading(spark: SparkSession, d: str) -> DataFrame:
    return headed(spark, d).select("export_id", "question_id", "place", "heading")


TEX = "tex AS (SELECT export_id, string_agg(concat('\\typeout{QUESTION_ID=', question_id, '}', chr(10), '\\subsection*{', heading, '}', chr(10), stem), concat(chr(10), chr(10)) ORDER BY place) AS tex FROM headed GROUP BY export_id)"


@query(with_sql(PQ, QUESTIONS, RESOLVED, HEADED, TEX, body="SELECT export_id, md5(tex) AS tex_md5 FROM tex"))
def a19_assemble_tex(spark: SparkSession, d: str) -> DataFrame:
    return P.assemble_tex(headed(spark, d).withColumn("body", F.col("stem"))).select("export_id", F.md5("tex").alias("tex_md5"))


ESC = "replace({}, '#', '\\#')"
ITEMS = f"""items AS (SELECT a.paper_id, a.section_index, a.order_index, a.question_id, concat('\\item (', CAST(coalesce(nullif(CASE WHEN q.question_id % 7 = 0 THEN 0.0::DOUBLE ELSE a.score END, 0), CASE WHEN a.section_index IS NOT NULL THEN 5.0::DOUBLE END, 0.0::DOUBLE) AS VARCHAR), '分) ', CASE WHEN q.question_id % 13 = 0 THEN '\\textit{{（题目正文缺失）}}' ELSE q.stem END,
 CASE WHEN q.question_id % 2 = 0 THEN concat(chr(10), '\\begin{{enumerate}}[label=\\Alph*.]', chr(10), '\\item ', {ESC.format('q.tag')}, chr(10), '\\item none', chr(10), '\\end{{enumerate}}') ELSE '' END,
 CASE WHEN q.question_id % 13 <> 0 AND q.question_id % 11 = 0 THEN concat(chr(10), '\\begin{{center}}', chr(10), '\\includegraphics[width=0.65\\linewidth,height=0.26\\textheight,keepaspectratio]{{assets/f', q.question_id, '.png}}', chr(10), '\\end{{center}}') ELSE '' END) AS item,
 concat('\\item', chr(10), coalesce(CASE WHEN a.section_index IS NULL THEN coalesce(an, so) ELSE nullif(concat_ws(chr(10), an, so), '') END, '\\textbf{{未提供答案}}')) AS answer
 FROM nth_scored a JOIN (SELECT *, CASE WHEN question_id % 3 > 0 THEN concat('\\textbf{{答案:}}', chr(10), question_type) END AS an, CASE WHEN question_id % 5 = 0 THEN concat('\\textbf{{解析:}}', chr(10), '\\begin{{enumerate}}[label=\\arabic*.]', chr(10), '\\item first', chr(10), '\\item then ', {ESC.format('tag')}, chr(10), '\\end{{enumerate}}') END AS so FROM questions) q USING (question_id))"""
SCORED_NTH = "nth_scored AS (SELECT n.paper_id, n.question_id, n.order_index, n.score, c.section_index FROM nth n LEFT JOIN cap c ON n.paper_id = c.paper_id AND n.question_type = c.question_type AND c.hi - c.need < n.n AND n.n <= c.hi)"
PARTS = """grouped AS (SELECT paper_id, section_index, string_agg(item, concat(chr(10), chr(10)) ORDER BY order_index, question_id, item) AS items, string_agg(answer, concat(chr(10), chr(10)) ORDER BY order_index, question_id, answer) AS answers FROM items GROUP BY ALL),
named AS (SELECT s.paper_id, s.section_index AS seat, question_type AS name, question_type AS answer_name, items, answers FROM sections s LEFT JOIN grouped g ON s.paper_id = g.paper_id AND s.section_index = g.section_index UNION ALL SELECT paper_id, 1099511627776, '其他题目', '其他题目 — 答案', items, answers FROM grouped WHERE section_index IS NULL),
parts AS (SELECT paper_id, seat, concat('\\section*{', name, '}', chr(10), coalesce('\\begin{enumerate}[resume]' || chr(10) || items || chr(10) || '\\end{enumerate}', '\\textit{（本部分暂无题目）}')) AS qp, concat('\\section*{', answer_name, '}', chr(10), coalesce('\\begin{enumerate}[resume]' || chr(10) || answers || chr(10) || '\\end{enumerate}', '\\textit{（本部分暂无题目）}')) AS ap FROM named),
whole AS (SELECT paper_id, concat('\\title{Paper ', paper_id, '}', chr(10), chr(10), string_agg(qp, concat(chr(10), chr(10)) ORDER BY seat)) AS q, concat('\\title{Paper ', paper_id, ' — 参考答案}', chr(10), chr(10), string_agg(ap, concat(chr(10), chr(10)) ORDER BY seat)) AS a FROM parts GROUP BY paper_id)"""


def structured(spark: SparkSession, d: str, again: bool = False) -> tuple[DataFrame, DataFrame]:
    """Papers' TeX, and what stands in them (again: both are used, so questions get their sections once): scores are missing for every seventh question, stems for every thirteenth, and some have images, options, answers and steps."""
    k = F.col("question_id")
    q = questions(spark, d).select(
        "question_id", F.when(k % 13 == 0, " ").when(k % 11 == 0, F.concat("stem", F.lit(" ![f](x/f"), k.cast("string"), F.lit(".png)"))).otherwise(F.col("stem")).alias("stem"), F.when(k % 2 == 0, F.array(F.col("tag"), F.lit("none"))).otherwise(F.array().cast("array<string>")).alias("options"),
        F.when(k % 3 > 0, F.array("question_type")).otherwise(F.array().cast("array<string>")).alias("answers"), F.when(k % 5 == 0, F.array(F.lit("first"), F.concat(F.lit("then "), "tag"))).otherwise(F.array().cast("array<string>")).alias("steps"),
    )
    pq = P.assign_sections(typed(spark, d), sections(spark, d), ["score"]).withColumn("score", F.when(k % 7 == 0, 0.0).otherwise(F.col("score")))
    pq = kept(pq, "assigned") if again else pq
    named = sections(spark, d).withColumn("name", F.col("question_type"))
    titled = papers(spark, d).select("paper_id", F.concat(F.lit("Paper "), F.col("paper_id").cast("string")).alias("title"))
    return P.assemble_papers(titled, named, pq, q), pq.select("paper_id", "question_id", "order_index").join(q.select("question_id", X.image_refs(F.col("stem")).alias("assets")), "question_id")


@query(with_sql(*BASE, SCORED_NTH, ITEMS, PARTS, body="SELECT paper_id, md5(q) AS questions_md5, md5(a) AS answers_md5 FROM whole"))
def a19_structured_papers(spark: SparkSession, d: str) -> DataFrame:
    return structured(spark, d)[0].select("paper_id", F.md5("questions_tex").alias("questions_md5"), F.md5("answers_tex").alias("answers_md5"))


@query(with_sql(*BASE, SCORED_NTH, body="""SELECT p.paper_id, p.status, coalesce(s.t, '') AS sections, coalesce(s.n, 0) AS section_count, coalesce(q.t, '') AS questions, coalesce(q.n, 0) AS question_count FROM papers p
LEFT JOIN (SELECT paper_id, string_agg(concat(section_index, ':', need, ':', filled), ';' ORDER BY section_index) AS t, count(*) AS n FROM (SELECT s.paper_id, s.section_index, need, count(a.question_id) AS filled FROM sections s LEFT JOIN nth_scored a ON s.paper_id = a.paper_id AND s.section_index = a.section_index GROUP BY ALL) GROUP BY paper_id) s USING (paper_id)
LEFT JOIN (SELECT paper_id, string_agg(concat(order_index, ' ', question_id, ' ', stem), ';' ORDER BY order_index, question_id, stem) AS t, count(*) AS n FROM nth_scored JOIN (SELECT question_id, stem[1:200] AS stem FROM questions) USING (question_id) GROUP BY paper_id) q USING (paper_id)"""))
def a18_nest_paper(spark: SparkSession, d: str) -> DataFrame:
    pq = P.assign_sections(typed(spark, d), sections(spark, d), ["score", "is_locked"])
    full = P.nest_papers(papers(spark, d).select("paper_id", "status"), sections(spark, d), pq, questions(spark, d))
    text = lambda c, *names, sep=":": F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws(sep, *(x[n].cast("string") for n in names))), ";"), F.lit(""))
    return full.select("paper_id", "status", text("sections", "section_index", "need", "question_count").alias("sections"), "section_count", text("questions", "order_index", "question_id", "stem", sep=" ").alias("questions"), "question_count")


@query(with_sql(*BASE, SCORED_NTH, ITEMS, PARTS, body="SELECT (SELECT CAST(sum(length(q)) AS BIGINT) FROM whole) AS question_chars, (SELECT CAST(sum(length(a)) AS BIGINT) FROM whole) AS answer_chars, count(*) AS manifest_rows, count(*) FILTER (question_id % 13 <> 0 AND question_id % 11 = 0) AS assets FROM nth_scored"))
def s8_write_exports(spark: SparkSession, d: str) -> DataFrame:
    """Both texts of each paper in folders by a hash of the paper, and a manifest of questions and their assets, all compressed; both are read back."""
    path = new_path(spark, "exports")
    tex, held = structured(spark, d, again=True)
    tex.select(F.pmod("paper_id", F.lit(16)).alias("bucket"), F.to_json(F.struct("paper_id", "questions_tex", "answers_tex")).alias("value")).write.partitionBy("bucket").option("compression", "gzip").text(f"{path}/tex")
    manifest = held.select("paper_id", "question_id", "order_index", "assets")
    manifest.write.option("compression", "gzip").json(f"{path}/manifest")
    texts = spark.read.text(f"{path}/tex").select(F.from_json("value", "paper_id long, questions_tex string, answers_tex string").alias("t"))
    back = spark.read.schema(manifest.schema).json(f"{path}/manifest")
    chars = texts.agg(F.sum(F.length("t.questions_tex")).alias("question_chars"), F.sum(F.length("t.answers_tex")).alias("answer_chars"))
    return chars.crossJoin(back.agg(F.count("*").alias("manifest_rows"), F.sum(F.size("assets")).cast("long").alias("assets")))


@query()
def t6_fill_sections(spark: SparkSession, d: str) -> DataFrame:
    s = sections(spark, d).withColumn("profile", F.col("paper_id") % 4)
    return P.fill_sections(s, profiles(spark, d), paper_questions(spark, d).filter("is_locked").select("paper_id", "question_id"))
