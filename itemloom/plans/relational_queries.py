"""Queries of the relational operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.operators import relational as R
from itemloom.plans.registry import query
from itemloom.sources.adapters import EVENTS, FLAGS, PAPERS, PQ, QUESTIONS, TOPICS, events, paper_questions, papers, questions, review_flags, table, topics, with_sql

# fixed values: which moves are allowed
PAPER_MOVES = [("draft", "assembled"), ("draft", "archived"), ("assembled", "exported"), ("assembled", "archived"), ("exported", "archived"), ("archived", "draft")]
QUESTION_MOVES = [("draft", "pending_review"), ("pending_review", "approved"), ("pending_review", "rejected"), ("approved", "archived"), ("archived", "approved")]


@query(with_sql(QUESTIONS, body="SELECT question_id, stem, difficulty, (SELECT count(*) FROM questions WHERE stem ILIKE '%ring%' AND status = 'approved' AND difficulty BETWEEN 2 AND 4 AND topic IN (1, 2, 3, 4, 5, 6, 7)) AS total FROM questions WHERE stem ILIKE '%ring%' AND status = 'approved' AND difficulty BETWEEN 2 AND 4 AND topic IN (1, 2, 3, 4, 5, 6, 7) ORDER BY age_days, question_id LIMIT 20 OFFSET 5"))
def p4_list_questions(spark: SparkSession, d: str) -> DataFrame:
    found = R.list_questions(questions(spark, d), q="ring", status="approved", difficulty=(2, 4), topics=[1, 2, 3, 4, 5, 6, 7])
    return R.paged(found, [F.col("age_days"), F.col("question_id")], 5, 20).select("question_id", "stem", "difficulty", "total")


@query(with_sql(QUESTIONS, body="SELECT question_id, stem, (SELECT count(*) FROM questions) AS total FROM questions QUALIFY row_number() OVER (ORDER BY age_days, question_id) - (SELECT count(*) FROM questions) * 9 // 10 BETWEEN 1 AND 50"))
def p4_deep_page(spark: SparkSession, d: str) -> DataFrame:
    """A page at nine tenths of all questions, cut from the ranges that hold it."""
    q = questions(spark, d)
    return R.paged(q, [F.col("age_days"), F.col("question_id")], q.count() * 9 // 10, 50, near=0).select("question_id", "stem", "total")


@query(with_sql(QUESTIONS, body="SELECT question_id, stem, (SELECT count(*) FROM questions WHERE status = 'pending_review' AND stem ILIKE '%red%') AS total FROM questions WHERE status = 'pending_review' AND stem ILIKE '%red%' ORDER BY question_id DESC LIMIT 50"))
def p6_pending_review(spark: SparkSession, d: str) -> DataFrame:
    found = R.list_questions(questions(spark, d), q="red", status="pending_review")
    return R.paged(found, [F.desc("question_id")], 0, 50).select("question_id", "stem", "total")


@query(with_sql(QUESTIONS, body="SELECT tag AS batch, row_number() OVER (PARTITION BY tag ORDER BY question_id) - 1 AS batch_index, question_id, errors FROM (SELECT tag, question_id, concat_ws('; ', CASE WHEN size = 13 THEN 'stem is required' END, CASE WHEN size - 20 NOT BETWEEN 0 AND 10 AND size <> 7 THEN 'difficulty must be 0 to 10' END, CASE WHEN length(concat(question_type, repeat('x', size))) > 25 THEN 'question_type is longer than 25' END, CASE WHEN length(repeat(stem, 5)) > 50 THEN 'grade is longer than 50' END) AS errors FROM questions)"))
def p9_validate_relational(spark: SparkSession, d: str) -> DataFrame:
    """Batches are brands; stems, difficulties and lengths go by the question's size and stem."""
    size = F.col("size")
    q = questions(spark, d).withColumns({"grade": F.repeat("stem", F.lit(5)), "stem": F.when(size != 13, F.col("stem")), "difficulty": F.when(size != 7, size - 20), "question_type": F.concat("question_type", F.expr("repeat('x', cast(size as int))"))})
    return R.validate_relational(q, "tag", "question_id").select(F.col("tag").alias("batch"), "batch_index", "question_id", F.array_join("errors", "; ").alias("errors"))


@query(with_sql(QUESTIONS, body="SELECT question_id FROM questions WHERE topic = 7 OR age_days > 180"))
def p11_exclude_recent(spark: SparkSession, d: str) -> DataFrame:
    """Questions of one topic were never updated."""
    now = F.lit("2024-06-01").cast("timestamp")
    q = questions(spark, d).withColumn("updated_at", F.when(F.col("topic") != 7, now - F.make_dt_interval(F.col("age_days").cast("int"))))
    return R.exclude_recent(q, 180, now).select("question_id")


@query("""SELECT 'artifact' AS kind, CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_partkey * 7 % 400 > 300 UNION ALL SELECT 'job', CAST(o_orderkey AS VARCHAR) FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT LIKE '1%' AND o_orderdate < TIMESTAMP '1998-08-01' - INTERVAL 300 DAY""")
def p12_retention(spark: SparkSession, d: str) -> DataFrame:
    """Orders are jobs, those of the first priority without a time that can be read; parts are artifacts by age."""
    now = F.lit("1998-08-01").cast("timestamp")
    artifacts = questions(spark, d).select(F.col("question_id").alias("id"), (now - F.make_dt_interval(F.col("age_days").cast("int"))).alias("modified_at"))
    finished = F.when(F.col("o_orderpriority").startswith("1"), "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), finished.alias("finished_at"))
    return R.retention(artifacts, jobs, 300, now, ["F", "O"])


@query(with_sql(TOPICS, body="SELECT topic, path, (SELECT count(*) FROM topics WHERE path ILIKE '%a%' OR name ILIKE '%1%') AS total FROM topics WHERE path ILIKE '%a%' OR name ILIKE '%1%' ORDER BY path LIMIT 10"))
def p14_list_topics(spark: SparkSession, d: str) -> DataFrame:
    found = topics(spark, d).filter(F.col("path").ilike("%a%") | F.col("name").ilike("%1%"))
    return R.paged(found, [F.col("path")], 0, 10).select("topic", "path", "total")


@query(with_sql(PAPERS, body="SELECT paper_id, day, (SELECT count(*) FROM papers WHERE status = 'P') AS total FROM papers WHERE status = 'P' ORDER BY day DESC, paper_id LIMIT 20 OFFSET 20"))
def p14_list_papers(spark: SparkSession, d: str) -> DataFrame:
    return R.paged(papers(spark, d).filter("status = 'P'"), [F.desc("day"), F.col("paper_id")], 20, 20).select("paper_id", "day", "total")


@query(with_sql(QUESTIONS, TOPICS, body="SELECT q.question_id, CASE WHEN q.topic % 4 = 0 THEN concat(t.path, '/new') WHEN q.topic % 4 = 1 THEN 'alone' ELSE t.path END AS path, CASE WHEN q.topic % 4 < 2 THEN 'candidate' ELSE 'link' END AS action, CASE WHEN q.topic % 4 >= 2 THEN t.topic ELSE -1 END AS topic, CASE WHEN q.topic % 4 = 0 THEN 'new' WHEN q.topic % 4 = 1 THEN 'alone' ELSE t.name END AS name, CASE WHEN q.topic % 4 = 0 THEN t.path WHEN q.topic % 4 >= 2 THEN t.parent END AS parent, CAST(CASE WHEN q.topic % 4 = 0 THEN 3 WHEN q.topic % 4 = 1 THEN 1 ELSE 2 END AS BIGINT) AS level FROM questions q JOIN topics t USING (topic)"))
def j3_resolve_topics(spark: SparkSession, d: str) -> DataFrame:
    q, t = questions(spark, d), topics(spark, d)
    refs = q.join(t, "topic").select("question_id", F.when(F.col("topic") % 4 == 0, F.concat("path", F.lit("/new"))).when(F.col("topic") % 4 == 1, "alone").otherwise(F.col("path")).alias("path"))
    return R.resolve_topics(refs, t, "candidate").na.fill(-1, ["topic"])


CANDS = """cands AS (SELECT CAST(n_nationkey AS BIGINT) AS candidate_id, CASE WHEN n_nationkey < 8 THEN n_name ELSE concat('P', n_nationkey // 2) END AS name, CASE WHEN r_name = 'ASIA' THEN 'NEW/' || r_name WHEN r_name = 'EUROPE' THEN NULL ELSE r_name END AS parent, CASE WHEN r_name = 'AFRICA' AND n_nationkey > 10 THEN 'approved' ELSE 'pending' END AS status,
 CASE WHEN n_nationkey IN (9, 14, 22, 24) THEN 'merge' WHEN n_nationkey % 7 = 5 THEN 'reject' ELSE 'approve' END AS decision, CASE WHEN n_nationkey = 24 THEN 'NOWHERE' ELSE 'AMERICA/NATION_1' END AS target FROM nation JOIN region ON n_regionkey = r_regionkey),
pathed AS (SELECT *, CASE WHEN parent IS NULL THEN name ELSE concat(parent, '/', name) END AS path FROM cands), als AS (SELECT 'MIDDLE EAST/P9' AS alias),
told AS (SELECT *, CASE WHEN status <> 'pending' THEN 'refused' WHEN decision = 'approve' AND (path IN (SELECT path FROM topics) OR path IN (SELECT alias FROM als) OR nth > 1) THEN 'conflict' WHEN decision = 'approve' THEN 'approved' WHEN decision = 'merge' AND target NOT IN (SELECT path FROM topics) THEN 'no target' WHEN decision = 'merge' THEN 'merged' ELSE 'rejected' END AS outcome
 FROM (SELECT *, row_number() OVER (PARTITION BY path, status = 'pending' AND decision = 'approve' AND path NOT IN (SELECT path FROM topics) AND path NOT IN (SELECT alias FROM als) ORDER BY candidate_id) AS nth FROM pathed)),
lnk AS (SELECT CAST(c_nationkey AS BIGINT) AS candidate_id, c_custkey AS question_id FROM customer), brd AS (SELECT c_custkey AS question_id, 'AMERICA/NATION_1' AS topic, 'import' AS source FROM customer WHERE c_acctbal < 3000),
moved AS (SELECT question_id, CASE outcome WHEN 'merged' THEN target ELSE path END AS topic, min(CASE outcome WHEN 'merged' THEN 'merged' ELSE 'candidate' END) AS source FROM lnk JOIN told USING (candidate_id) WHERE outcome IN ('approved', 'merged') GROUP BY ALL)"""


def reviewed(spark: SparkSession, d: str) -> R.Review:
    """Nations as candidates under their regions, some of whose paths exist, are new, or come twice; customers are the questions that link to them."""
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    k, region = F.col("n_nationkey"), F.col("r_name")
    cands = n.select(
        k.cast("long").alias("candidate_id"), F.when(k < 8, F.col("n_name")).otherwise(F.concat(F.lit("P"), F.floor(k / 2).cast("string"))).alias("name"), F.when(region == "ASIA", F.concat(F.lit("NEW/"), region)).when(region == "EUROPE", F.lit(None).cast("string")).otherwise(region).alias("parent"),
        F.when((region == "AFRICA") & (k > 10), "approved").otherwise("pending").alias("status"),
    )
    decisions = n.select(k.cast("long").alias("candidate_id"), F.when(k.isin(9, 14, 22, 24), "merge").when(k % 7 == 5, "reject").otherwise("approve").alias("decision"), F.when(k == 24, "NOWHERE").otherwise("AMERICA/NATION_1").alias("target"))
    c = table(spark, d, "customer")
    links = c.select(F.col("c_nationkey").cast("long").alias("candidate_id"), F.col("c_custkey").alias("question_id"))
    bridge = c.filter("c_acctbal < 3000").select(F.col("c_custkey").alias("question_id"), F.lit("AMERICA/NATION_1").alias("topic"), F.lit("import").alias("source"))
    aliases = spark.range(1).select(F.lit("MIDDLE EAST/P9").alias("alias"))
    return R.review_candidates(cands, decisions, topics(spark, d), aliases, links, bridge)


@query(with_sql(TOPICS, CANDS, body="SELECT 'bridge' AS side, question_id, topic, source FROM brd UNION ALL SELECT 'bridge', m.question_id, m.topic, m.source FROM moved m LEFT JOIN brd b USING (question_id, topic) WHERE b.source IS NULL UNION ALL SELECT 'left', question_id, CAST(candidate_id AS VARCHAR), NULL FROM lnk JOIN told USING (candidate_id) WHERE outcome NOT IN ('approved', 'merged', 'rejected')"))
def j7_transfer_links(spark: SparkSession, d: str) -> DataFrame:
    r = reviewed(spark, d)
    left = r.links.select(F.lit("left").alias("side"), "question_id", F.col("candidate_id").cast("string").alias("topic"), F.lit(None).cast("string").alias("source"))
    return r.bridge.select(F.lit("bridge").alias("side"), "question_id", "topic", "source").unionByName(left)


@query(with_sql(QUESTIONS, body="SELECT question_id, status, target, coalesce(concat(status, '>', target) IN ('draft>pending_review', 'pending_review>approved', 'pending_review>rejected', 'approved>archived', 'archived>approved'), false) AS accepted, CASE WHEN status IS NULL THEN 'not found' WHEN concat(status, '>', target) NOT IN ('draft>pending_review', 'pending_review>approved', 'pending_review>rejected', 'approved>archived', 'archived>approved') THEN concat('cannot move from ', status, ' to ', target) END AS reason FROM (SELECT question_id + 10 AS question_id, CASE question_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'archived' ELSE 'pending_review' END AS target FROM questions) r LEFT JOIN questions USING (question_id)"))
def j9_apply_transitions(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d)
    target = F.when(F.col("question_id") % 3 == 0, "approved").when(F.col("question_id") % 3 == 1, "archived").otherwise("pending_review")
    return R.apply_transitions(q, q.select((F.col("question_id") + 10).alias("question_id"), target.alias("target")), QUESTION_MOVES, "question_id")


@query(with_sql(QUESTIONS, body="SELECT 'tag' AS side, tag AS name, -1 AS question_id FROM questions WHERE topic < 3 AND size < 10 GROUP BY tag UNION ALL SELECT 'tag', question_type, -1 FROM questions WHERE size > 30 GROUP BY ALL UNION ALL SELECT 'bridge', CASE WHEN size > 30 THEN question_type ELSE tag END, question_id FROM questions WHERE size NOT BETWEEN 26 AND 30"))
def u1_find_or_create_tags(spark: SparkSession, d: str) -> DataFrame:
    """Large questions get their type as the only tag, those of sizes 26 to 30 none, the others keep their brand."""
    q, size = questions(spark, d), F.col("size")
    given = q.filter(size > 25).select("question_id", F.when(size > 30, F.col("question_type")).alias("name"))
    old = q.filter("topic < 3 and size < 10").select(F.col("tag").alias("name")).distinct()
    tags, bridge = R.set_tags(given, old, q.select("question_id", F.col("tag").alias("name")))
    return tags.select(F.lit("tag").alias("side"), "name", F.lit(-1).cast("long").alias("question_id")).unionByName(bridge.select(F.lit("bridge").alias("side"), "name", "question_id"))


@query(with_sql(TOPICS, body="SELECT path, name, level, parent FROM (SELECT parent AS path, parent AS name, CAST(1 AS BIGINT) AS level, CAST(NULL AS VARCHAR) AS parent FROM topics GROUP BY parent UNION ALL SELECT path, name, 2, parent FROM topics WHERE topic % 2 = 1 UNION ALL SELECT concat(path, '/x'), 'x', 3, path FROM topics)"))
def u3_missing_ancestors(spark: SparkSession, d: str) -> DataFrame:
    t = topics(spark, d)
    return R.missing_ancestors(t.select(F.concat("path", F.lit("/x")).alias("path")), t.filter("topic % 2 = 0"))


@query(with_sql(TOPICS, CANDS, body="""SELECT 'outcome' AS kind, CAST(candidate_id AS VARCHAR) AS name, path AS path, outcome AS what FROM told UNION ALL SELECT 'topic', string_split(path, '/')[-1], path, CAST(len(string_split(path, '/')) AS VARCHAR) FROM
 (SELECT DISTINCT unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS path FROM told WHERE outcome = 'approved') WHERE path NOT IN (SELECT path FROM topics) UNION ALL SELECT 'alias', name, target, NULL FROM told WHERE outcome = 'merged' GROUP BY ALL"""))
def u4_review_kp_candidates(spark: SparkSession, d: str) -> DataFrame:
    r = reviewed(spark, d)
    row = lambda df, kind, name, path, what: df.select(F.lit(kind).alias("kind"), name.cast("string").alias("name"), F.col(path).alias("path"), what.cast("string").alias("what"))
    outcomes, made = row(r.outcomes, "outcome", F.col("candidate_id"), "path", F.col("outcome")), row(r.topics, "topic", F.col("name"), "path", F.col("level"))
    return outcomes.unionByName(made).unionByName(row(r.aliases, "alias", F.col("alias"), "topic", F.lit(None)))


OVERLAP = """own AS (SELECT question_id AS id, unnest([tag, question_type, status]) AS v FROM questions),
asked AS (SELECT paper_id AS id, status AS v FROM pq JOIN questions USING (question_id) WHERE order_index = 1 UNION ALL SELECT paper_id, tag FROM pq JOIN questions USING (question_id) WHERE order_index > 1 UNION ALL SELECT paper_id, question_type FROM pq JOIN questions USING (question_id) WHERE is_locked),
qs AS (SELECT id, list_sort(list(DISTINCT v)) AS s FROM own WHERE v IS NOT NULL GROUP BY id), ps AS (SELECT id, list_sort(list(DISTINCT v)) AS s FROM asked WHERE v IS NOT NULL GROUP BY id),
qc AS (SELECT min(id) AS c, s FROM qs GROUP BY s), pc AS (SELECT min(id) AS c, s FROM ps GROUP BY s)"""


@query(with_sql(QUESTIONS, PQ, OVERLAP, body="""SELECT 'pair' AS kind, qc.c AS a, pc.c AS b, CAST(len(list_intersect(qc.s, pc.s)) AS BIGINT) AS overlap FROM qc, pc WHERE len(list_intersect(qc.s, pc.s)) > 0
UNION ALL SELECT 'question_id', id, c, len(s) FROM qs JOIN qc USING (s) UNION ALL SELECT 'paper_id', id, c, len(s) FROM ps JOIN pc USING (s)"""))
def u5_topic_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Every question against what every paper asks for (its first question's status, the others' tags, and the types of locked ones), by classes of equal values."""
    q, pq = questions(spark, d), paper_questions(spark, d)
    of_paper = pq.join(q.select("question_id", "tag", "question_type", F.col("status").alias("state")), "question_id")
    asked = F.array_compact(F.array(F.when(F.col("order_index") == 1, F.col("state")), F.when(F.col("order_index") > 1, F.col("tag")), F.when(F.col("is_locked"), F.col("question_type"))))
    own = q.select("question_id", F.explode(F.array("tag", "question_type", "status")).alias("v"))
    return R.topic_overlaps(own, of_paper.select("paper_id", F.explode(asked).alias("v")), "question_id", "paper_id", "v")


@query(with_sql(QUESTIONS, body="SELECT question_id, tag AS value FROM questions WHERE question_id % 3 > 0 UNION ALL SELECT question_id, concat('new ', tag) FROM questions WHERE question_id % 6 = 0"))
def u6_replace_children(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d)
    updates = q.filter("question_id % 3 = 0").select("question_id", F.when(F.col("question_id") % 6 == 0, F.concat(F.lit("new "), F.col("tag"))).alias("value"))
    return R.replace_children(q.select("question_id", F.col("tag").alias("value")), updates, "question_id")


@query(with_sql(QUESTIONS, PQ, body="SELECT 'paper' AS side, question_id, CAST(paper_id AS VARCHAR) AS value FROM pq WHERE question_id NOT IN (SELECT question_id FROM questions WHERE status = 'rejected') UNION ALL SELECT 'tag', question_id, tag FROM questions WHERE status <> 'rejected' UNION ALL SELECT 'topic', question_id, CAST(topic AS VARCHAR) FROM questions WHERE status <> 'rejected'"))
def u6_cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d)
    value = lambda df, c: df.select("question_id", F.col(c).cast("string").alias("value"))
    left = R.cascade_delete(q.filter("status = 'rejected'"), {"paper": value(paper_questions(spark, d), "paper_id"), "tag": value(q, "tag"), "topic": value(q, "topic")}, "question_id")
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("side"), "question_id", "value") for name, df in left.items()])


@query(with_sql(QUESTIONS, body="SELECT 'status' AS what, status AS name, count(*) AS n FROM questions GROUP BY status UNION ALL SELECT 'type', question_type, count(*) FROM questions GROUP BY question_type UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source"))
def a11_corpus_profile(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d)
    count = lambda df, what, c: df.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "name", "n")
    return count(q, "status", "status").unionByName(count(q, "type", "question_type")).unionByName(count(table(spark, d, "documents"), "source", "source"))


@query(with_sql(QUESTIONS, TOPICS, body="""SELECT question_id, stem, CASE WHEN size % 2 = 0 THEN concat('A:', tag, ',B:', status) ELSE '' END AS options, CASE WHEN size % 3 = 0 THEN question_type ELSE '' END AS answers, array_to_string(list_transform(range(1, size % 4 + 1), lambda i: concat(i, ':step ', i)), ',') AS steps, concat(path, ':', 1.0, CASE WHEN size > 25 THEN concat(',', parent, ':', 0.5) ELSE '' END) AS topics,
 CASE WHEN size = 50 THEN '' WHEN tag < status THEN concat(tag, ',', status) ELSE concat(status, ',', tag) END AS tags FROM questions JOIN topics USING (topic)"""))
def a12_nest_question(spark: SparkSession, d: str) -> DataFrame:
    """Options, answers, steps, weighted topics and tags by what a question's size and columns say."""
    q, size = questions(spark, d), F.col("size")
    t = q.join(topics(spark, d), "topic")
    lettered = lambda i, label, c: F.struct(F.lit(i).alias("order_index"), F.lit(label).alias("option_label"), F.col(c).alias("content"))
    options = q.filter(size % 2 == 0).select("question_id", F.inline(F.array(lettered(1, "B", "status"), lettered(0, "A", "tag"))))
    steps = q.filter(size % 4 > 0).select("question_id", F.explode(F.sequence(F.lit(1), (size % 4).cast("int"))).alias("step_order")).withColumn("content", F.concat(F.lit("step "), F.col("step_order").cast("string")))
    links = t.select("question_id", F.lit(True).alias("is_primary"), "path", F.lit(1.0).alias("weight")).unionByName(t.filter(size > 25).select("question_id", F.lit(False).alias("is_primary"), F.col("parent").alias("path"), F.lit(0.5).alias("weight")))
    tags = q.filter(size != 50).select("question_id", F.explode(F.array("tag", "status")).alias("name"))
    full = R.nest_question(q.select("question_id", "stem"), options, q.filter(size % 3 == 0).select("question_id", F.col("question_type").alias("content")), steps, links.select("question_id", (~F.col("is_primary")).alias("later"), "path", "weight", "is_primary"), tags)
    text = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *(x[n].cast("string") for n in names))), ",")
    return full.select("question_id", "stem", text("options", "option_label", "content").alias("options"), text("answers", "content").alias("answers"), text("steps", "step_order", "content").alias("steps"), text("topics", "path", "weight").alias("topics"), F.array_join("tags", ",").alias("tags"))


@query(with_sql(QUESTIONS, TOPICS, body="SELECT topic, path, parent, CAST(2 AS BIGINT) AS level, count(question_id) AS n_questions FROM topics LEFT JOIN questions USING (topic) GROUP BY ALL"))
def a17_topic_tree(spark: SparkSession, d: str) -> DataFrame:
    return R.topic_counts(topics(spark, d), questions(spark, d)).select("topic", "path", "parent", "level", "n_questions")


RECORDS = """r AS (SELECT question_id, CASE WHEN size % 2 = 0 THEN [tag, status] ELSE [] END AS options, [question_type] AS answers, string_split(stem, ' ') AS steps, [path, parent] AS topics, [tag] AS tags, [question_type, name] AS concepts, topic FROM questions JOIN topics USING (topic))"""


@query(with_sql(QUESTIONS, TOPICS, RECORDS, body="""SELECT question_id, 'option' AS kind, CAST(unnest(range(len(options))) AS BIGINT) AS place, unnest(options) AS value, CAST(NULL AS DOUBLE) AS weight FROM r UNION ALL SELECT question_id, 'answer', 0, answers[1], NULL FROM r UNION ALL SELECT question_id, 'step', CAST(unnest(range(len(steps))) AS BIGINT), unnest(steps), NULL FROM r
UNION ALL SELECT question_id, 'topic', CAST(unnest([0, 1]) AS BIGINT), unnest(topics), 1.0 FROM r UNION ALL SELECT question_id, 'tag', 0, tags[1], NULL FROM r UNION ALL SELECT question_id, 'concept', 1, concepts[2], 0.5 FROM r UNION ALL SELECT question_id, 'concept', 0, concepts[1], 0.5 FROM r WHERE topic >= 10"""))
def g7_explode_record(spark: SparkSession, d: str) -> DataFrame:
    """Questions of the first ten topics hold their type as a candidate already."""
    q = questions(spark, d).join(topics(spark, d), "topic")
    records = q.select("question_id", F.when(F.col("size") % 2 == 0, F.array("tag", "status")).otherwise(F.array().cast("array<string>")).alias("options"), F.array("question_type").alias("answers"), F.split("stem", " ").alias("steps"), F.array("path", "parent").alias("topics"), F.array("tag").alias("tags"), F.array("question_type", "name").alias("concepts"))
    return R.explode_record(records, q.filter("topic < 10").select("question_id", F.col("question_type").alias("value")))


@query(with_sql(FLAGS, body="SELECT question_id AS candidate_id, 'needs_review' AS state FROM flags WHERE human_review_needed ORDER BY question_id DESC LIMIT 100"))
def t5_list_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = review_flags(spark, d).select(F.col("question_id").alias("candidate_id"), F.when(F.col("human_review_needed"), "needs_review").otherwise("committed").alias("state"), F.col("question_id").alias("updated_at"))
    return R.list_candidates(c, "needs_review", 100).select("candidate_id", "state")


@query(with_sql(TOPICS, CANDS, body="SELECT candidate_id, path, (SELECT count(*) FROM cands WHERE status = 'pending') AS total FROM pathed WHERE status = 'pending' ORDER BY length(path) DESC, candidate_id LIMIT 5 OFFSET 3"))
def t5_list_topic_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The longest paths are the newest."""
    pending = reviewed(spark, d).outcomes.select("candidate_id", "path", F.when(F.col("outcome") == "refused", "approved").otherwise("pending").alias("status"), F.length("path").alias("created_at"))
    return R.list_topic_candidates(pending, "pending", 3, 5).select("candidate_id", "path", "total")


@query(with_sql(EVENTS, body="SELECT job_id, event_type, event_id FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts_us DESC, event_id DESC) = 1"))
def w5_latest_version(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_version(events(spark, d), "job_id", ["ts_us", "event_id"]).select("job_id", "event_type", "event_id")


@query("""WITH refs AS (SELECT l_orderkey AS question_id, CASE l_linenumber WHEN 1 THEN concat('http://x/', l_partkey, '.png') WHEN 2 THEN concat('/abs/', l_partkey, '.png') WHEN 3 THEN concat('../', l_partkey, '.png') WHEN 4 THEN 'assets/page_1.png' ELSE concat('assets/', l_partkey, '.png') END AS reference, l_linenumber AS n, l_partkey FROM lineitem)
SELECT DISTINCT question_id, reference, CASE n WHEN 1 THEN 'remote' WHEN 2 THEN 'absolute' WHEN 3 THEN 'outside' WHEN 4 THEN 'rendered page' ELSE 'missing' END AS error FROM refs LEFT JOIN part ON l_partkey = p_partkey WHERE n <= 4 OR p_size IS NULL OR p_size <= 25""")
def j6_missing_assets(spark: SparkSession, d: str) -> DataFrame:
    item, k = table(spark, d, "lineitem"), F.col("l_partkey").cast("string")
    n = F.col("l_linenumber")
    reference = F.when(n == 1, F.concat(F.lit("http://x/"), k, F.lit(".png"))).when(n == 2, F.concat(F.lit("/abs/"), k, F.lit(".png"))).when(n == 3, F.concat(F.lit("../"), k, F.lit(".png"))).when(n == 4, "assets/page_1.png").otherwise(F.concat(F.lit("assets/"), k, F.lit(".png")))
    refs = item.select(F.col("l_orderkey").alias("question_id"), reference.alias("reference"))
    there = item.join(table(spark, d, "part").filter("p_size > 25"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(F.col("l_orderkey").alias("question_id"), F.concat(k, F.lit(".png")).alias("filename"))
    return R.missing_assets(refs, there)
