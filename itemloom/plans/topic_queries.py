"""Queries of topic governance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.functions import text as X
from itemloom.operators import topics as T
from itemloom.plans.registry import query
from itemloom.sources.adapters import BANK, bank, table, with_sql


def existing(spark: SparkSession, d: str) -> DataFrame:
    """Two topics there already: one with an alias that the bank uses, one without questions."""
    rows = table(spark, d, "region").limit(1).select(F.explode(F.array(
        F.struct(F.lit("kp_english").alias("topic_id"), F.lit("English").alias("name"), F.array(F.lit("en"), F.lit("EN-x")).alias("aliases")), F.struct(F.lit("kp_unused").alias("topic_id"), F.lit("Unused").alias("name"), F.array(F.lit("old")).alias("aliases")),
        F.struct(F.lit("kp_gone").alias("topic_id"), F.lit("Gone").alias("name"), F.array().cast("array<string>").alias("aliases")),
    )).alias("x"))
    return rows.select("x.*")


ID = "concat('kp_', substr(sha1(lower(name)), 1, 12))"
USED = f"used AS (SELECT DISTINCT question_id, CASE WHEN name = 'en' THEN 'kp_english' ELSE {ID} END AS topic_id, CASE WHEN name = 'en' THEN 'English' ELSE name END AS name FROM (SELECT question_id, unnest(topics) AS name FROM bank))"
COUNTED = "counted AS (SELECT topic_id, min(name) AS name, CASE WHEN topic_id = 'kp_english' THEN 'en|EN-x' ELSE '' END AS aliases, count(*) AS n_questions FROM used GROUP BY topic_id UNION ALL SELECT 'kp_unused', 'Unused', 'old', 0)"


def shown(t: DataFrame) -> DataFrame:
    return t.select("topic_id", "name", F.array_join("aliases", "|").alias("aliases"), "n_questions")


@query(with_sql(BANK, body=f"SELECT DISTINCT name, CASE WHEN name = 'en' THEN 'kp_english' ELSE {ID} END AS topic_id FROM (SELECT unnest(topics) AS name FROM bank)"))
def j4_alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    return T.alias_resolve(bank(spark, d).select(F.explode("topics").alias("name")).distinct(), existing(spark, d)).select("name", "topic_id")


@query(with_sql(BANK, USED, COUNTED, body="SELECT * FROM counted"))
def a2_build_topics(spark: SparkSession, d: str) -> DataFrame:
    return shown(T.build_topics(bank(spark, d), existing(spark, d))[0])


@query(with_sql(BANK, USED, COUNTED, body="SELECT topic_id, CASE WHEN name = 'fr' THEN 'French' ELSE name END AS name, CASE WHEN name = 'fr' THEN 'fr' ELSE aliases END AS aliases, n_questions FROM counted"))
def a4_rename_topics(spark: SparkSession, d: str) -> DataFrame:
    topics = T.build_topics(bank(spark, d), existing(spark, d))[0]
    return shown(T.rename_topics(topics, topics.filter("name = 'fr'").select("topic_id", F.lit(" French ").alias("new_name"))))


@query(with_sql(BANK, USED, COUNTED, body=f"SELECT topic_id, name, CASE WHEN topic_id = 'kp_english' THEN 'EN-x|en|fr' ELSE aliases END AS aliases, CASE WHEN topic_id = 'kp_english' THEN (SELECT count(DISTINCT question_id) FROM used WHERE name IN ('English', 'fr')) ELSE n_questions END AS n_questions FROM counted WHERE name <> 'fr'"))
def a3_merge_topics(spark: SparkSession, d: str) -> DataFrame:
    """Merges fr into English and rebuilds the counts through the aliases."""
    b = bank(spark, d)
    topics = T.build_topics(b, existing(spark, d))[0]
    merged = T.merge_topics(topics, topics.filter("name = 'fr'").select(F.col("topic_id").alias("source"), F.lit("kp_english").alias("target")))
    return shown(T.build_topics(b, merged.select("topic_id", "name", "aliases"))[0])


CHAIN = """p AS (SELECT p_partkey AS id, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS name, p_type AS alias, CASE WHEN p_partkey > 1 AND p_partkey % 3 <> 0 THEN p_partkey // 2 END AS target FROM part),
 up AS (SELECT id, id AS root, target FROM p UNION ALL SELECT up.id, p.id, p.target FROM up JOIN p ON p.id = up.target),
 rooted AS (SELECT up.id, root, name, alias FROM up JOIN p ON p.id = up.id WHERE up.target IS NULL),
 gained AS (SELECT r.root, a FROM rooted r, unnest([name, alias]) AS x(a) WHERE r.id <> r.root UNION SELECT id, alias FROM rooted WHERE id = root)"""


@query(f"WITH RECURSIVE {CHAIN} SELECT p.id AS topic_id, p.name, array_to_string(list_sort(list(DISTINCT a)), '|') AS aliases FROM gained g JOIN p ON p.id = g.root WHERE a <> p.name GROUP BY p.id, p.name")
def a3_merge_chains(spark: SparkSession, d: str) -> DataFrame:
    """Parts as topics, two thirds of which are merged into the one of half their key, which may be merged on."""
    part = table(spark, d, "part")
    topics = part.select(F.col("p_partkey").alias("topic_id"), X.collapse(F.col("p_name")).alias("name"), F.array("p_type").alias("aliases"))
    pairs = part.filter("p_partkey > 1 and p_partkey % 3 <> 0").select(F.col("p_partkey").alias("source"), F.expr("p_partkey div 2").alias("target"))
    return T.merge_topics(topics, pairs).select("topic_id", "name", F.array_join("aliases", "|").alias("aliases"))


TREE = """n AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 4 THEN p_partkey // 4 END AS parent, p_name AS path FROM part),
 t AS (SELECT id, parent, path, CAST(1 AS BIGINT) AS level FROM n WHERE parent IS NULL UNION ALL SELECT n.id, n.parent, n.path, level + 1 FROM n JOIN t ON n.parent = t.id),
 c AS (SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY l_partkey), up AS (SELECT id, id AS a, parent FROM t UNION ALL SELECT up.id, t.id, t.parent FROM up JOIN t ON t.id = up.parent)"""


@query(f"WITH RECURSIVE {TREE} SELECT t.id AS topic_id, coalesce(parent, 0) AS parent_id, level, row_number() OVER (PARTITION BY parent ORDER BY path, t.id) AS place, (SELECT count(*) FROM t x WHERE x.parent = t.id) AS n_children, coalesce(c.n, 0) AS n_questions, CAST(coalesce(b.n, 0) AS BIGINT) AS n_below FROM t LEFT JOIN c ON c.id = t.id LEFT JOIN (SELECT a, sum(c.n) AS n FROM up JOIN c ON c.id = up.id GROUP BY a) b ON b.a = t.id")
def a17_parent_tree(spark: SparkSession, d: str) -> DataFrame:
    """Parts as topics below the one of a quarter of their key (0: none), with their line items as questions."""
    part, items = table(spark, d, "part"), table(spark, d, "lineitem")
    nodes = part.select(F.col("p_partkey").alias("topic_id"), F.expr("case when p_partkey > 4 then p_partkey div 4 end").alias("parent_id"), F.col("p_name").alias("path"))
    tree = T.topic_tree(nodes, items.groupBy(F.col("l_partkey").alias("topic_id")).agg(F.count("*").alias("n")))
    return tree.na.fill(0, ["parent_id"])


@query("SELECT conv_id, turn, next_number FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_number FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn % 3 <> 1)) WHERE next_number > turn + 1")
def w6_gaps_in_numbers(spark: SparkSession, d: str) -> DataFrame:
    return T.gaps(table(spark, d, "conversations").filter("turn % 3 <> 1").select("conv_id", "turn").distinct(), "conv_id", "turn")


