"""The driver's tables as item-bank tables: pure projections, and the same ones in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables whose rows hold texts.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that is read in fewer parts than there are cores are dealt over these; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as questions; updated_min orders them by time of change."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("question_id"), F.col("text").alias("question_body"), F.lit("").alias("answer_body"), "lang", "source", F.array("lang", "source").alias("topics"), F.col("doc_id").alias("updated_min"))


BANK = "bank AS (SELECT doc_id AS question_id, text AS question_body, '' AS answer_body, lang, source, [lang, source] AS topics, doc_id AS updated_min FROM documents)"


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with Markdown, TeX and formulas put in."""
    d = table(spark, sf_dir, "documents")
    body = F.concat(
        F.lit("\n## "), F.substring("text", 1, 30), F.lit("\n> quoted `code`\n1. first ![fig](assets/page_00"), (F.col("doc_id") % 10).cast("string"), F.lit(".png) \\includegraphics[width=2cm]{a/b/fig"), (F.col("doc_id") % 7).cast("string"),
        F.lit('.jpg}\n<img src="u/v.gif"> [link](http://x/y)\n 2．（10 分）共 12 题 满分 100 分\n'), F.regexp_replace("text", ", ", " [t](u) x1 = 3, frac12 \\\\frac34 frac {a} "),
    )
    return d.select("doc_id", "lang", "source", body.alias("body"))


MARKED = """marked AS (SELECT doc_id, lang, source, concat(chr(10), '## ', substr(text, 1, 30), chr(10), '> quoted `code`', chr(10), '1. first ![fig](assets/page_00', doc_id % 10, '.png) \\includegraphics[width=2cm]{a/b/fig', doc_id % 7,
  '.jpg}', chr(10), '<img src="u/v.gif"> [link](http://x/y)', chr(10), ' 2．（10 分）共 12 题 满分 100 分', chr(10), replace(text, ', ', ' [t](u) x1 = 3, frac12 \\frac34 frac {a} ')) AS body FROM documents)"""


def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("human_review_needed"))


FLAGS = "flags AS (SELECT doc_id AS question_id, quality = 0 OR toxic = 1 AS human_review_needed FROM labels)"

# fixed values of the adapter
STATUSES = ("draft", "pending_review", "approved", "approved", "approved", "approved", "approved", "rejected", "archived", "approved")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as relational questions, with a topic path of region and nation."""
    p = table(spark, sf_dir, "part")
    status = F.get(F.array(*map(F.lit, STATUSES)), (F.col("p_partkey") % 10).cast("int"))
    return p.select(
        F.col("p_partkey").alias("question_id"), F.col("p_name").alias("stem"), F.col("p_brand").alias("tag"), F.col("p_type").alias("question_type"), (F.col("p_size") % 5 + 1).cast("long").alias("difficulty"), status.alias("status"),
        F.col("p_retailprice").alias("score"), (F.col("p_partkey") % 25).alias("topic"), F.col("p_size").cast("long").alias("size"), (F.col("p_partkey") * 7 % 400).alias("age_days"),
    )


QUESTIONS = f"""questions AS (SELECT p_partkey AS question_id, p_name AS stem, p_brand AS tag, p_type AS question_type, CAST(p_size % 5 + 1 AS BIGINT) AS difficulty,
  [{", ".join(f"'{s}'" for s in STATUSES)}][p_partkey % 10 + 1] AS status, p_retailprice AS score, p_partkey % 25 AS topic, CAST(p_size AS BIGINT) AS size, p_partkey * 7 % 400 AS age_days FROM part)"""


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("long").alias("topic"), F.concat_ws("/", "r_name", "n_name").alias("path"), F.col("r_name").alias("parent"), F.col("n_name").alias("name"))


TOPICS = "topics AS (SELECT CAST(n_nationkey AS BIGINT) AS topic, concat(r_name, '/', n_name) AS path, r_name AS parent, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey)"


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderstatus").alias("status"), F.date_diff("o_orderdate", F.lit("1992-01-01")).cast("long").alias("day"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("owner"))


PAPERS = "papers AS (SELECT o_orderkey AS paper_id, o_orderstatus AS status, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day, o_totalprice AS price, o_custkey AS owner FROM orders)"


def paper_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several lines of an order may name one part and number; all columns break ties."""
    item = table(spark, sf_dir, "lineitem")
    return item.select(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("question_id"), F.col("l_linenumber").cast("long").alias("order_index"), F.col("l_quantity").alias("score"), (F.col("l_linestatus") == "F").alias("is_locked"), F.col("l_extendedprice").alias("price"))


PQ = "pq AS (SELECT l_orderkey AS paper_id, l_partkey AS question_id, CAST(l_linenumber AS BIGINT) AS order_index, l_quantity AS score, l_linestatus = 'F' AS is_locked, l_extendedprice AS price FROM lineitem)"


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each paper's sections: two questions of each type, five points each, in order of type."""
    kinds = table(spark, sf_dir, "part").agg(F.array_sort(F.collect_set("p_type")).alias("kinds"))  # one row: the types that there are
    each = papers(spark, sf_dir).select("paper_id").crossJoin(kinds).select("paper_id", F.posexplode("kinds").alias("at", "question_type"))
    return each.select("paper_id", "question_type", (F.col("at") + 1).cast("long").alias("section_index"), F.lit(2).cast("long").alias("need"), F.lit(5.0).alias("score_each"))


SECTIONS = "sections AS (SELECT paper_id, question_type, section_index, CAST(2 AS BIGINT) AS need, 5.0::DOUBLE AS score_each FROM papers, (SELECT question_type, rank() OVER (ORDER BY question_type) AS section_index FROM (SELECT DISTINCT p_type AS question_type FROM part)))"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("job_id"), "event_type", "value", F.expr("unix_micros(cast(ts as timestamp))").alias("ts_us"))


EVENTS = "job_events AS (SELECT event_id, user_id AS job_id, event_type, value, epoch_us(ts) AS ts_us FROM events)"


def with_sql(*parts: str, body: str) -> str:
    return f"WITH {', '.join(parts)} {body}"
