"""Queries of the text expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.functions import text as X
from itemloom.plans.registry import query
from itemloom.sources.adapters import BANK, MARKED, bank, marked, table, with_sql


def d_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def d_collapse(x: str) -> str:
    return d_strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def d_plain(x: str) -> str:
    x = f"regexp_replace({x}, '!\\[[^\\]]*\\]\\([^)]+\\)', ' ', 'g')"
    x = f"regexp_replace({x}, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g')"
    x = f"regexp_replace({x}, '(?m)^\\s{{0,3}}#{{1,6}}\\s*', '', 'g')"
    x = f"regexp_replace({x}, '(?m)^\\s{{0,3}}>\\s?', '', 'g')"
    return d_collapse(f"replace({x}, '`', '')")


def d_title(body: str, fallback: str) -> str:
    first = f"list_filter(list_transform(list_filter(string_split({body}, chr(10)), lambda l: starts_with({d_strip('l')}, '#')), lambda l: {d_strip(f"regexp_replace({d_strip('l')}, '^#+', '')")}), lambda l: l <> '')[1]"
    return f"coalesce({first}, nullif({d_strip(f'substr({d_plain(body)}, 1, 60)')}, ''), {fallback})"


def d_search(body: str, fallback: str) -> str:
    return f"concat({d_title(body, fallback)}, chr(10), {d_plain(body)}, chr(10), '', chr(10), '{{\"topics\":[\"', lang, '\",\"', source, '\"]}}')"


def metadata(df: DataFrame):
    return F.to_json(F.struct("topics"))


@query(with_sql(MARKED, body=f"SELECT doc_id, {d_plain('body')} AS plain FROM marked"))
def p1_plain_text(spark: SparkSession, d: str) -> DataFrame:
    return marked(spark, d).select("doc_id", X.plain_text(F.col("body")).alias("plain"))


@query(with_sql(MARKED, body=f"SELECT doc_id, {d_title('body', 'CAST(doc_id AS VARCHAR)')} AS title, substr({d_plain('body')}, 1, 220) AS preview FROM marked"))
def p2_title_preview(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("body")
    return marked(spark, d).select("doc_id", X.title(b, F.lit(None).cast("string"), F.col("doc_id").cast("string")).alias("title"), F.substring(X.plain_text(b), 1, 220).alias("preview"))


@query(with_sql(BANK, body=f"SELECT question_id, {d_search('question_body', 'CAST(question_id AS VARCHAR)')} AS search_text FROM bank"))
def p3_search_text(spark: SparkSession, d: str) -> DataFrame:
    b = bank(spark, d)
    t = X.title(F.col("question_body"), F.lit(None).cast("string"), F.col("question_id").cast("string"))
    return b.select("question_id", X.search_text(t, F.col("question_body"), F.col("answer_body"), metadata(b)).alias("search_text"))


@query(with_sql(BANK, body="SELECT question_id, sha256(concat(question_body, chr(10), '---ANSWER---', chr(10), answer_body)) AS content_hash FROM bank"))
def f1_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return bank(spark, d).select("question_id", X.content_hash(F.col("question_body"), F.col("answer_body")).alias("content_hash"))


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN concat('own_', doc_id) ELSE concat('qf_', substr(sha256(concat(md5(text), chr(0), 'f', doc_id % 50, '.json', chr(0),
  CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 40 AS VARCHAR) WHEN doc_id % 3 = 1 THEN concat('item-', doc_id, '|1,', doc_id % 9, '|', lang) ELSE concat('item-', doc_id) END)), 1, 16)) END AS question_id FROM documents""")
def f2_stable_question_id(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    pages = F.when(i % 3 == 1, F.array(F.lit("1"), (i % 9).cast("string")))
    out = X.stable_question_id(
        F.when(i % 11 == 0, F.concat(F.lit("own_"), i.cast("string"))), F.md5("text"), F.concat(F.lit("dir/f"), (i % 50).cast("string"), F.lit(".json")), F.when(i % 3 == 0, (i % 40).cast("string")), pages, F.when(i % 3 == 1, F.col("lang")), i
    )
    return table(spark, d, "documents").select("doc_id", out.alias("question_id"))


@query(with_sql(MARKED, body="""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(body, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1), regexp_extract_all(body, '\\\\includegraphics(?:\\[[^\\]]*\\])?\\{([^}]+)\\}', 1),
  regexp_extract_all(body, '(?i)src\\s*=\\s*["'']([^"'']+)["'']', 1), regexp_extract_all(body, '(?i)\\b([\\w.-]+\\.(?:png|jpg|jpeg|gif|pdf|svg|eps))\\b', 1)), lambda x: string_split(x, '/')[-1]), lambda x: x <> ''))), '|') AS refs FROM marked"""))
def f5_image_refs(spark: SparkSession, d: str) -> DataFrame:
    return marked(spark, d).select("doc_id", F.array_join(F.array_sort(X.image_refs(F.col("body"))), "|").alias("refs"))


@query(with_sql(MARKED, body="""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(body, '(?:^|\\n)\\s*(\\d{1,2})\\s*[.．]', 1), lambda x: CAST(x AS INT)))), ',') AS numbers,
  CAST(regexp_extract(body, '共\\s*(\\d+)\\s*题', 1) AS BIGINT) AS total_problems, CAST(regexp_extract(body, '(?:满分|总分)\\s*(\\d+)\\s*分', 1) AS BIGINT) AS total_score FROM marked"""))
def f6_paper_hints(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("body")
    problems, points = X.paper_hints(b)
    return marked(spark, d).select("doc_id", F.array_join(F.array_sort(X.problem_numbers(b)), ",").alias("numbers"), problems.cast("long").alias("total_problems"), points.cast("long").alias("total_score"))


@query(with_sql(MARKED, body=f"""SELECT doc_id, {d_strip("regexp_replace(body, '(?i)!\\[fig\\]\\((?:[^)]*/)?((?:page|p)[_-]?[0-9]{1,4}\\.(?:png|jpg|jpeg|webp))\\)', '[fig 需人工裁剪为独立题图]', 'g')".replace("{1,4}", "{1,4}"))} AS cleaned, concat('page_00', doc_id % 10, '.png') AS removed FROM marked"""))
def f7_rendered_pages(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("body")
    return marked(spark, d).select("doc_id", X.strip_rendered_refs(b).alias("cleaned"), F.array_join(X.rendered_refs(b), "|").alias("removed"))


@query()
def f9_fix_math(spark: SparkSession, d: str) -> DataFrame:
    return marked(spark, d).select("doc_id", X.fix_math(F.col("body")).alias("fixed"))


@query(with_sql(MARKED, body=f"""SELECT doc_id, CASE WHEN {d_strip('body')} = '' THEN '' WHEN regexp_matches({d_strip('body')}, '\\\\[a-zA-Z]|[a-zA-Z)\\]}}][_^][0-9]|[_^]\\{{') THEN concat('$', {d_strip('body')}, '$') ELSE body END AS wrapped,
  {d_strip('body')} AS unwrapped FROM marked"""))
def f10_math_delimiters(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("body")
    s = X.strip(b)
    return marked(spark, d).select("doc_id", X.wrap_math(b).alias("wrapped"), X.unwrap_math(F.concat(F.lit("$"), s, F.lit("$"))).alias("unwrapped"))


@query("""WITH t AS (SELECT doc_id, lower(text) AS low, regexp_replace(lower(text), '\\s+', '', 'g') AS compact FROM documents)
SELECT doc_id, CAST(len(regexp_extract_all(low, '[a-z]+|[0-9]+(?:\\.[0-9]+)?|[一-鿿]')) + greatest(length(compact) - 1, 0) AS BIGINT) AS n_tokens, md5(concat(array_to_string(list_concat(regexp_extract_all(low, '[a-z]+|[0-9]+(?:\\.[0-9]+)?|[一-鿿]'),
  list_transform(range(1, greatest(length(compact), 1)), lambda i: substr(compact, i, 2))), ' '))) AS digest FROM t""")
def f13_tokenize(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", X.hash_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"""SELECT DISTINCT source, concat('kp_', substr(sha1(replace(lower({d_collapse("concat('  Topic ', source, '  ß ')")}), 'ß', 'ss')), 1, 12)) AS topic_id FROM documents""")
def f14_topic_id(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("  Topic "), F.col("source"), F.lit("  ß "))
    return table(spark, d, "documents").select("source").distinct().select("source", X.topic_id(name).alias("topic_id"))


@query("""SELECT page_id, regexp_replace(regexp_replace(u, '[^A-Za-z0-9_.\\-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS slug,
  CASE page_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'application/octet-stream' WHEN 2 THEN 'image/svg+xml' ELSE 'application/pdf' END AS mime,
  CASE page_id % 4 WHEN 0 THEN concat('fig_', page_id, '.png') WHEN 1 THEN concat('x_', page_id, '.b') WHEN 2 THEN 'asset.svg' ELSE concat('a.b_', page_id, '.pdf') END AS safe_name,
  CASE page_id % 4 WHEN 0 THEN concat('fig ', page_id) WHEN 1 THEN concat('x ', page_id) WHEN 2 THEN '图' ELSE concat('a.b ', page_id) END AS title FROM (SELECT page_id, url AS u FROM pages)""")
def f15_names(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    name = F.get(F.array(F.concat(F.lit("d/fig-"), i, F.lit(".PNG")), F.concat(F.lit("x "), i, F.lit(".b")), F.lit("e/图.svg"), F.concat(F.lit("a.b-"), i, F.lit(".pdf"))), (F.col("page_id") % 4).cast("int"))
    safe = F.when(F.col("page_id") % 4 == 0, F.translate(X.safe_asset_name(name), "-", "_")).when(F.col("page_id") % 4 == 3, F.translate(X.safe_asset_name(name), "-", "_")).otherwise(X.safe_asset_name(name))
    return table(spark, d, "pages").select("page_id", X.slugify(F.col("url")).alias("slug"), X.mime_hint(name).alias("mime"), safe.alias("safe_name"), X.title_from_filename(name).alias("title"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND length(trim(text)) >= 10 THEN 1 ELSE 0 END::BIGINT AS n_items, CASE WHEN turn % 2 = 0 AND length(trim(text)) >= 10 THEN md5(text) END AS body_md5 FROM (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations)""")
def f16_model_json(spark: SparkSession, d: str) -> DataFrame:
    from itemloom.sources.records import parse_model_replies

    c = table(spark, d, "conversations")
    array = F.to_json(F.array(F.struct(F.col("text").alias("question"))))
    reply = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), array, F.lit("\n```\n"))).otherwise(F.translate(F.col("text"), "[]", "  "))
    items = parse_model_replies(c.select("conv_id", "turn", reply.alias("reply")), "reply")
    return items.select("conv_id", "turn", F.size("items").cast("long").alias("n_items"), F.md5(F.get("items", F.lit(0))["question_body"]).alias("body_md5"))
