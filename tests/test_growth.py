"""What must not grow faster than the input: steps that ran once for each row of something larger."""

import re

import pandas as pd
from pyspark.sql import functions as F

from itemloom.operators import ingest, parse
from itemloom.streaming import jobs


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_record_is_parsed_once_for_all_rules(spark):
    df = spark.createDataFrame([('{"question_body": "b", "answer_body": 1, "metadata": {"title": ""}}',), ("[]",), ("{",), (None,)], "raw string")
    got = df.select(ingest.record_errors(F.col("raw")).alias("e"))
    assert plan(got).count("parse_json(") + plan(got).count("parseJson") == 1
    assert [r.e for r in got.collect()] == [["answer_body must be a string", "title must be a non-empty string", "knowledge_points must be a list of strings"], *[["must be an object"]] * 3]


def test_a_file_of_records_is_hashed_once(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"question_body": "the first body"}, {"question_body": "the second body"}]')
    (tmp_path / "b.json").write_text('{"question_body": "the third body"}\n\n{"question_body": "the fourth body"}\n')
    files = spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    df = jobs.parse_files(files)
    made = re.search(r"(?s)^(.*?)Generate posexplode(.*)$", plan(df))
    assert "value#" not in made[1] and "sha2(cast(value#" in made[2]
    assert sorted((r.at, r.question_body) for r in df.collect()) == [(0, "the first body"), (0, "the third body"), (1, "the fourth body"), (1, "the second body")]


def test_patterns_of_segments_are_applied_once(spark):
    df = parse.segment_questions(spark.createDataFrame([(1, "1. the first of the questions\n2. the second of the questions"), (2, ""), (3, None)], "doc_id long, text string"))
    assert plan(df).count("regexp_extract_all(") == 1
    assert sorted((r.doc_id, r.segment, r.body) for r in df.collect() if r.doc_id < 3) == [(1, 0, "1. the first of the questions"), (1, 1, "2. the second of the questions"), (2, 0, "")]
    assert [(r.segment, r.body) for r in df.collect() if r.doc_id == 3] == [(0, None)]


def test_blocks_are_made_of_few_texts_at_once(monkeypatch):
    sizes, whole = [], parse._blocks
    monkeypatch.setattr(parse, "_blocks", lambda texts: sizes.append(len(texts)) or whole(texts))
    monkeypatch.setattr(parse.F, "pandas_udf", lambda f, _: lambda texts: f(texts))
    texts = pd.Series([f"# t{i}\nbody\n$$\nx{i}" if i % 3 else None for i in range(1000)])
    assert list(parse.markdown_blocks(texts)) == list(whole(texts)) and max(sizes) <= 256
    assert len(parse.markdown_blocks(texts[:0])) == 0
