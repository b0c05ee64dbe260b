"""Text files that tasks write."""

from pyspark.sql import functions as F

from itemloom.sources import records
from itemloom.sources.workspace import folder_name, write_text_files


def test_files_are_those_that_spark_writes(spark, tmp_path):
    df = spark.createDataFrame([("a/b", 1, "x"), ("a/b", 2, "ü\ny"), (None, 1, None), ("", 3, ""), ("[%]", 3, "z"), ("[%]", 3, "more")], "k string, n long, value string").coalesce(1)
    write_text_files(df, str(tmp_path / "own"), ["k", "n"])
    df.write.partitionBy("k", "n").text(str(tmp_path / "spark"))
    held = lambda name: sorted((str(f.parent.relative_to(tmp_path / name)), f.read_bytes()) for f in (tmp_path / name).rglob("*.txt"))
    assert held("own") == held("spark") and len(held("own")) == 5


def test_a_file_starts_no_process(spark, tmp_path, monkeypatch):
    """Hadoop's local store starts three for a folder with a file; tasks of these tests' session run where pyarrow writes."""
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "write", property(lambda self: 1 / 0))
    df = spark.range(300).select(F.concat(F.lit("q"), "id").alias("question"), F.lit("a body of text").alias("value"))
    write_text_files(df, f"file://{tmp_path}/bank", ["question"])
    got = records.read_bank_dir(spark, f"{tmp_path}/bank", lambda name: F.lit("question.txt"))
    assert got.count() == 300 and {r.question_body for r in got.collect()} == {"a body of text\n"}
    assert folder_name("question", "q1") == "question=q1"


def test_a_file_done_again_is_whole(spark, tmp_path):
    for value in ("a longer text than that of the second time", "short"):
        write_text_files(spark.createDataFrame([("a", value)], "k string, value string"), str(tmp_path), ["k"])
    assert [f.read_text() for f in tmp_path.rglob("*.txt")] == ["short\n"]


def test_files_of_a_folder_are_listed_at_once(spark, tmp_path):
    """A folder for each file took a job for each folder above them as the paths were listed."""
    df = spark.range(100).select(F.lit("de").alias("lang"), F.col("id").alias("part"), F.lit("t").alias("value"))
    write_text_files(df, str(tmp_path), ["lang", "part"], ".txt")
    assert sum(f.is_dir() for f in tmp_path.rglob("*")) == 1
    assert sorted(r.path.rpartition("/")[2] for r in records.read_text_sources(spark, str(tmp_path)).collect()) == sorted(f"part={i}.txt" for i in range(100))


def test_a_manifest_reads_each_file_in_one_scan(spark, tmp_path):
    for i in range(9):
        (tmp_path / f"{i}.txt").write_bytes(b"x" * max(1, i << 17))
    m = records.source_manifest(spark, str(tmp_path), 1)
    assert sum(r.error == "too large" for r in m.collect()) == 0 and m.count() == 9
    (tmp_path / "10.txt").write_bytes(b"x" * ((1 << 20) + 1))
    m = records.source_manifest(spark, str(tmp_path), 1)
    assert {(r.path.rpartition("/")[2], r.error, r.sha256 is None) for r in m.collect()} >= {("10.txt", "too large", True), ("8.txt", None, False)} and m.count() == 10
    assert m.rdd.getNumPartitions() == spark.read.format("binaryFile").load(str(tmp_path)).filter("length >= 0").rdd.getNumPartitions() + 1


def test_paths_of_every_form_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame([("a", "t")], "k string, value string")
    for form in (f"{tmp_path}/a b%20", f"file:{tmp_path}/c", f"file://{tmp_path}/d"):
        write_text_files(df, form, ["k"])
    assert sorted(str(f.relative_to(tmp_path)) for f in tmp_path.rglob("*.txt")) == ["a b%20/k=a/part.txt", "c/k=a/part.txt", "d/k=a/part.txt"]
    write_text_files(df.limit(0), f"{tmp_path}/none", ["k"])
    assert records.read_text_sources(spark, f"{tmp_path}/none").count() == 0


def test_folders_of_questions_are_listed_and_read_by_tasks(spark, tmp_path):
    """The driver gets no list of files; hidden names, nested and empty folders, bytes that aren't UTF-8 and files beside the folders are as Spark reads them."""
    import os

    made = {
        "q1": {"question.md": b"body", "answer.txt": b"", "metadata.yaml": b"a: 1", "assets/b.png": b"x", "assets/A.svg": b"x", "assets/c.bin": b"x", "assets/.h.png": b"x"},
        "q2": {"content.tex": b"caf\xe9", "question.txt": b"first", "sub/answer.md": b"deep"}, "k=ü 3": {"question.txt": b""}, "q4": {"answer.md": b"no body"}, "q5": {},
        "_tmp": {"question.md": b"no"}, "_k=1": {"question.md": b"yes"}, ".hid": {"question.md": b"no"}, "q6": {"_question.md": b"no", "_d/question.md": b"no", "content.md": b"c"},
    }
    for q, files in made.items():
        (tmp_path / q).mkdir()
        for name, data in files.items():
            (tmp_path / q / name).parent.mkdir(exist_ok=True)
            (tmp_path / q / name).write_bytes(data)
    (tmp_path / "question.md").write_bytes(b"beside")
    df = records.read_bank_dir(spark, str(tmp_path))
    assert df.inputFiles() == []
    got = {r.question_id: (r.question_body, r.question_format, r.answer_body, r.metadata, r.assets) for r in df.select("question_id", F.col("question_body").cast("binary").cast("string").alias("question_body"), "question_format", "answer_body", "metadata", "assets").collect()}
    assert {q: v[0] for q, v in got.items() if q != "q2"} == {"q1": "body", "k=ü 3": "", "_k=1": "yes", "q6": "c"} and got["q2"][0] == "first"
    assert got["q1"][1:] == ("markdown", "", '{"a": 1}', ["A.svg", "b.png"]) and got["q2"][2] == "deep" and got["k=ü 3"][1] == "text"
    assert os.listdir(tmp_path / "q5") == []


def test_a_store_that_pyarrow_lacks_is_read_by_spark(spark, tmp_path, monkeypatch):
    (tmp_path / "q1").mkdir()
    (tmp_path / "q1" / "question.md").write_text("body")
    monkeypatch.setattr(records, "store_of", lambda uri: None)
    df = records.read_bank_dir(spark, str(tmp_path))
    assert [(r.question_id, r.question_body, r.answer_body, r.metadata) for r in df.collect()] == [("q1", "body", "", "{}")] and df.inputFiles() != []
