"""Literal edge rows: Chinese text, odd numbering, thresholds, and what a text query cannot show."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemloom.functions import text as X
from itemloom.operators import ingest, papers, parse, relational, search, topics
from itemloom.sources import records
from itemloom.streaming import jobs


def value(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], list(row)).select(column.alias("v")).first().v


def test_text_columns(spark):
    v = lambda c, t: value(spark, c(F.col("t")), t=t)
    assert v(X.plain_text, "  ## 标题\n> 引用 `x` ![图](a.png)　[链接](b)\n") == "标题 引用 x 链接"
    assert v(X.image_refs, r'![a](x/1.png) \includegraphics[w]{y/2.pdf} <img src="z/3.gif"> bare.svg') == ["1.png", "2.pdf", "3.gif", "bare.svg"]
    assert v(X.rendered_refs, "![p](assets/page_001.png) ![q](assets/page.png) ![r](assets/figure_1.png)") == ["page_001.png"]
    assert v(X.strip_rendered_refs, "![p](assets/page_001.png) ![q](assets/page.png)") == "[p 需人工裁剪为独立题图] ![q](assets/page.png)"
    assert v(X.problem_numbers, "1. a\n 12．（10 分）\n1. b\n123. c") == [1, 12]
    assert v(lambda c: X.paper_hints(c)[1], "总分 150 分") == 150
    assert v(X.hash_tokens, "Ab 3.5牛顿") == ["ab", "3.5", "牛", "顿", "ab", "b3", "3.", ".5", "5牛", "牛顿"]
    assert v(X.hash_tokens, "a") == ["a"] and v(X.hash_tokens, "") == []
    assert v(X.lexical_tokens, "Éa_b 牛顿第二定律 x1") == ["ea", "b", "牛顿第二定律", "x1"]
    assert v(X.topic_key, "  Straße\t A ") == "strasse a"
    assert v(X.fix_math, "x1 + a = 3") == "x_{1} + α = 3" and v(X.fix_math, r"\frac12 frac {1}") == r"\frac{1}{2} \frac {1}"
    assert v(X.wrap_math, r"\theta = 1") == r"$\theta = 1$" and v(X.wrap_math, r"$\theta$") == r"$\theta$" and v(X.wrap_math, "abc") == "abc"
    assert v(X.unwrap_math, "$1. 题干 $m$$") == "1. 题干 $m$" and v(X.unwrap_math, "$x$") == "$x$"
    assert v(X.safe_asset_name, "d/图.PNG") == "asset.png" and v(X.safe_asset_name, "a b.png") == "a_b.png"
    assert v(X.title_from_filename, "x/a_b-c.pdf") == "a b c"
    assert v(X.strict_terms, "find ABCD_12 x") == ["find", "abcd_12"]


def test_stable_ids(spark):
    df = spark.createDataFrame([("h", "f.json", None, None, "T", 0), ("h", "f.json", None, None, "T", 1), ("h", "f.json", "7", None, "T", 2), ("h", "f.json", "7", None, "U", 3)], "h string, f string, n string, p array<string>, t string, i int")
    ids = [r[0] for r in df.select(X.stable_question_id(F.lit(None).cast("string"), F.col("h"), F.col("f"), F.col("n"), F.col("p"), F.col("t"), F.col("i"))).collect()]
    assert len(set(ids)) == 3 and ids[2] == ids[3] and all(x.startswith("qf_") and len(x) == 19 for x in ids)


@pytest.fixture(scope="module")
def chinese(spark):
    docs = spark.createDataFrame([("qf_newton", "牛顿第二定律：合力等于质量与加速度的乘积。", ""), ("qf_ohm", "欧姆定律：电流与电压成正比。", "abcd_12"), ("qf_long", "牛顿", "")], "question_id string, question_body string, answer_body string")
    return search.searchable(docs, F.lit("{}"))


def test_hybrid_search(spark, chinese):
    ask = lambda q: [r for r in search.hybrid_search(spark.createDataFrame([(1, q)], "query_id long, q string"), search.index_tables(chinese), 5).orderBy("rank").collect()]
    assert ask("牛顿第二定律")[0].question_id == "qf_newton"
    assert {r.question_id for r in ask("abcd_12")} == {"qf_ohm"}
    assert ask("abcd_99") == []
    assert [r.question_id for r in search.lexical_topk(spark.createDataFrame([(1, "牛顿")], "query_id long, q string"), search.index_tables(chinese)).collect()] == ["qf_long"]
    assert np.count_nonzero(value(spark, search.hash_embed(F.col("t")), t="")) == 0


def test_vector_floor_and_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.18, (1 - 0.18**2) ** 0.5]), (3, [0.17, 0.98]), (4, [0.0, 0.0]), (5, [1.0]), (6, [2.0, 0.0])], "question_id long, vector array<double>")
    got = search.vector_topk(spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>"), v).orderBy("rank").collect()
    assert [(r.question_id, r.score) for r in got] == [(1, 1.0), (6, 1.0), (2, 0.18)]


def test_segments(spark):
    seg = lambda t: [r.body for r in parse.segment_questions(spark.createDataFrame([(1, t)], "id long, text string")).orderBy("segment").collect()]
    composite = "A ball is thrown up at speed v. (1) height (2) range"
    assert seg(composite) == [composite]
    three = [f"{i}. a question that is long enough {i}" for i in (1, 2, 3)]
    assert seg("\n".join(three)) == three and seg("short\n1. tiny") == ["short\n1. tiny"]
    items = [r.body for r in parse.split_scored_problems(spark.createDataFrame([(1, "head\n1.(40 分) what is the speed of it\n2.（5分）x")], "id long, text string")).collect()]
    assert items == ["1.what is the speed of it"]


def test_clean_ocr(spark):
    v = lambda t: value(spark, parse.clean_ocr(F.col("t")), t=t)
    assert v("1/6\n2022学而思物理复赛营\n一个小球从高处\n自由落下。\n2022学而思物理复赛营\n1.(40 分)\n$ $") == "2022学而思物理复赛营一个小球从高处自由落下。\n1.(40 分)"
    assert v("第一套\n第一套\n扫描全能王\n--\n...\n一二三") == "第一套\n一二三"
    assert v("甲乙丙 eo\nm = 2 kg\n\\frac12 sqrt x") == "甲乙丙 $ε₀$m = 2 kg\\frac{1}{2} \\sqrt x"
    assert v("甲" * 201 + "\n乙丙丁") == "甲" * 201 + "\n乙丙丁" and v("") == ""
    assert v("命题甲。\n（1）乙丙\n3丁戊己") == "命题甲。\n（1）乙丙\n3丁戊己"


def test_body_to_tex(spark):
    v = lambda t, kind, owner="q": value(spark, parse.body_to_tex(F.col("t"), F.col("k"), F.col("o")), t=t, k=kind, o=owner)
    size = parse.IMAGE_SIZE
    assert v("# T & x\n- 50% of $a_1$\n![f](i/a.png)\n\\(y\\)\n$$\na_b\n$$", "markdown") == "\\subsubsection*{T \\& x}\n\\quad $\\bullet$ 50\\% of $a_1$\\\\\n\\begin{center}\\includegraphics[" + size + "]{q/a.png}\\par\\small{f}\\end{center}\n$y$\n$$\na_b\n$$"
    assert v(r"\includegraphics{u/a.png} \includegraphics{http://x/b.png} \includegraphics[w=1]{c.png} \includegraphics{x/page_1.png}", "latex", "q$1") == r"\includegraphics[" + size + r"]{q$1/a.png} \includegraphics{http://x/b.png} \includegraphics[w=1]{q$1/c.png} \textit{[题图需人工裁剪为独立图片资产]}"
    assert v("### a_b\n## c\n![ ](p/page_01.png)\n\\{~^}#\n \\[ \nx_1\n\\]\ny_1", "markdown") == "\\paragraph{a\\_b}\n\\subsubsection*{c}\n\\textit{[ 需人工裁剪为独立题图]}\n\\textbackslash{}\\{\\textasciitilde{}\\textasciicircum{}\\}\\#\n$$\nx_1\n$$\ny\\_1"
    assert v("", "markdown") == ""
    assert v("a\r\nb_\n", "markdown") == "a\nb\\_"


def test_markdown_blocks(spark):
    v = lambda t: [(b["block_type"], b["text"]) for b in value(spark, parse.markdown_blocks(F.col("t")), t=t)]
    assert v("## H\ntext\n$$\nx\n y$$\nmore") == [("heading", "H"), ("paragraph", "text"), ("formula", "$$\nx\n y$$"), ("paragraph", "more")]
    assert v("") == [] and v("a$$\nb\n#### c") == [("paragraph", "a$$\nb\n#### c")]
    assert v("$$x\n# H\n$$a\n$$b\nc$$\n\nd") == [("formula", "$$x"), ("heading", "H"), ("formula", "$$a"), ("formula", "$$b\nc$$"), ("paragraph", "d")]


def test_content_md(spark):
    v = lambda t: parse.parse_content_md(spark.createDataFrame([(1, t)], "i long, text string")).first().item
    item = v("难度：★★\n类型：多选题\n年级: 高一\n## 题干\ns\n## 选项\n- ✅ A. one\nmore\n- B. two\n- ✅ **C**. three\n## 解析\n1. $x$\n2. b\n## 知识点\n力学/运动学, 光学/反射\n## 标签\n易; 基础 题")
    assert item.difficulty == 2 and item.grade == "高一" and item.question_type == "multiple_choice" and [tuple(a) for a in item.answers] == [("choice", "AC")]
    assert [tuple(o) for o in item.options] == [("A", "one\nmore", True, 0), ("B", "two", False, 1), ("C", "three", True, 2)]
    assert [tuple(s) for s in item.solution_steps] == [(1, "1. $x$", "$x$"), (2, "2. b", None)] and [tuple(p) for p in item.knowledge_points] == [("力学/运动学", True, 1.0), ("光学/反射", False, 1.0)] and item.tags == ["易", "基础 题"]
    item = v("类型：综合题\n## 题干\na\n## 答案\n42 m\n## 解析\n$y$ only")
    assert (item.question_type, [tuple(a) for a in item.answers], [tuple(s) for s in item.solution_steps]) == ("composite", [("text", "42 m")], [(1, "$y$ only", None)])
    item = v("类型：判断题\n## 题干\na\n## 答案\n**B** 对")
    assert (item.question_type, [tuple(a) for a in item.answers], item.difficulty) == ("single_choice", [("choice", "B")], 3)
    assert v("free text") is None and v("## 题干\nonly") is None


def test_records(spark, tmp_path):
    batch = [
        {"question_body": "short"}, {"question": " a body of words ", "answer": "x", "metadata": {"knowledge_points": "Dynamics", "source_pages": [1, "x", "3"]}}, {"question_body": "another long body", "concepts": ["A", "B"], "human_review_needed": True},
    ]
    (tmp_path / "b.json").write_text(json.dumps(batch))
    got = {r.question_body: r for r in records.read_records(spark, str(tmp_path)).collect()}
    assert set(got) == {"a body of words", "another long body"}
    assert got["a body of words"].topics == ["Dynamics"] and got["a body of words"].source_pages == [1, 3] and got["another long body"].topics == ["A", "B"] and got["another long body"].human_review_needed


def test_bank_dir(spark, tmp_path):
    for name, files in {"q1": {"question.md": "body", "content.md": "no", "answer.txt": "ans", "metadata.yaml": "title: T\nn: 1", "assets/b.png": "x", "assets/a.svg": "x", "assets/no.exe": "x"}, ".hidden": {"question.md": "b"}, "empty": {"answer.md": "a"}, "q2": {"content.tex": "t", "metadata.yaml": ": ["}}.items():
        for f, content in files.items():
            p = tmp_path / name / f
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(content)
    got = {r.question_id: r for r in records.read_bank_dir(spark, str(tmp_path)).collect()}
    assert set(got) == {"q1", "q2"} and got["q1"].question_body == "body" and got["q1"].assets == ["a.svg", "b.png"] and json.loads(got["q1"].metadata) == {"n": 1, "title": "T"} and got["q2"].question_format == "latex" and got["q2"].metadata == "{}"


def test_topics_rename_and_merge(spark):
    bank = spark.createDataFrame([("a", ["Dynamics"], 2), ("b", ["Newton law", " "], 1)], "question_id string, topics array<string>, updated_min long")
    none = spark.createDataFrame([], "topic_id string, name string, aliases array<string>")
    t, _ = topics.build_topics(bank, none)
    ids = {r.name: r.topic_id for r in t.collect()}
    renamed = topics.rename_topics(t, spark.createDataFrame([(ids["Dynamics"], "Mechanics")], "topic_id string, new_name string"))
    merged = topics.merge_topics(renamed, spark.createDataFrame([(ids["Dynamics"], ids["Newton law"])], "source string, target string"))
    again, bridge = topics.build_topics(bank, merged.select("topic_id", "name", "aliases"))
    rows = again.collect()
    assert [(r.name, sorted(r.aliases), r.n_questions) for r in rows] == [("Newton law", ["Dynamics", "Mechanics"], 2)] and bridge.count() == 2


def test_gate_and_commit(spark):
    df = spark.createDataFrame([(1, False, [], "structured", "json"), (2, True, [], "structured", "json"), (3, False, ["w"], "structured", "json"), (4, False, [], "llm_assisted", "json"), (5, None, None, None, "pdf")], "id long, human_review_needed boolean, warnings array<string>, import_method string, source_type string")
    ok, queued = ingest.review_gate(df)
    assert [r.id for r in ok.collect()] == [1] and queued.count() == 4


def test_record_rules(spark):
    good = {"question_body": "a $x$", "answer_body": "", "metadata": {"title": "t", "knowledge_points": ["k"], "question_type": None, "tags": [], "source_pages": [1, 2], "human_review_needed": False}}
    errors = lambda r: value(spark, ingest.record_errors(F.col("t")), t=r if isinstance(r, str) else json.dumps(r))
    but = lambda **m: errors(good | {"metadata": good["metadata"] | m})
    assert errors(good) == [] and errors("[1]") == errors("no json") == ["must be an object"]
    assert errors({"question_body": " ", "answer_body": 1, "metadata": []}) == ["question_body must be a non-empty string", "answer_body must be a string", "metadata must be an object"]
    assert but(title=5) == but(title=None) == ["title must be a non-empty string"] and but(knowledge_points="k") == but(knowledge_points=["k", 1]) == ["knowledge_points must be a list of strings"] and but(knowledge_points=[]) == []
    assert but(question_type=" ") == ["question_type must be a non-empty string"] and but(tags="x") == ["tags must be a list of strings"] and but(source_pages=[0]) == but(source_pages=["1"]) == ["source_pages must be a list of positive integers"]
    assert but(human_review_needed="yes") == ["human_review_needed must be a boolean"]
    assert errors(good | {"question_body": "\\frac{1}{2}"}) == ["LaTeX without delimiters"] and errors(good | {"question_body": "\\sqrt 2"}) == [] and errors(good | {"answer_body": "![p](a/page_1.png)"}) == ["reference to a rendered page"]


def test_last_candidate_moves_a_job(spark):
    jobs_ = spark.createDataFrame([(1, 0, 2, 0, "needs_review"), (2, 0, 1, 0, "needs_review"), (3, 1, 1, 1, "needs_review"), (4, 0, 2, 0, "needs_review"), (5, 1, 0, 0, "succeeded")], "job_id long, imported long, review long, errors long, status string")
    done = spark.createDataFrame([(1, "a", "q1", False), (1, "b", "q2", None), (1, "b", "q2", False), (2, "c", None, True), (3, "d", "q3", False), (4, "e", "q4", False)], "job_id long, candidate_id string, question_id string, rejected boolean")
    got = {r.job_id: (r.imported, r.review, r.status) for r in ingest.resolve_jobs(jobs_, done).collect()}
    assert got == {1: (2, 0, "succeeded"), 2: (0, 0, "failed"), 3: (2, 0, "partial"), 4: (1, 1, "needs_review"), 5: (1, 0, "succeeded")}


def test_upsert_is_idempotent(spark):
    new = spark.createDataFrame([("a", "h1"), ("b", "h2")], "question_id string, fingerprint string")
    assert {r.action for r in ingest.upsert_bank(new.limit(0), new).collect()} == {"insert"}
    assert {r.action for r in ingest.upsert_bank(new, new).collect()} == {"skip"}
    changed = new.withColumn("fingerprint", F.lit("x"))
    assert {r.action for r in ingest.upsert_bank(new, changed).collect()} == {"conflict"} and {r.action for r in ingest.upsert_bank(new, changed, overwrite=True).collect()} == {"replace"}


def bigram_ratio(a, b):
    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)} if len(s) >= 2 else {s}
    return len(grams(a) & grams(b)) / len(grams(b))


def test_near_duplicates(spark):
    rng = np.random.default_rng(0)
    stems = ["".join(rng.choice(list("abcd"), rng.integers(1, 12))) for _ in range(120)] + ["x", "hello world", "hello world again and more"]
    stems = list(dict.fromkeys(stems))
    got = {(r.a, r.b) for r in ingest.near_duplicates(spark.createDataFrame(list(enumerate(stems)), "question_id long, stem string")).collect()}
    assert got == {(i, j) for i, a in enumerate(stems) for j, b in enumerate(stems) if i != j and bigram_ratio(a, b) > 0.86}
    assert (stems.index("hello world again and more"), stems.index("hello world")) in got and (stems.index("hello world"), stems.index("hello world again and more")) not in got


@pytest.mark.parametrize("constrained", [True, False])
def test_fill_sections_is_greedy(spark, constrained):
    """With constraints low scores are skipped; without them a profile of zeros still fills; empty stems are like no others."""
    rng = np.random.default_rng(5)
    kinds = ["A", "B"]
    score = lambda: round(float(rng.integers(0, 20)) / 20, 2) if constrained else 0.0
    cands = [(p, k, 1000 * p + 100 * i + j, score(), "" if j % 5 == 0 else "".join(rng.choice(list("ab"), 6)), constrained) for p in range(2) for i, k in enumerate(kinds) for j in range(25)]
    sections = [(paper, s, kinds[s % 2], 4, paper % 2) for paper in range(8) for s in range(3)]
    assigned = [(paper, 1000 * (paper % 2) + 100 * i + int(j)) for paper in range(8) for i in range(2) for j in rng.integers(0, 25, 5)]
    got = papers.fill_sections(
        spark.createDataFrame(sections, "paper_id long, section_index long, question_type string, need long, profile long"), spark.createDataFrame(cands, "profile long, question_type string, question_id long, score double, stem string, constrained boolean"),
        spark.createDataFrame(assigned, "paper_id long, question_id long"), first_k=2,
    )
    out = {(r.paper_id, r.section_index, r.question_id) for r in got.collect()}
    want = set()
    for paper in range(8):
        used = {q for p, q in assigned if p == paper}
        for _, s, kind, need, profile in [x for x in sections if x[0] == paper]:
            picked = []
            for _, _, q, score_, stem, _ in sorted((c for c in cands if c[0] == profile and c[1] == kind), key=lambda c: (-c[3], c[2])):
                near = any(stem and other and bigram_ratio(stem, other) > 0.86 for _, other in picked)
                if len(picked) < need and (score_ >= 0.01 or not constrained) and q not in used and not near:
                    picked.append((q, stem))
                    used.add(q)
            want |= {(paper, s, q) for q, _ in picked}
    assert out == want and out


def test_job_status(spark):
    df = spark.createDataFrame([(1, "imported"), (2, "imported"), (2, "error"), (3, "review"), (4, "error")], "job_id long, outcome string")
    assert {r.job_id: r.status for r in ingest.job_rollup(df).collect()} == {1: "succeeded", 2: "partial", 3: "needs_review", 4: "failed"}


def test_stream_ingest_of_odd_files(spark, tmp_path):
    """Arrays and lines, records without ids, hidden, empty and other files; a second run from nothing adds nothing."""
    (tmp_path / "in").mkdir()
    write = lambda name, text: (tmp_path / "in" / name).write_text(text)
    write("a.json", json.dumps([{"question_body": "the first long body", "metadata": {"title": "T"}}, {"question_body": "the second long body"}]))
    write("b.json", json.dumps({"question_id": "own", "question_body": "the third long body"}) + "\nno json\n")
    write("c.txt", json.dumps([{"question_body": "another kind of file"}]))
    write(".hidden.json", json.dumps([{"question_body": "a hidden file's body"}]))
    write("empty.json", " ")
    for c in ("c1", "c2"):
        jobs.stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / "bank"), str(tmp_path / c))
    got = {r.question_body: r.question_id for r in spark.read.parquet(str(tmp_path / "bank")).collect()}
    assert set(got) == {f"the {n} long body" for n in ("first", "second", "third")} and got["the third long body"] == "own" and len(set(got.values())) == 3
    assert all(v == "own" or v.startswith("qf_") for v in got.values())


def test_stream_ingest_adds_nothing_twice(spark, tmp_path):
    (tmp_path / "in").mkdir()
    record = lambda i: json.dumps({"question_id": f"q{i}", "question_body": f"a long enough body {i}"})
    (tmp_path / "in/a.json").write_text(record(1) + "\n" + record(1))
    run = lambda c: jobs.stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / "bank"), str(tmp_path / c))
    run("c")
    (tmp_path / "in/b.json").write_text(record(1) + "\n" + record(2))
    run("c")
    run("new checkpoint")
    assert sorted(r.question_id for r in spark.read.parquet(str(tmp_path / "bank")).collect()) == ["q1", "q2"]


def test_fill_sections_asks_once(spark, monkeypatch):
    """Candidates meet each different list of sections once, not each paper."""
    seen, kept = {}, papers.kept

    def noted(df, name):
        seen[name] = kept(df, name)
        return seen[name]

    monkeypatch.setattr(papers, "kept", noted)
    sections = spark.createDataFrame([(p, s, "AB"[s % 2], 1, p % 2) for p in range(9) for s in range(3)], "paper_id long, section_index long, question_type string, need long, profile long")
    cands = spark.createDataFrame([(p, k, 10 * p + i + (5 if k == "B" else 0), 0.5, f"{p}{k}{i * 1111}", True) for p in range(2) for k in "AB" for i in range(4)], "profile long, question_type string, question_id long, score double, stem string, constrained boolean")
    out = papers.fill_sections(sections, cands, spark.createDataFrame([], "paper_id long, question_id long"))
    assert out.count() == 27 and seen["asked-candidates"].count() == 2


def test_plain_names_are_not_escaped(spark):
    """Names and titles come out as tex_escape makes them, whether they hold something to escape or not."""
    from itemloom.operators.parse import tex_escape

    texts = [None, "", "Plain 第 1", "a_b & c", "x^2~y", "$a_b$ #", "\\(x_1\\) {", "cut\x01mark", "\x03"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(papers._escaped(F.col("t")), tex_escape(F.col("t"))).collect()]
    assert all(a == b for a, b in got) and got[3][0] == r"a\_b \& c"


def test_exports_by_tasks_of_bounded_rows(spark, monkeypatch):
    """Tasks grow in number with the exports, not in rows; the places stay as they were."""
    explicit = spark.createDataFrame([(e, 10 + e, 1) for e in range(200)] + [(3, 5, 2)], "export_id long, question_id long, position long")
    hits = spark.createDataFrame([(e, q, q) for e in range(200) for q in range(3)], "export_id long, question_id long, rank long")
    place = lambda: sorted(map(tuple, papers.resolve_export(explicit, hits, 3).collect()))
    few = place()
    monkeypatch.setattr(papers, "ROWS", 50)
    assert place() == few and [r[1:] for r in few if r[0] == 3] == [(0, 3), (5, 2), (13, 1)]
    plan = papers.resolve_export(explicit, hits, 3)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(export_id" in plan and plan.count("Exchange") == 1 and ", 17), REPARTITION_BY_NUM" in plan
