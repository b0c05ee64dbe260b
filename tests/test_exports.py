"""How exports of papers are stored."""

from itemloom.plans import paper_queries


def test_exports_are_written_compressed(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(paper_queries, "new_path", lambda spark, name: f"{tmp_path}/{name}")
    got = paper_queries.s8_write_exports(spark, sf).first()
    files = [f for f in tmp_path.rglob("part-*") if not f.name.startswith(".")]
    assert files and all(f.name.endswith(".gz") for f in files)
    assert sum(f.stat().st_size for f in files) < (got.question_chars + got.answer_chars) // 4


def test_texts_of_papers_are_dealt_once(spark):
    """One shuffle has the texts of items, whatever sections there are; papers without sections or questions, other questions and unknown sections as before."""
    from itemloom.operators import papers as P

    s = spark.createDataFrame([(1, 1, "A_b", 5.0), (1, 2, "B", 5.0), (2, 1, "A_b", None)], "paper_id long, section_index long, name string, score_each double")
    q = spark.createDataFrame([(i, "stem %d" % i if i != 3 else " ", ["x", "y"] if i == 1 else [], ["an"] if i < 3 else [], ["st"] if i == 2 else []) for i in range(1, 6)], "question_id long, stem string, options array<string>, answers array<string>, steps array<string>")
    pq = spark.createDataFrame([(1, 2, 1, 2, 0.0), (1, 1, 1, 1, 2.0), (1, 3, None, 3, None), (1, 2, None, None, 1.5), (1, 4, 9, 4, 1.0), (3, 5, None, 1, None)], "paper_id long, question_id long, section_index long, order_index long, score double")
    titled = spark.createDataFrame([(i, f"T{i}") for i in range(1, 5)], "paper_id long, title string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = P.assemble_papers(titled, s, pq, q)
        got = {r.paper_id: (r.questions_tex, r.answers_tex) for r in df.collect()}
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Aggregate [paper_id") == 2 and "listagg" not in plan  # lines and sections, each once
    enum = lambda *items: "\\begin{enumerate}[resume]\n" + "\n\n".join(items) + "\n\\end{enumerate}"
    options = "\\begin{enumerate}[label=\\Alph*.]\n\\item x\n\\item y\n\\end{enumerate}"
    none = "\\textit{（本部分暂无题目）}"
    part = lambda name, text: f"\\section*{{{name}}}\n{text}"
    solved = "\\textbf{解析:}\n\\begin{enumerate}[label=\\arabic*.]\n\\item st\n\\end{enumerate}"
    assert got[1][0] == "\n\n".join(["\\title{T1}", part("A\\_b", enum(f"\\item (2.0分) stem 1\n{options}", "\\item (5.0分) stem 2")), part("B", none), part("其他题目", enum("\\item (1.5分) stem 2", "\\item (0.0分) \\textit{（题目正文缺失）}"))])
    assert got[1][1] == "\n\n".join(["\\title{T1 — 参考答案}", part("A\\_b", enum("\\item\n\\textbf{答案:}\nan", f"\\item\n\\textbf{{答案:}}\nan\n{solved}")), part("B", none), part("其他题目 — 答案", enum("\\item\n\\textbf{答案:}\nan", "\\item\n\\textbf{未提供答案}"))])
    assert got[2][0] == "\\title{T2}\n\n" + part("A\\_b", none) and got[3][0] == "\\title{T3}\n\n" + part("其他题目", enum("\\item (0.0分) stem 5")) and got[4] == ("\\title{T4}", "\\title{T4 — 参考答案}")
