"""Assembly of many papers at once: candidates, scores, slots, order, validation, review and export."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.functions import text as X
from itemloom.operators.parse import IMAGE_SIZE, tex_escape
from itemloom.operators.relational import nest
from itemloom.sources.workspace import kept


def candidate_score(matches: Column, difficulty: Column, target: Column, has_tag: Column) -> Column:
    """0.3 for each matching topic up to 0.6, up to 0.3 for difficulty near the target (rounded half to even), 0.1 for any tag; 1 at most."""
    near = 1 - F.abs(difficulty - F.bround(target)) / 4
    return F.least(F.least(matches * 0.3, F.lit(0.6)) + F.when(near > 0, near * 0.3).otherwise(0.0) + F.when(has_tag, 0.1).otherwise(0.0), F.lit(1.0))


def candidates_for_sections(sections: DataFrame, questions: DataFrame) -> DataFrame:
    """Approved questions of a section's type, in its difficulty range and, where it names topics, of one of these."""
    ok = (F.size("topics") == 0) | F.array_contains("topics", F.col("topic"))
    approved = questions.filter("status = 'approved'")
    return sections.join(approved, "question_type").filter(ok & F.col("difficulty").between(F.col("least"), F.col("most")))


def exclude_assigned(cands: DataFrame, assigned: DataFrame) -> DataFrame:
    return cands.join(assigned.select("paper_id", "question_id").distinct(), ["paper_id", "question_id"], "left_anti")


def section_capacity(sections: DataFrame) -> DataFrame:
    """sections with the places (lo, hi] that a section takes among its paper's questions of its type."""
    hi = F.sum("need").over(Window.partitionBy("paper_id", "question_type").orderBy("section_index").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sections.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("need"))


def assign_sections(pq: DataFrame, sections: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """pq(paper_id, question_id, question_type, order_index, keep...) with the section that has room for it, or null.

    The n-th question of a type goes to the section whose capacity interval holds n: an interval join within (paper, type).
    """
    w = Window.partitionBy("paper_id", "question_type").orderBy("order_index", "question_id", "price")
    n = pq.withColumn("n", F.row_number().over(w))
    s = section_capacity(sections).select("paper_id", "question_type", "section_index", "lo", "hi")
    inside = (n.paper_id == s.paper_id) & (n.question_type == s.question_type) & (s.lo < n.n) & (n.n <= s.hi)
    return n.join(s, inside, "left").select(n.paper_id, n.question_id, n.question_type, n.order_index, *(n[c] for c in keep), s.section_index)


def section_fill(assigned: DataFrame, sections: DataFrame) -> DataFrame:
    counts = assigned.filter("section_index is not null").groupBy("paper_id", "section_index").agg(F.count("*").alias("filled"))
    out = sections.join(counts, ["paper_id", "section_index"], "left").na.fill(0, ["filled"])
    return out.withColumn("shortfall", F.greatest(F.col("need") - F.col("filled"), F.lit(0)))


def order_paper(pq: DataFrame) -> DataFrame:
    """Places from 1: locked questions in their old order, then those asked for in the order of the request, then section by section by falling score.

    pq(paper_id, question_id, is_locked, order_index, manual_position, section_index, score, price); manual_position is null where a
    question wasn't asked for, section_index where it has no section, and such questions come last.
    """
    phase = F.when(F.col("is_locked"), 0).when(F.col("manual_position").isNotNull(), 1).otherwise(2)
    position = F.when(phase == 0, F.col("order_index")).when(phase == 1, F.col("manual_position"))
    w = Window.partitionBy("paper_id").orderBy(phase, position, F.when(phase == 2, F.col("section_index")).asc_nulls_last(), F.desc("score"), "order_index", "question_id", "price")
    return pq.withColumn("place", F.row_number().over(w).cast("long"))


def append_order(pq: DataFrame, new: DataFrame) -> DataFrame:
    """New questions after the paper's last, in order of id."""
    last = pq.groupBy("paper_id").agg(F.max("order_index").alias("last"))
    w = Window.partitionBy("paper_id").orderBy("question_id")
    return new.join(last, "paper_id", "left").select("paper_id", "question_id", (F.greatest(F.coalesce("last", F.lit(0)), F.lit(0)) + F.row_number().over(w)).alias("order_index"))


def validate_papers(papers: DataFrame, sections: DataFrame, pq: DataFrame, questions: DataFrame, missing_images: DataFrame | None = None) -> DataFrame:
    """Checks of each paper: approved questions, total number, total score (to 0.01), filled sections, locked questions and missing images.

    pq(paper_id, question_id, section_index, score, is_locked). Sections that are not full and missing images are warnings; images
    make a paper invalid all the same, and so does every error.
    """
    q = pq.join(questions.select("question_id", F.col("status").alias("q_status")), "question_id", "left")
    have = q.groupBy("paper_id").agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("q_status") == "approved", F.lit(False))).alias("not_approved"), F.sum("score").alias("total"), F.count_if("is_locked").alias("locked"))
    fill = section_fill(pq, sections)
    short = F.when(F.col("shortfall") > 0, F.struct("section_index", F.concat_ws("/", F.col("filled").cast("string"), F.col("need").cast("string")).alias("of")))
    want = fill.groupBy("paper_id").agg(F.sum("need").alias("need"), F.sum(F.col("need") * F.col("score_each")).alias("points"), F.array_sort(F.collect_list(short)).alias("short"))
    out = papers.select("paper_id").join(have, "paper_id", "left").join(want, "paper_id", "left")
    if missing_images is not None:
        out = out.join(missing_images.groupBy("paper_id").agg(F.count("*").alias("missing_images")), "paper_id", "left")
    else:
        out = out.withColumn("missing_images", F.lit(0).cast("long"))
    out = out.na.fill(0)
    errors = F.array_compact(F.array(
        F.when(F.col("not_approved") > 0, "questions not approved"), F.when(F.col("n") != F.col("need"), "wrong number of questions"), F.when(F.abs(F.col("total") - F.col("points")) >= 0.01, "wrong total score"),
    ))
    filled = F.transform(F.coalesce("short", F.array().cast("array<struct<section_index:bigint,of:string>>")), lambda x: F.concat(F.lit("section "), x["section_index"].cast("string"), F.lit(": "), x["of"], F.lit(" filled")))
    images = F.array_compact(F.array(F.when(F.col("missing_images") > 0, F.concat(F.col("missing_images").cast("string"), F.lit(" images missing")))))
    return out.withColumn("errors", errors).withColumn("warnings", F.concat(filled, images)).withColumn("is_valid", (F.size("errors") == 0) & (F.col("missing_images") == 0)).drop("short")


def review_papers(pq: DataFrame, fills: DataFrame | None = None) -> DataFrame:
    """pq(paper_id, num, stem, difficulty, has_answers): layout, balance and completeness findings of each paper."""
    s = X.strip(F.coalesce("stem", F.lit("")))
    formulas = F.regexp_extract_all("stem", F.lit(r"(?s)\$\$(.+?)\$\$"), F.lit(1))
    layout = F.when(s == "", "empty").when(F.length(s) < 15, "short").when(F.length(s) > 2000, "long")
    checked = pq.withColumn("layout", layout).withColumn("wide", F.exists(formulas, lambda f: F.length(f) > 120))
    real = F.when(F.col("difficulty") > 0, F.col("difficulty"))
    g = checked.groupBy("paper_id").agg(
        F.count("layout").alias("layout_warnings"), F.count_if("wide").alias("wide_formulas"), F.avg(real).alias("avg_difficulty"), F.count_if(~F.col("has_answers")).alias("n_unanswered"),
        F.slice(F.array_sort(F.collect_list(F.when(~F.col("has_answers"), F.col("num")))), 1, 5).alias("first_unanswered"),
    )
    g = g.withColumn("difficulty_note", F.when(F.col("avg_difficulty") < 2, "easy").when(F.col("avg_difficulty") > 8, "hard"))
    if fills is None:
        return g
    spread = fills.groupBy("paper_id").agg(F.when((F.count("*") >= 2) & (F.max("filled") - F.min("filled") > 5), True).otherwise(False).alias("uneven"))
    return g.join(spread, "paper_id", "left")


def duplicate_numbers(selected: DataFrame) -> DataFrame:
    """selected(export_id, number) with whether the number stands more than once in its export."""
    return selected.withColumn("duplicated", F.coalesce((F.count("number").over(Window.partitionBy("export_id", "number")) > 1) & F.col("number").isNotNull(), F.lit(False)))


#: Rows of exports that one task holds and sorts.
ROWS = 1 << 17


def resolve_export(explicit: DataFrame, hits: DataFrame, count: int) -> DataFrame:
    """(export_id, question_id, place): explicit ids in order, each once, then search hits, up to count."""
    both = explicit.select("export_id", "question_id", F.lit(0).alias("origin"), F.col("position").cast("long").alias("position")).unionByName(hits.select("export_id", "question_id", F.lit(1).alias("origin"), F.col("rank").cast("long").alias("position")))
    # whole exports in tasks of about ROWS rows: Spark's own tasks are as many as cores, however large the tables are
    tasks = max(both.sparkSession.sparkContext.defaultParallelism, -(-both.count() // ROWS))
    once = both.repartition(tasks, "export_id").groupBy("export_id", "question_id").agg(F.min(F.struct("origin", "position")).alias("o"))
    w = Window.partitionBy("export_id").orderBy("o", "question_id")
    return once.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= count).select("export_id", "question_id", "place")


def assemble_tex(parts: DataFrame) -> DataFrame:
    """(export_id, tex) of parts(export_id, place, heading, body): marker, heading and body of each question, in order."""
    line = F.concat(F.lit("\\typeout{QUESTION_ID="), F.col("question_id").cast("string"), F.lit("}\n\\subsection*{"), F.col("heading"), F.lit("}\n"), F.col("body"))
    return parts.withColumn("line", line).groupBy("export_id").agg(F.expr("listagg(line, '\n\n') within group (order by place)").alias("tex"))


# fixed values: texts of structured papers
EMPTY_SECTION, OTHERS, OTHER_ANSWERS, NO_STEM, NO_ANSWER, ANSWER, SOLUTION, ANSWERS_TITLE = "（本部分暂无题目）", "其他题目", "其他题目 — 答案", "（题目正文缺失）", "未提供答案", "答案:", "解析:", " — 参考答案"


def _tex(c: Column) -> Column:
    """Text of an item without its images, escaped outside of math."""
    bare = X.sub(X.sub(X.sub(F.coalesce(c, F.lit("")), r"!\[[^\]]*\]\([^)]+\)"), r"\\includegraphics(?:\[[^\]]*\])?\{[^}]+\}"), r"(?i)<img[^>]*>")
    return X.strip(tex_escape(bare))


def _escaped(c: Column) -> Column:
    """tex_escape of short texts, most of which hold nothing that it changes."""
    return F.when(c.rlike(r"[\\&%$#_{}~^\x01\x03]"), tex_escape(c)).otherwise(c)


def _listed(items: Column, label: str) -> Column:
    """A nested list, null where there is nothing."""
    return F.when(F.size(items) > 0, F.concat(F.lit(f"\\begin{{enumerate}}[label={label}]\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("\\item "), x)), "\n"), F.lit("\n\\end{enumerate}")))


def _images(texts: Column) -> Column:
    """Images that texts refer to, each once; null where there are none."""
    names = F.array_distinct(F.flatten(F.transform(texts, lambda t: X.image_refs(F.coalesce(t, F.lit(""))))))
    return F.when(F.size(names) > 0, F.array_join(F.transform(names, lambda n: F.concat(F.lit(f"\\begin{{center}}\n\\includegraphics[{IMAGE_SIZE}]{{assets/"), n, F.lit("}\n\\end{center}"))), "\n"))


def assemble_papers(papers: DataFrame, sections: DataFrame, pq: DataFrame, questions: DataFrame) -> DataFrame:
    """(paper_id, questions_tex, answers_tex): each paper's questions by section, with scores, options and images, and its answer paper.

    papers(paper_id, title); sections(paper_id, section_index, name, score_each); pq(paper_id, question_id, section_index, order_index,
    score): a null or zero score is the section's; questions(question_id, stem, options, answers, steps), arrays of text. A section
    without questions has a note; questions without a section come last. What an item's text is made of is dealt by paper, once.
    """
    q = questions.select(
        "question_id", F.when(X.strip(F.coalesce("stem", F.lit(""))) == "", rf"\textit{{{NO_STEM}}}").otherwise(_tex(F.col("stem"))).alias("stem"), _listed(F.transform("options", _tex), r"\Alph*.").alias("options"), _images(F.concat(F.array("stem"), "options")).alias("images"),
        F.when(F.size("answers") > 0, F.concat(F.lit(rf"\textbf{{{ANSWER}}}" + "\n"), F.array_join(F.transform("answers", _tex), "\n"))).alias("answer"), F.concat(F.lit(rf"\textbf{{{SOLUTION}}}" + "\n"), _listed(F.transform("steps", _tex), r"\arabic*.")).alias("solution"), _images(F.concat("answers", "steps")).alias("answer_images"),
    )
    last = F.lit(1 << 40)
    # what a paper has comes to it once, as lists: the texts are made there, and no text of a part is dealt again
    own = ["section_index", "order_index", "question_id", "score", "stem", "options", "images", "answer", "solution", "answer_images"]
    lines = pq.join(q, "question_id").groupBy("paper_id").agg(F.collect_list(F.struct(*own)).alias("lines"))
    known = F.struct(F.coalesce("section_index", last).alias("at"), "section_index", _escaped(F.col("name")).alias("name"), "score_each")
    listed = sections.groupBy("paper_id").agg(F.array_sort(F.collect_list(known)).alias("sections"))

    def item(x: Column, score_each: Column) -> Column:
        score = F.coalesce(F.nullif(x["score"], F.lit(0.0)), score_each, F.lit(0.0))
        return F.concat_ws("\n", F.concat(F.lit("\\item ("), score.cast("string"), F.lit("分) "), x["stem"]), x["options"], x["images"])

    def answer(x: Column, score_each: Column) -> Column:
        # a question without a section shows its answer or, without one, its steps; any other shows both
        both = F.when(x["section_index"].isNull(), F.coalesce(x["answer"], x["solution"])).otherwise(F.nullif(F.concat_ws("\n", x["answer"], x["solution"]), F.lit("")))
        return F.concat_ws("\n", F.lit("\\item"), F.coalesce(both, F.lit(rf"\textbf{{{NO_ANSWER}}}")), F.when(x["section_index"].isNotNull(), x["answer_images"]))

    def part(name: Column, of: Column, text: Callable[[Column, Column], Column], score_each: Column) -> Column:
        made = F.array_sort(F.transform(of, lambda x: F.struct(x["order_index"].alias("o"), x["question_id"].alias("q"), text(x, score_each).alias("t"))))
        body = F.concat(F.lit("\\begin{enumerate}[resume]\n"), F.array_join(F.transform(made, lambda y: y["t"]), "\n\n"), F.lit("\n\\end{enumerate}"))
        return F.concat(F.lit("\\section*{"), name, F.lit("}\n"), F.when(F.size(of) > 0, body).otherwise(F.lit(rf"\textit{{{EMPTY_SECTION}}}")))

    def body(text: Callable[[Column, Column], Column], others: str) -> Column:
        of = lambda s: F.filter("lines", lambda x: x["section_index"] == s["section_index"])
        named = F.transform("sections", lambda s: part(s["name"], of(s), text, s["score_each"]))
        free = F.filter("lines", lambda x: x["section_index"].isNull())
        rest = F.when(F.size(free) > 0, F.array(part(F.lit(others), free, text, F.lit(None).cast("double")))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(F.coalesce(named, F.array().cast("array<string>")), F.coalesce(rest, F.array().cast("array<string>"))), "\n\n")

    whole = lambda title, text: F.concat_ws("\n\n", F.concat(F.lit("\\title{"), _escaped(title), F.lit("}")), F.nullif(text, F.lit("")))
    met = papers.join(listed, "paper_id", "left").join(lines, "paper_id", "left").withColumn("lines", F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)))
    return met.select("paper_id", whole(F.col("title"), body(item, OTHERS)).alias("questions_tex"), whole(F.concat("title", F.lit(ANSWERS_TITLE)), body(answer, OTHER_ANSWERS)).alias("answers_tex"))


def nest_papers(papers: DataFrame, sections: DataFrame, pq: DataFrame, questions: DataFrame) -> DataFrame:
    """papers with their sections (each with its number of questions), their questions (stems cut to 200 characters, as previews) and both numbers."""
    counts = pq.groupBy("paper_id", "section_index").agg(F.count("*").alias("question_count"))
    s = sections.join(counts, ["paper_id", "section_index"], "left").na.fill(0, ["question_count"]).select("paper_id", "section_index", "question_type", "need", "score_each", "question_count")
    q = pq.join(questions.select("question_id", F.substring("stem", 1, 200).alias("stem")), "question_id").select("paper_id", "order_index", "question_id", "section_index", "score", "is_locked", "stem")
    full = nest(papers, "paper_id", sections=s, questions=q)
    size = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return full.withColumn("section_count", size("sections")).withColumn("question_count", size("questions"))


def fill_sections(sections: DataFrame, profiles: DataFrame, assigned: DataFrame, threshold: float = 0.86, first_k: int = 8) -> DataFrame:
    """(paper_id, section_index, question_id, pick): greedy choice for every section, best score first.

    sections(paper_id, section_index, question_type, need, profile); profiles(profile, question_type, question_id, score, stem,
    constrained): candidates scored once for each set of constraints, not for each paper. Candidates under 0.01 where the profile is
    constrained, assigned ones, those picked by earlier sections of the paper, and near-duplicates of what the section holds (bigram
    ratio over the threshold; an empty stem is like no other) are skipped. Only the best k of each profile go to the papers; papers
    with a section that ends short without having seen all candidates are done again with twice as many.
    """
    good = profiles.filter("score >= 0.01 or not constrained")
    w = Window.partitionBy("profile", "question_type").orderBy(F.desc("score"), "question_id")
    # a bare row number against a constant lets each task keep its best rows before the shuffle
    ranked = good.withColumn("r", F.row_number().over(w))
    sizes = kept(good.groupBy("profile", "question_type").agg(F.count("*").alias("n_all")), "profile-sizes")
    held = assigned.groupBy("paper_id").agg(F.collect_set("question_id").alias("assigned"))
    stem = X.strip(F.col("stem"))
    grams = F.when(F.coalesce("stem", F.lit("")) != "", F.when(F.length(stem) >= 2, F.array_distinct(F.regexp_extract_all(stem, F.lit("(?s)(?=(..))"), F.lit(1)))).otherwise(F.array(stem)))
    k, todo, done = first_k, kept(sections, "sections"), []
    while True:
        top = kept(ranked.filter(F.col("r") <= k).withColumn("g", grams), "profile-top")
        a, b = top.select("profile", "question_type", F.col("question_id").alias("id"), "r", "score", "g"), top.select("profile", "question_type", F.col("question_id").alias("other"), F.col("r").alias("r2"), F.col("g").alias("g2"))
        # within one profile's k best, which earlier candidate a later one is a near-duplicate of
        pairs = a.join(b, ["profile", "question_type"]).filter((F.col("r2") < F.col("r")) & (F.size(F.array_intersect("g", "g2")) / F.size("g2") > threshold))
        dups = pairs.groupBy("profile", "question_type", "id").agg(F.collect_list("other").alias("dups"))
        listed = a.join(dups, ["profile", "question_type", "id"], "left").groupBy("profile", "question_type").agg(F.array_sort(F.collect_list(F.struct("r", "id", F.coalesce("dups", F.array().cast("array<long>")).alias("dups")))).alias("cands")).join(sizes, ["profile", "question_type"])
        # papers that ask for the same are one row as they meet their candidates, which are many times larger than what is asked
        asks = kept(todo.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("section_index", "need", "profile", "question_type"))).alias("asks")), "asks")
        each = asks.select("asks").distinct().select("asks", F.inline("asks")).join(kept(listed, "profile-listed"), ["profile", "question_type"], "left")
        secs = each.groupBy("asks").agg(F.array_sort(F.collect_list(F.struct("section_index", "need", "cands", "n_all"))).alias("secs"))
        papers = asks.join(held, "paper_id", "left").join(kept(secs, "asked-candidates"), "asks")
        start = F.array().cast("array<struct<s:bigint,id:bigint>>")
        taken = F.coalesce("assigned", F.array().cast("array<bigint>"))

        def of_section(acc, sec):
            mine = lambda x: x["s"] == sec["section_index"]

            def step(got, c):
                room = F.size(F.filter(got, mine)) < sec["need"]
                free = ~F.array_contains(taken, c["id"]) & ~F.exists(got, lambda x: (x["id"] == c["id"]) | (mine(x) & F.array_contains(c["dups"], x["id"])))
                return F.when(room & free, F.concat(got, F.array(F.struct(sec["section_index"].alias("s"), c["id"].alias("id"))))).otherwise(got)

            return F.aggregate(F.coalesce(sec["cands"], F.array().cast("array<struct<r:int,id:bigint,dups:array<bigint>>>")), acc, step)

        chosen = papers.select("paper_id", "secs", F.aggregate("secs", start, of_section).alias("got"))
        short = F.exists("secs", lambda s: (F.size(F.filter("got", lambda x: x["s"] == s["section_index"])) < s["need"]) & (s["n_all"] > F.lit(k)))
        chosen = kept(chosen.select("paper_id", "got", short.alias("short")), "filled")
        done.append(chosen.filter("not short"))
        again = chosen.filter("short").select("paper_id")
        if again.isEmpty():
            break
        todo, k = kept(todo.join(again, "paper_id", "left_semi"), "sections"), 2 * k
    out = reduce(DataFrame.unionByName, done).select("paper_id", F.posexplode("got").alias("pick", "x"))
    return out.select("paper_id", F.col("x.s").alias("section_index"), F.col("x.id").alias("question_id"), (F.col("pick") + 1).cast("long").alias("pick"))
