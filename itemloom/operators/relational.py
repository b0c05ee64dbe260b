"""Set-wise operators over relational questions, papers, topics and their links."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.sources.workspace import kept


def page_within(df: DataFrame, keys: list[str], order: str, skip: int, limit: int) -> DataFrame:
    """df's rows skip+1 to skip+limit of each key by rising order, with their place and the key's total."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("place", F.row_number().over(w.orderBy(order)).cast("long")).withColumn("total", F.count("*").over(w))
    return out.filter(F.col("place").between(skip + 1, skip + limit))


#: Rows that one task may sort for a page; pages that end further back are cut from ranges.
NEAR = 10_000


def paged(df: DataFrame, order: list[Column], skip: int, limit: int, near: int = NEAR) -> DataFrame:
    """One page of df by a total order, with the number of all rows.

    Pages near the front are a top-k. For one further back df is written once in ranges of the order; the counts of the ranges
    tell which of them hold the page, and only those are read and sorted.
    """
    if skip + limit <= near:
        return df.orderBy(*order).offset(skip).limit(limit).crossJoin(df.agg(F.count("*").alias("total")))
    ranged = kept(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect()  # a row for each partition
    before, held, ahead = 0, [], 0
    for r in sizes:
        if before + r.n <= skip:
            ahead += r.n
        elif before < skip + limit:
            held.append(r["_range"])
        before += r.n
    page = ranged.filter(F.col("_range").isin(held)).drop("_range").orderBy(*order).offset(skip - ahead).limit(limit)
    return page.withColumn("total", F.lit(before).cast("long"))


def list_questions(questions: DataFrame, q: str | None = None, question_type: str | None = None, grade: str | None = None, status: str | None = None, difficulty: tuple[int, int] | None = None, topics: list[int] | None = None, tag: str | None = None) -> DataFrame:
    """Questions whose stem or normalized_stem holds q (as ILIKE, so % and _ are wild) and that meet all filters given."""
    out = questions
    if q:
        stems = [F.col(c).ilike(f"%{q}%") for c in ("stem", "normalized_stem") if c in questions.columns]
        out = out.filter(reduce(or_, (F.coalesce(c, F.lit(False)) for c in stems)))
    for name, value in (("question_type", question_type), ("grade", grade), ("status", status), ("tag", tag)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    if difficulty:
        out = out.filter(F.col("difficulty").between(*difficulty))
    if topics is not None:
        out = out.filter(F.col("topic").isin(topics))
    return out


def validate(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """df with `errors`: the messages of the rules that a row breaks; a rule that is null counts as broken."""
    return df.withColumn("errors", F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for message, ok in rules))))


# fixed values: the longest values of a question's fields
MOST_LENGTH = {"question_type": 25, "grade": 50, "semester": 50, "textbook_version": 50, "chapter": 100, "source_document_id": 50, "source_crop_asset_id": 50}
MODES = ("strict", "candidate", "force_create")


def validate_relational(df: DataFrame, batch: str, order: str) -> DataFrame:
    """df with batch_index, a record's place from 0 in its batch by `order`, and the errors of the schema's rules; columns that df lacks aren't checked.

    stem and question_type are required; difficulty is 0 to 10 where it is given; texts have greatest lengths.
    """
    w = Window.partitionBy(batch).orderBy(order)
    rules = [(f"{c} is required", F.col(c).isNotNull()) for c in ("stem", "question_type")]
    if "difficulty" in df.columns:
        rules.append(("difficulty must be 0 to 10", F.coalesce(F.col("difficulty").between(0, 10), F.lit(True))))
    rules += [(f"{c} is longer than {n}", F.coalesce(F.length(c) <= n, F.lit(True))) for c, n in MOST_LENGTH.items() if c in df.columns]
    if "knowledge_point_mode" in df.columns:
        rules.append(("knowledge_point_mode is unknown", F.coalesce(F.col("knowledge_point_mode").isin(*MODES), F.lit(True))))
    return validate(df.withColumn("batch_index", (F.row_number().over(w) - 1).cast("long")), rules)


def exclude_recent(df: DataFrame, days: int, now: Column, updated: str = "updated_at") -> DataFrame:
    """Rows that were never updated, or more than `days` before now."""
    return df.filter(F.col(updated).isNull() | (F.col(updated) < now - F.make_dt_interval(F.lit(days))))


def retention(artifacts: DataFrame, jobs: DataFrame, days: int, now: Column, terminal: Sequence[str]) -> DataFrame:
    """(kind, id) of what may go: artifacts(id, modified_at) older than `days`, and jobs(id, status, finished_at) that ended before, in a
    terminal status and with a time that can be read. No days or fewer select nothing."""
    cutoff = now - F.make_dt_interval(F.lit(max(days, 0)))
    old = artifacts.filter(F.col("modified_at") < cutoff).select(F.lit("artifact").alias("kind"), F.col("id").cast("string").alias("id"))
    ended = jobs.filter(F.col("status").isin(*terminal) & (F.try_to_timestamp("finished_at") < cutoff)).select(F.lit("job").alias("kind"), F.col("id").cast("string").alias("id"))
    return old.unionByName(ended).filter(F.lit(days > 0))


def list_candidates(candidates: DataFrame, state: str | None = None, limit: int = 100) -> DataFrame:
    """Candidates of a state, the last updated first; the limit is kept within 1 and 100,000."""
    out = candidates if state is None else candidates.filter(F.col("state") == state)
    return out.orderBy(F.desc("updated_at"), "candidate_id").limit(min(max(limit, 1), 100_000))


def list_topic_candidates(candidates: DataFrame, status: str | None, skip: int, limit: int) -> DataFrame:
    """One page of candidates(candidate_id, status, created_at), the newest first, with the number of all of that status."""
    out = candidates if status is None else candidates.filter(F.col("status") == status)
    return paged(out, [F.desc("created_at"), F.col("candidate_id")], skip, limit)


def bank_stats(bank: DataFrame, indexed: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: questions, those that the index holds with their hash, those with assets, those flagged, and candidates that wait for review.

    bank(question_id, content_hash, assets, human_review_needed), indexed(question_id, content_hash), candidates(state).
    """
    held = bank.join(indexed.select("question_id", F.col("content_hash").alias("held")).distinct(), "question_id", "left")
    n = held.agg(F.count("*").alias("total"), F.count_if(F.col("held") == F.col("content_hash")).alias("indexed"), F.count_if(F.size("assets") > 0).alias("with_assets"), F.count_if("human_review_needed").alias("human_review_needed"))
    return n.crossJoin(F.broadcast(candidates.agg(F.count_if(F.col("state") == "needs_review").alias("pending_review"))))


def apply_transitions(entities: DataFrame, requests: DataFrame, rules: list[tuple[str, str]], key: str) -> DataFrame:
    """(key, status, target, accepted, reason): a request is accepted where its entity exists and the rules allow the move."""
    allowed = F.array(*(F.lit(f"{a}>{b}") for a, b in rules))
    joined = requests.join(entities.select(key, "status"), key, "left")
    ok = F.array_contains(allowed, F.concat_ws(">", "status", "target"))
    return joined.select(key, "status", "target", F.coalesce(F.col("status").isNotNull() & ok, F.lit(False)).alias("accepted"), F.when(F.col("status").isNull(), "not found").when(~ok, F.concat(F.lit("cannot move from "), F.col("status"), F.lit(" to "), F.col("target"))).alias("reason"))


def resolve_topics(refs: DataFrame, topics: DataFrame, mode: str) -> DataFrame:
    """(question_id, path, action, topic, name, parent, level): a known path becomes a link; an unknown one an error, a candidate or a new topic."""
    parts = F.split("path", "/")
    joined = refs.join(topics.select("path", "topic"), "path", "left")
    action = F.when(F.col("topic").isNotNull(), "link").otherwise({"strict": "error", "candidate": "candidate", "force_create": "create"}[mode])
    return joined.select("question_id", "path", action.alias("action"), "topic", F.element_at(parts, -1).alias("name"), F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")).alias("parent"), F.size(parts).cast("long").alias("level"))


def transfer_links(links: DataFrame, bridge: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The bridge(question_id, topic, source) after links(candidate_id, question_id) moved to targets(candidate_id, topic, source), and the links left.

    A pair that the bridge has stays as it is; a pair that two candidates bring comes once, by the first source. Links of candidates
    that move are removed.
    """
    moving = links.join(targets, "candidate_id")
    new = moving.groupBy("question_id", "topic").agg(F.min("source").alias("source")).join(bridge.select("question_id", "topic"), ["question_id", "topic"], "left_anti")
    return bridge.select("question_id", "topic", "source").unionByName(new), links.join(targets.select("candidate_id").distinct(), "candidate_id", "left_anti")


def find_or_create_tags(names: DataFrame, tags: DataFrame) -> DataFrame:
    """The names that aren't tags yet, each once."""
    return names.select("name").distinct().join(tags, "name", "left_anti")


def set_tags(given: DataFrame, tags: DataFrame, bridge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All tags(name), with new ones, and the bridge(question_id, name) in which questions of given(question_id, name) have these tags alone.

    A null name gives a question no tags; a name given twice counts once.
    """
    named = given.filter("name is not null").select("question_id", "name").distinct()
    kept = bridge.select("question_id", "name").join(given.select("question_id").distinct(), "question_id", "left_anti")
    return tags.select("name").unionByName(find_or_create_tags(named, tags)), kept.unionByName(named)


def missing_ancestors(paths: DataFrame, known: DataFrame) -> DataFrame:
    """(path, name, level, parent) of all prefixes of paths that aren't known."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    out = paths.select(F.explode(prefixes).alias("path")).distinct().join(known.select("path"), "path", "left_anti")
    p = F.split("path", "/")
    return out.select("path", F.element_at(p, -1).alias("name"), F.size(p).cast("long").alias("level"), F.when(F.size(p) > 1, F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), "/")).alias("parent"))


class Review(NamedTuple):
    """outcomes(candidate_id, outcome, path); new topics(path, name, level, parent) with their missing ancestors; new aliases(alias, topic);
    the bridge(question_id, topic, source) and the links(candidate_id, question_id) afterwards. Topics are named by their paths."""

    outcomes: DataFrame
    topics: DataFrame
    aliases: DataFrame
    bridge: DataFrame
    links: DataFrame


def review_candidates(cands: DataFrame, decisions: DataFrame, topics: DataFrame, aliases: DataFrame, links: DataFrame, bridge: DataFrame) -> Review:
    """What decisions(candidate_id, decision in approve, merge, reject, target) make of cands(candidate_id, name, parent, status).

    Only pending candidates move. An approval conflicts where its path is a topic or an alias already, or an earlier candidate's of the
    same batch; else it makes the topic and its missing ancestors. A merge makes the name an alias of the target, which has to be a
    topic. Links move with approvals and merges and go with rejections.
    """
    path = F.when(F.coalesce("parent", F.lit("")) != "", F.concat_ws("/", F.rtrim(F.col("parent"), F.lit("/")), "name")).otherwise(F.col("name"))
    known = topics.select("path").unionByName(aliases.select(F.col("alias").alias("path"))).distinct().withColumn("exists", F.lit(True))
    targets = topics.select(F.col("path").alias("target"), F.lit(True).alias("has_target"))
    c = cands.withColumn("path", path).join(decisions, "candidate_id").join(known, "path", "left").join(targets, "target", "left")
    asks = (F.col("status") == "pending") & (F.col("decision") == "approve") & F.col("exists").isNull()
    first = F.row_number().over(Window.partitionBy("path", asks).orderBy("candidate_id")) == 1
    outcome = (
        F.when(F.col("status") != "pending", "refused").when((F.col("decision") == "approve") & asks & first, "approved").when(F.col("decision") == "approve", "conflict")
        .when((F.col("decision") == "merge") & F.col("has_target").isNull(), "no target").when(F.col("decision") == "merge", "merged").otherwise("rejected")
    )
    told = c.withColumn("outcome", outcome)
    made = missing_ancestors(told.filter("outcome = 'approved'").select("path"), topics)
    merged = told.filter("outcome = 'merged'")
    moves = told.filter("outcome in ('approved', 'merged')").select("candidate_id", F.when(F.col("outcome") == "merged", F.col("target")).otherwise(F.col("path")).alias("topic"), F.when(F.col("outcome") == "merged", "merged").otherwise("candidate").alias("source"))
    after, left = transfer_links(links, bridge, moves)
    left = left.join(told.filter("outcome = 'rejected'").select("candidate_id"), "candidate_id", "left_anti")
    return Review(told.select("candidate_id", "outcome", "path"), made, merged.select(F.col("name").alias("alias"), F.col("target").alias("topic")).distinct(), after, left)


def topic_overlap(pairs: DataFrame, a: DataFrame, b: DataFrame, a_key: str, b_key: str, value: str) -> DataFrame:
    """(a_key, b_key, overlap): how many different values the two sides of each different pair(a_key, b_key) share; 0 where they share none.

    Sets of values are made once an id and intersected in the row, so the work grows with the pairs that are asked for.
    """
    sets = lambda df, key, name: df.filter(F.col(value).isNotNull()).groupBy(key).agg(F.collect_set(value).alias(name))
    both = pairs.select(a_key, b_key).distinct().join(sets(a, a_key, "values_a"), a_key, "left").join(sets(b, b_key, "values_b"), b_key, "left")
    return both.select(a_key, b_key, F.coalesce(F.size(F.array_intersect("values_a", "values_b")), F.lit(0)).cast("long").alias("overlap"))


#: Classes of the first side that are sent to every task; of more, those that share a value meet by a shuffle.
MOST_CLASSES = 10_000
#: Different values of the first side up to which its classes are bits of words, of 64 each.
MOST_VALUES = 256


def value_classes(df: DataFrame, key: str, value: str) -> DataFrame:
    """(id, class_id, held): ids with the same set of values are one class, named by its smallest id; ids without any value are left out."""
    sets = kept(df.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_set(value)).alias("held")), "value-sets")
    return sets.join(sets.groupBy("held").agg(F.min("id").alias("class_id")), "held").select("id", "class_id", "held")


def _bits(held: str, values: list) -> Column:
    """A bit for each of up to 64 values that a list holds."""
    place = lambda v: F.array_position(F.array(*map(F.lit, values)), v).cast("int") - 1
    bit = lambda v: F.when(place(v) >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), place(v))).otherwise(F.lit(0).cast("long"))
    return F.aggregate(held, F.lit(0).cast("long"), lambda m, v: m.bitwiseOR(bit(v))) if values else F.lit(0).cast("long")


def topic_overlaps(a: DataFrame, b: DataFrame, a_key: str, b_key: str, value: str) -> DataFrame:
    """(kind, a, b, overlap): every id of a against every id of b, as pairs of classes of equal sets of values that share one or more, and each id's class.

    kind is `pair`, with the classes and how many values they share, or a side's key (a_key, b_key), with an id, its class and how many values it has.
    The pairs grow with the classes of one side times those of the other.
    """
    own, other = kept(value_classes(a, a_key, value), "value-classes"), kept(value_classes(b, b_key, value), "value-classes")
    one = lambda df, c, name: df.filter("id = class_id").select(F.col("class_id").alias(c), F.col("held").alias(name))
    x, y = one(own, "a", "held_a"), one(other, "b", "held_b")
    if x.count() <= MOST_CLASSES:
        values = [r.v for r in x.select(F.explode("held_a").alias("v")).distinct().orderBy("v").limit(MOST_VALUES + 1).collect()]
        if len(values) <= MOST_VALUES:
            # a pair costs an AND of each word, not a comparison of strings
            words = range(max(1, -(-len(values) // 64)))
            x, y = x.select("a", *(_bits("held_a", values[64 * i : 64 * i + 64]).alias(f"a{i}") for i in words)), y.select("b", *(_bits("held_b", values[64 * i : 64 * i + 64]).alias(f"b{i}") for i in words))
            both = [F.col(f"a{i}").bitwiseAND(F.col(f"b{i}")) for i in words]
            pairs = y.join(F.broadcast(x), reduce(or_, (c != 0 for c in both))).select("a", "b", reduce(add, map(F.bit_count, both)).cast("long").alias("overlap"))
        else:
            shared = F.size(F.array_intersect("held_a", "held_b")).cast("long")
            pairs = y.crossJoin(F.broadcast(x)).withColumn("overlap", shared).filter("overlap > 0").select("a", "b", "overlap")
    else:
        pairs = x.select("a", F.explode("held_a").alias("v")).join(y.select("b", F.explode("held_b").alias("v")), "v").groupBy("a", "b").agg(F.count("*").alias("overlap"))
    member = lambda df, key: df.select(F.lit(key).alias("kind"), F.col("id").alias("a"), F.col("class_id").alias("b"), F.size("held").cast("long").alias("overlap"))
    return pairs.select(F.lit("pair").alias("kind"), "a", "b", "overlap").unionByName(member(own, a_key)).unionByName(member(other, b_key))


def cascade_delete(gone: DataFrame, tables: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """Each table without the rows of gone(key)."""
    return {name: df.join(gone.select(key).distinct(), key, "left_anti") for name, df in tables.items()}


def nest_question(questions: DataFrame, options: DataFrame, answers: DataFrame, steps: DataFrame, topics: DataFrame, tags: DataFrame) -> DataFrame:
    """Whole records: questions with arrays of options by order_index, answers, steps by step_order, topics (path, weight, is_primary) and tag names.

    Each child table has question_id and its columns in the order by which it is sorted. A question without children has empty arrays.
    """
    full = nest(questions, "question_id", options=options, answers=answers, steps=steps, topics=topics, tags=tags)
    names = {"options": options, "answers": answers, "steps": steps, "topics": topics, "tags": tags}
    kinds = dict(full.dtypes)
    full = full.select(*questions.columns, *(F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in names))
    return full.withColumn("tags", F.transform("tags", lambda x: x["name"]))


def explode_record(records: DataFrame, held: DataFrame) -> DataFrame:
    """(question_id, kind, place, value, weight): the child rows of records(question_id, options, answers, steps, topics, tags, concepts), arrays of text.

    place is from 0. A record's first topic is primary and weighs 1, as its others do; concepts that held(question_id, value) has as
    candidates of this question don't come again, and weigh 0.5.
    """
    def rows(kind: str) -> DataFrame:
        weight = F.lit({"topics": 1.0, "concepts": 0.5}.get(kind)).cast("double")
        return records.select("question_id", F.posexplode(kind).alias("place", "value")).select("question_id", F.lit(kind.removesuffix("s")).alias("kind"), F.col("place").cast("long").alias("place"), "value", weight.alias("weight"))

    concepts = rows("concepts").join(held.select("question_id", "value").distinct(), ["question_id", "value"], "left_anti")
    return reduce(DataFrame.unionByName, [*map(rows, ("options", "answers", "steps", "topics", "tags")), concepts])


def replace_children(child: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows of child but for those of updated parents, and the updates' rows; an update without rows (null value) removes all."""
    kept = child.join(updates.select(key).distinct(), key, "left_anti")
    return kept.unionByName(updates.filter("value is not null").select(child.columns))


def latest_version(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key: one partial aggregate, no sort."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), F.struct(*order)).alias("r")).select(key, "r.*")


def nest(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """parents with an array of each child table's other columns, sorted by them; every child is aggregated before it is joined."""
    out = parents
    for name, child in children.items():
        cols = [c for c in child.columns if c != key]
        out = out.join(child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name)), key, "left")
    return out


def topic_counts(topics: DataFrame, bridge: DataFrame) -> DataFrame:
    """Topics with their number of different questions, children after parents by path."""
    counts = bridge.groupBy("topic").agg(F.count_distinct("question_id").alias("n_questions"))
    return topics.join(counts, "topic", "left").na.fill(0, ["n_questions"]).withColumn("level", F.size(F.split("path", "/")).cast("long"))


def missing_assets(refs: DataFrame, assets: DataFrame) -> DataFrame:
    """(question_id, reference, error) of references that are remote, absolute, leave the folder, show a rendered page, or aren't there."""
    name = F.substring_index("reference", "/", -1)
    typed = (
        F.when(F.col("reference").rlike("^(?i)https?:"), "remote").when(F.col("reference").startswith("/"), "absolute").when(F.col("reference").rlike(r"(^|/)\.\.(/|$)"), "outside")
        .when(F.lower(name).rlike(r"^(?:page|p)[_-]?\d{1,4}\.(?:png|jpg|jpeg|webp)$"), "rendered page")
    )
    r = refs.withColumn("filename", name).withColumn("error", typed)
    absent = r.filter("error is null").join(assets.select("question_id", "filename").distinct(), ["question_id", "filename"], "left_anti").withColumn("error", F.lit("missing"))
    return r.filter("error is not null").select("question_id", "reference", "error").unionByName(absent.select("question_id", "reference", "error")).distinct()
