"""Topics derived from questions: aliases, counts, renames and merges, all set-wise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemloom.functions import text as X
from itemloom.sources.workspace import kept


def alias_map(topics: DataFrame) -> DataFrame:
    """(key, topic_id) of topics(topic_id, name, aliases): names before aliases, then the smallest id."""
    names = topics.select("topic_id", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("o"), F.col("name").alias("n"))), F.transform("aliases", lambda a: F.struct(F.lit(1).alias("o"), a.alias("n"))))).alias("x"))
    return names.groupBy(X.topic_key(F.col("x.n")).alias("key")).agg(F.min_by("topic_id", F.struct("x.o", "topic_id")).alias("topic_id"))


def alias_resolve(names: DataFrame, topics: DataFrame) -> DataFrame:
    """names(name) with topic_id: of the topic that has it as a name or alias, else a new id from the folded name."""
    keyed = names.withColumn("key", X.topic_key(F.col("name")))
    return keyed.join(alias_map(topics), "key", "left").withColumn("topic_id", F.coalesce("topic_id", X.topic_id(F.col("name")))).drop("key")


def build_topics(bank: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics (topic_id, name, aliases, n_questions) and the bridge (topic_id, question_id) of bank(question_id, topics, updated_min).

    A topic's name is the existing one, else the name first seen by falling time of change. Existing topics without questions
    stay only if they have aliases. Names are resolved once each, so a common topic is no hot key of the alias join; counts are
    partial sums over the distinct bridge.
    """
    raw = bank.select("question_id", "updated_min", F.posexplode("topics").alias("at", "raw"))
    raw = raw.withColumn("name", X.topic_name(F.col("raw"))).filter("name <> ''").drop("raw")
    seen = raw.groupBy("name").agg(F.min(F.struct((-F.col("updated_min")).alias("o"), "question_id", "at")).alias("first"))
    named = alias_resolve(seen, existing)
    firsts = named.groupBy("topic_id").agg(F.min_by("name", "first").alias("seen_name"))
    bridge = raw.select("question_id", "name").join(named.select("name", "topic_id"), "name").select("topic_id", "question_id").distinct()
    counts = bridge.groupBy("topic_id").agg(F.count("*").alias("n_questions"))
    found = firsts.join(counts, "topic_id").join(existing.select("topic_id", F.col("name").alias("old_name"), "aliases"), "topic_id", "full")
    topics = found.select("topic_id", F.coalesce("old_name", "seen_name").alias("name"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("n_questions", F.lit(0)).alias("n_questions"))
    return topics.filter((F.col("n_questions") > 0) | (F.size("aliases") > 0)), bridge


def rename_topics(topics: DataFrame, renames: DataFrame) -> DataFrame:
    """renames(topic_id, new_name): the old name becomes an alias unless they differ in case alone; the new one is no alias any more."""
    new = X.collapse(F.col("new_name"))
    joined = topics.join(renames, "topic_id", "left")
    old = F.when(X.topic_key(F.col("name")) != X.topic_key(new), F.array("name")).otherwise(F.array().cast("array<string>"))
    aliases = F.array_sort(F.array_remove(F.array_distinct(F.concat("aliases", old)), new))
    return joined.withColumn("aliases", F.when(F.col("new_name").isNotNull(), aliases).otherwise(F.col("aliases"))).withColumn("name", F.when(F.col("new_name").isNotNull(), new).otherwise(F.col("name"))).drop("new_name")


def merge_roots(pairs: DataFrame) -> DataFrame:
    """pairs(source, target) with each source's last target: merges of merges are followed by pointer jumping, a chain of n in log2(n) joins.

    Raises ValueError where a source has two targets, is its own, or merges run in a circle.
    """
    jump = kept(pairs.select("source", "target").distinct(), "merges")
    n, sources = jump.agg(F.count("*"), F.count_distinct("source")).first()
    if n != sources or jump.filter("source = target").count():
        raise ValueError("a topic is merged into two others or into itself")
    for _ in range(n.bit_length() + 1):
        onward = jump.select(F.col("source").alias("target"), F.col("target").alias("next"))
        ahead = jump.join(onward, "target", "left")
        if not ahead.filter("next is not null").count():
            return jump
        jump = kept(ahead.select("source", F.coalesce("next", "target").alias("target")), "merges")
    raise ValueError("merges run in a circle")


def merge_topics(topics: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(source, target): the last target's aliases gain the names and aliases of all topics merged into it, without its own name; sources go.

    Merges of merges come to the same as one after the other, in any order in which each topic is still there. A target that isn't
    there, at the end of its merges, takes its sources with it. Merges of unknown sources only lead on.
    """
    roots = merge_roots(pairs)
    gone = topics.join(roots, topics.topic_id == roots.source).select(F.col("target").alias("topic_id"), F.concat("aliases", F.array("name")).alias("more"))
    # names are made distinct before they are gathered
    gained = gone.select("topic_id", F.explode("more").alias("a")).select("topic_id", X.collapse(F.col("a")).alias("a")).filter("a <> ''").groupBy("topic_id").agg(F.collect_set("a").alias("more"))
    left = topics.join(roots.select(F.col("source").alias("topic_id")), "topic_id", "left_anti").join(gained, "topic_id", "left")
    merged = F.array_sort(F.filter(F.array_distinct(F.concat("aliases", "more")), lambda a: a != F.col("name")))
    return left.withColumn("aliases", F.when(F.col("more").isNotNull(), merged).otherwise(F.col("aliases"))).drop("more")


def topic_tree(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """(topic_id, parent_id, level, place, n_children, n_questions, n_below) of nodes(topic_id, parent_id, path) and counts(topic_id, n).

    level is 1 without a parent; place orders a parent's children by path, then id; n_below is the sum of n over a topic and all below it.
    Topics whose line of parents ends at one that isn't there are left out. All lines are found by pointer doubling, in log2(depth) joins; a
    circle of parents raises ValueError.
    """
    nodes = kept(nodes.select("topic_id", "parent_id", "path"), "tree-nodes")
    n = nodes.count()
    jump = kept(nodes.filter("parent_id is not null").select(F.col("topic_id").alias("node"), F.col("parent_id").alias("up")), "tree-jump")
    lines, step = jump.withColumn("far", F.lit(1)), 1
    for _ in range(n.bit_length() + 1):
        onward = jump.select(F.col("node").alias("up"), F.col("up").alias("next"))
        lines = kept(lines.unionByName(lines.join(onward, "up").select("node", F.col("next").alias("up"), (F.col("far") + step).alias("far"))), "tree-lines")
        jump, step = kept(jump.join(onward, "up").select("node", F.col("next").alias("up")), "tree-jump"), 2 * step
        if jump.isEmpty():
            break
    else:
        raise ValueError("parents run in a circle")
    tops = lines.groupBy("node").agg(F.max_by("up", "far").alias("top"), F.max("far").alias("far"))
    roots = nodes.filter("parent_id is null").select(F.col("topic_id").alias("top"))
    levels = tops.join(roots, "top").select(F.col("node").alias("topic_id"), (F.col("far") + 1).cast("long").alias("level")).unionByName(roots.select(F.col("top").alias("topic_id"), F.lit(1).cast("long").alias("level")))
    own = counts.groupBy("topic_id").agg(F.sum("n").cast("long").alias("n_questions"))
    below = lines.join(own, lines.node == own.topic_id).groupBy("up").agg(F.sum("n_questions").alias("more"))
    place = F.row_number().over(Window.partitionBy("parent_id").orderBy("path", "topic_id")).cast("long").alias("place")
    children = nodes.filter("parent_id is not null").groupBy(F.col("parent_id").alias("topic_id")).agg(F.count("*").alias("n_children"))
    out = nodes.select("topic_id", "parent_id", place).join(levels, "topic_id").join(children, "topic_id", "left").join(own, "topic_id", "left").join(below.withColumnRenamed("up", "topic_id"), "topic_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("topic_id", "parent_id", "level", "place", zero("n_children").alias("n_children"), zero("n_questions").alias("n_questions"), (zero("n_questions") + zero("more")).alias("n_below"))


def gaps(numbers: DataFrame, key: str, number: str) -> DataFrame:
    """(key, number, next_number) where the next number isn't one more."""
    nxt = F.lead(number).over(Window.partitionBy(key).orderBy(number))
    return numbers.select(key, number, nxt.alias("next_number")).filter(F.col("next_number") > F.col(number) + 1)
