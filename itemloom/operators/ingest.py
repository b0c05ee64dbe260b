"""From source records to the bank: validation, identity, review gate, candidates, upsert and job status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.functions import text as X

# fixed values
REVIEWED_SOURCES = ("pdf", "image", "docx")
QUESTION_ID = r"^(?!\.)[A-Za-z0-9_.\-]{1,120}$"
LIFECYCLE = ("candidate_id", "state", "created_at", "updated_at", "reviewed_at", "committed_at", "committed_question_id", "rejection_reason")
LIFECYCLE_METADATA = ("imported_at", "reviewed_at")
LATEX = r"\\frac|\\theta|\\omega|\\alpha|\\Delta"


def needs_review(flag: Column, warnings: Column, method: Column, source_type: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | (F.coalesce(F.size(warnings), F.lit(0)) > 0) | F.coalesce(method == "llm_assisted", F.lit(False)) | F.coalesce(source_type.isin(*REVIEWED_SOURCES), F.lit(False))


def review_gate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and queued records."""
    gated = df.withColumn("queued", needs_review(F.col("human_review_needed"), F.col("warnings"), F.col("import_method"), F.col("source_type")))
    return gated.filter("not queued").drop("queued"), gated.filter("queued").drop("queued")


def record_errors(record: Column) -> Column:
    """The messages of the rules that a record, a JSON text, breaks; values keep the types that the text gives them."""
    # a lambda's variable holds the parsed record: as an expression it would be parsed anew for every rule and path
    return F.get(F.transform(F.array(F.try_parse_json(record)), _broken_rules), F.lit(0))


def _broken_rules(v: Column) -> Column:
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))
    text = lambda path: F.try_variant_get(v, path, "string")
    blank = lambda c: F.coalesce(X.strip(c), F.lit("")) == ""
    is_text = lambda path: (kind(path) == "STRING") & ~blank(text(path))
    empty = lambda path: kind(path) == "ARRAY<VOID>"
    texts = lambda path: F.coalesce((kind(path) == "ARRAY<STRING>") & F.forall(F.try_variant_get(v, path, "array<string>"), lambda x: ~blank(x)), F.lit(False)) | empty(path)
    pages = F.coalesce((kind("$.metadata.source_pages") == "ARRAY<BIGINT>") & F.forall(F.try_variant_get(v, "$.metadata.source_pages", "array<bigint>"), lambda x: x > 0), F.lit(False)) | empty("$.metadata.source_pages")
    body = F.when(kind("$.question_body") == "STRING", text("$.question_body"))
    answer = F.when(kind("$.answer_body") == "STRING", text("$.answer_body"))
    given = lambda path: kind(path) != "VOID"
    is_object = lambda path: kind(path).startswith("OBJECT")
    metadata = is_object("$.metadata")
    bare = F.coalesce(body.rlike(LATEX) & ~F.contains(body, F.lit("$")) & ~F.contains(body, F.lit("\\[")), F.lit(False))
    m = "$.metadata"
    rules = [
        (~is_text("$.question_body"), "question_body must be a non-empty string"), (kind("$.answer_body") != "STRING", "answer_body must be a string"), (~metadata, "metadata must be an object"), (metadata & ~is_text(f"{m}.title"), "title must be a non-empty string"),
        (metadata & ~texts(f"{m}.knowledge_points"), "knowledge_points must be a list of strings"), (metadata & given(f"{m}.question_type") & ~is_text(f"{m}.question_type"), "question_type must be a non-empty string"),
        (metadata & given(f"{m}.tags") & ~texts(f"{m}.tags"), "tags must be a list of strings"), (metadata & given(f"{m}.source_pages") & ~pages, "source_pages must be a list of positive integers"),
        (metadata & given(f"{m}.human_review_needed") & (kind(f"{m}.human_review_needed") != "BOOLEAN"), "human_review_needed must be a boolean"), (metadata & bare, "LaTeX without delimiters"),
        (metadata & (F.size(X.rendered_refs(F.concat_ws("\n", body, answer))) > 0), "reference to a rendered page"),
    ]
    return F.when(~is_object("$"), F.array(F.lit("must be an object"))).otherwise(F.array_compact(F.array(*(F.when(broken, message) for broken, message in rules))))


def preflight(df: DataFrame) -> DataFrame:
    """(batch, question_id, error): explicit ids that a batch has twice, and ids of other characters. Blank ids are none."""
    ids = df.filter(F.coalesce(X.strip(F.col("question_id")), F.lit("")) != "").groupBy("batch", "question_id").agg(F.count("*").alias("n"))
    error = F.when(~F.col("question_id").rlike(QUESTION_ID), "invalid id").when(F.col("n") > 1, "duplicate id")
    return ids.withColumn("error", error).filter("error is not null").select("batch", "question_id", "error")


def candidate_id(df: DataFrame, assets: str = "assets", metadata: str = "metadata") -> Column:
    """fqc_ and 20 digits over df's record: its JSON with sorted keys, without what its life changes, then by name each asset.

    metadata is a column of type map<string, string>, if df has one; assets an array of (name, sha256 in hex digits).
    """
    own = [F.map_filter(F.col(c), lambda k, _: ~k.isin(*LIFECYCLE_METADATA)).alias(c) if c == metadata else F.col(c) for c in df.columns if c not in (*LIFECYCLE, assets)]
    canonical = F.to_json(F.parse_json(F.to_json(F.struct(*own), {"ignoreNullFields": "false"})))
    parts = F.transform(F.array_sort(F.col(assets)), lambda a: F.concat(a["name"].cast("binary"), F.lit(b"\0"), F.unhex(a["sha256"])))
    whole = F.aggregate(parts, canonical.cast("binary"), lambda acc, x: F.concat(acc, x))
    return F.concat(F.lit("fqc_"), F.substring(F.sha2(whole, 256), 1, 20))


def record_fingerprint(files: DataFrame) -> DataFrame:
    """(question_id, fingerprint) of files(question_id, path, content): one hash over the sorted paths and hashes of a record's files."""
    lines = F.sort_array(F.collect_list(F.concat_ws("\0", "path", F.sha2(F.col("content").cast("binary"), 256))))
    return files.groupBy("question_id").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("fingerprint"))


def reuse_reviewed(incoming: DataFrame, candidates: DataFrame) -> DataFrame:
    """incoming(candidate_id, source) against candidates(candidate_id, state, source, question_id): what becomes of a re-import."""
    j = incoming.join(candidates.select("candidate_id", "state", F.col("source").alias("old_source"), "question_id"), "candidate_id", "left")
    action = (
        F.when(F.col("state").isNull(), "new").when(~F.col("source").eqNullSafe(F.col("old_source")), "conflict").when(F.col("state") == "committed", "reuse").when(F.col("state") == "rejected", "warn").otherwise("queued")
    )
    return j.select("candidate_id", action.alias("action"), F.when(action == "reuse", F.col("question_id")).alias("question_id"))


def commit_candidates(cands: DataFrame, decisions: DataFrame) -> DataFrame:
    """(candidate_id, outcome, question_body, metadata): approvals with edited bodies and merged metadata, rejections, refusals."""
    d = decisions.select("candidate_id", "decision", "acknowledged", F.col("question_body").alias("edited"), F.col("metadata").alias("edits"))
    j = cands.join(d, "candidate_id")
    warned = (F.coalesce(F.size("warnings"), F.lit(0)) > 0) & ~F.coalesce("acknowledged", F.lit(False))
    approve = F.col("decision") == "approve"
    outcome = (
        F.when(approve & (F.col("state") == "rejected"), "refused: rejected").when(approve & warned, "refused: warnings").when(approve, "committed").when(F.col("state") == "committed", "refused: committed").otherwise("rejected")
    )
    edits = F.coalesce("edits", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(F.col("metadata"), lambda k, _: ~F.map_contains_key(edits, k) & (k != "human_review_needed")), edits)
    return j.select("candidate_id", outcome.alias("outcome"), F.coalesce("edited", "question_body").alias("question_body"), merged.alias("metadata"))


def upsert_bank(bank: DataFrame, incoming: DataFrame, overwrite: bool = False, idempotent: bool = True) -> DataFrame:
    """(question_id, action): insert, skip, replace or conflict, by comparing fingerprints alone."""
    j = bank.select("question_id", F.col("fingerprint").alias("old")).join(incoming.select("question_id", "fingerprint"), "question_id", "full")
    same = F.col("old") == F.col("fingerprint")
    action = F.when(F.col("fingerprint").isNull(), "keep").when(F.col("old").isNull(), "insert").when(same & F.lit(idempotent), "skip").when(F.lit(overwrite), "replace").otherwise("conflict")
    return j.select("question_id", action.alias("action"))


def upserted(bank: DataFrame, incoming: DataFrame, overwrite: bool = True) -> DataFrame:
    """The bank afterwards; a replaced record keeps metadata and assets that the new one doesn't give."""
    new = incoming.select("question_id", *(F.col(c).alias(f"new_{c}") for c in bank.columns if c != "question_id"))
    j = bank.join(new, "question_id", "full")
    is_new = F.col("new_question_body").isNotNull() & (F.col("question_body").isNull() | F.lit(overwrite))
    pick = lambda c: F.when(is_new, F.coalesce(F.col(f"new_{c}"), F.col(c)) if c in {"metadata", "assets"} else F.col(f"new_{c}")).otherwise(F.col(c))
    return j.select("question_id", *(pick(c).alias(c) for c in bank.columns if c != "question_id"))


def commit_to_bank(bank: DataFrame, cands: DataFrame, decisions: DataFrame) -> DataFrame:
    """The bank(question_id, question_body, metadata) after decisions on cands(candidate_id, question_id, ...): what is committed replaces or joins it."""
    done = commit_candidates(cands, decisions).filter("outcome = 'committed'").join(cands.select("candidate_id", "question_id"), "candidate_id")
    return upserted(bank, done.select("question_id", "question_body", "metadata"))


def job_rollup(files: DataFrame) -> DataFrame:
    """files(job_id, outcome in imported, review, error, rejected): counters and status of each job.

    With a column item, the id of the question or candidate, reviews count different ids (a null id counts by itself), and there is
    `created`, the number of different imported ids.
    """
    n = lambda x: F.count_if(F.col("outcome") == x)
    once = lambda x: n(x) if "item" not in files.columns else F.count_distinct(F.when(F.col("outcome") == x, F.col("item"))) + F.count_if((F.col("outcome") == x) & F.col("item").isNull())
    created = [F.count_distinct(F.when(F.col("outcome") == "imported", F.col("item"))).alias("created")] if "item" in files.columns else []
    g = files.groupBy("job_id").agg(F.count("*").alias("processed"), n("imported").alias("imported"), once("review").alias("review"), (n("error") + n("rejected")).alias("errors"), *created)
    return with_status(g)


def with_status(jobs: DataFrame) -> DataFrame:
    """jobs(imported, review, errors) with the status that follows from them."""
    status = F.when(F.col("review") > 0, "needs_review").when((F.col("imported") > 0) & (F.col("errors") > 0), "partial").when(F.col("imported") > 0, "succeeded").otherwise("failed")
    return jobs.withColumn("status", status)


def resolve_jobs(jobs: DataFrame, candidates: DataFrame) -> DataFrame:
    """jobs(job_id, imported, review, errors, status) after candidates(job_id, candidate_id, question_id, rejected) were resolved.

    review counts those still pending. The last one moves needs_review on: to partial, or failed without any import, where there were
    errors or a rejection, else to succeeded. A candidate resolved twice counts once, and its question is one import.
    """
    done = candidates.groupBy("job_id").agg(F.count_distinct("candidate_id").alias("resolved"), F.count_distinct("question_id").alias("made"), F.bool_or(F.coalesce("rejected", F.lit(False))).alias("any_rejected"))
    j = jobs.join(done, "job_id", "left").na.fill(0, ["resolved", "made"]).na.fill(False, ["any_rejected"])
    pending, imported = F.greatest(F.col("review") - F.col("resolved"), F.lit(0)), F.col("imported") + F.col("made")
    over = F.when((F.col("errors") > 0) | F.col("any_rejected"), F.when(imported > 0, "partial").otherwise("failed")).otherwise("succeeded")
    status = F.when((F.col("status") == "needs_review") & (pending == 0), over).otherwise(F.col("status"))
    return j.select("job_id", imported.alias("imported"), pending.alias("review"), "errors", status.alias("status"))


def route_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, n_chars, route): a document whose pages hold 100 characters or fewer is scanned."""
    g = pages.groupBy("doc_id").agg(F.sum(F.length(X.strip(F.coalesce("text", F.lit(""))))).alias("n_chars"))
    return g.withColumn("route", F.when(F.col("n_chars") <= 100, "scanned").otherwise("text"))


def page_of_segment(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, segment, page): the first page that holds a segment's first 50 characters, else 1."""
    head = F.substring("body", 1, 50)
    j = segments.join(pages.select("doc_id", "page_number", "text"), "doc_id", "left")
    return j.groupBy("doc_id", "segment").agg(F.coalesce(F.min(F.when(F.contains("text", head), F.col("page_number"))), F.lit(1).cast("long")).alias("page"))


def stem_classes(stems: DataFrame) -> DataFrame:
    """(question_id, class_id): questions with one stripped stem are one class, named by its smallest id; blank stems have none."""
    s = X.strip(F.col("stem"))
    own = stems.filter(F.coalesce(s, F.lit("")) != "").select("question_id", s.alias("s"))
    return own.join(own.groupBy("s").agg(F.min("question_id").alias("class_id")), "s").select("question_id", "class_id")


def near_duplicates(stems: DataFrame, threshold: float = 0.86) -> DataFrame:
    """Directed pairs (a, b, ratio) with |bigrams(a) and bigrams(b)| / |bigrams(b)| over the threshold.

    Equal stems are one class, compared once. Bigrams are in one order, the rarest first. A pair over the threshold shares a bigram among
    b's first |b| - ceil(t |b|) + 1, so only these meet a's bigrams; sizes bound what a pair can share, and so do the places where it first
    meets. What is left is counted in the row, by intersecting the two sets. Bigrams of very many stems are dealt over several keys.
    a and b are class ids; stem_classes has the members.
    """
    met = near_candidates(stems, threshold)
    grams = kept_grams(stems)
    full = met.join(grams.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a").join(grams.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b")
    ratio = F.size(F.array_intersect("ga", "gb")) / F.size("gb")
    return full.select("a", "b", ratio.alias("ratio")).filter(F.col("ratio") > threshold).withColumn("ratio", F.round("ratio", 6))


#: Stems of a bigram that go to one key.
GRAM_PART = 20_000


def kept_grams(stems: DataFrame) -> DataFrame:
    """(id, g): the different bigrams of each class of equal stems; a stem of one character is its own."""
    s = X.strip(F.col("stem"))
    classes = stems.filter(F.coalesce(s, F.lit("")) != "").groupBy(s.alias("s")).agg(F.min("question_id").alias("id"))
    return classes.select("id", F.when(F.length("s") >= 2, F.array_distinct(F.regexp_extract_all("s", F.lit("(?s)(?=(..))"), F.lit(1)))).otherwise(F.array("s")).alias("g"))


def near_candidates(stems: DataFrame, threshold: float = 0.86, part: int = GRAM_PART) -> DataFrame:
    """(a, b): classes that may share over the threshold of b's bigrams, by prefixes, sizes and places."""
    grams = kept_grams(stems)
    df = grams.select(F.explode("g").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "w"))
    placed = grams.select("id", F.size("g").alias("n"), F.explode("g").alias("w")).join(df, "w").withColumn("r", rank).withColumn("keys", F.ceil(F.col("df") / part).cast("int"))
    most = F.col("n") - F.ceil(F.col("n") * threshold) + 1
    b = placed.filter(F.col("r") <= most).select(F.col("id").alias("b"), "w", F.col("n").alias("nb"), F.col("r").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("keys") - 1)).alias("key"))
    a = placed.select(F.col("id").alias("a"), "w", F.col("n").alias("na"), F.col("r").alias("ra"), F.pmod(F.xxhash64("id"), F.col("keys")).cast("int").alias("key"))
    after = F.least(F.col("nb") - F.col("rb"), F.col("na") - F.col("ra"))
    # at any place where they meet, they can share what stands before it in both, it, and what stands behind it in both
    able = b.join(a, ["w", "key"]).filter((F.col("a") != F.col("b")) & (F.col("na") / F.col("nb") > threshold) & ((F.least("ra", "rb") + after) / F.col("nb") > threshold))
    # the first such place: nothing before it is shared, unless a bound has ruled the pair out there
    first = able.groupBy("a", "b").agg(F.min(F.struct("rb", "ra", "na", "nb")).alias("m")).select("a", "b", "m.*")
    return first.filter((1 + after) / F.col("nb") > threshold).select("a", "b")
