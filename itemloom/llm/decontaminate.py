"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

A seed is a fixed mask over consecutive words; the words at its 1s are hashed, those at its 0s are ignored. Seeds of
documents and of benchmark items are joined. A hit names a diagonal: the document's place at which the item would begin. Each
diagonal is looked at once for each CHUNK words of the item: the words are compared place by place, in every window of RUN words of the item
there, so a passage with some of its words replaced is still found, and words far from each other don't count together.

The masks hit every window of 7 to RUN words of which SHARE stand in line, whichever these are (a test goes through all patterns). An
item of fewer words has masks of its own: all its words, or all but one where SHARE allows that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Five words of five to nine.
MASKS = ("1101011", "11001011", "101100011", "11111", "111011")
#: Items of fewer words than this have masks of their own length.
SHORT = 7
#: An item is in a document where at least this share of a window of RUN of its words (of all, if it has fewer) stands in line.
RUN, SHARE = 20, 0.8
#: Up to so many item seeds (a hash, an id and a place: about 60 bytes in a hash table, so 120 MB) are sent to every executor, with
#: the items' words, of which there are a fifth as many at 8 bytes; more are joined by shuffling both sides.
MOST_SENT = 2_000_000
#: Documents are looked at in pieces of so many words, items in chunks of so many.
PIECE, CHUNK = 512, 64
WORD_END = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, each as its 64-bit hash."""
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_END), ""), lambda w: F.xxhash64(w))


def masks_for(short: list[int]) -> list[tuple[str, int | None]]:
    """Masks with the number of words of the items that they are for (None: all of SHORT or more), where items of the numbers `short` exist."""
    out: list[tuple[str, int | None]] = [(m, None) for m in MASKS]
    for n in sorted(short):
        one_off = n - 1 >= SHARE * n
        out += [("1" * i + "0" + "1" * (n - i - 1), n) for i in range(n)] if one_off else [("1" * n, n)]
    return out


#: Words that a mask reaches over at most; seeds() calls them w0, w1 and so on.
REACH = max(map(len, MASKS))
REACHED = [f"w{i}" for i in range(REACH)]


def seeds(df: DataFrame, keep: list[str], masks: list[tuple[str, int | None]]) -> DataFrame:
    """A row (keep..., w, at, w0, w1, ..., k, seed) for each of df's words w, from `first` on and of `own` words, and each mask k that fits there."""
    placed = df.filter("own > 0").select(*keep, "w", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("own") - 1)).alias("at"))
    # each word is fetched once for all masks; a method that hashes more than these grows too long to be compiled
    placed = placed.select(*keep, "w", "at", *(F.get("w", F.col("at") + i).alias(c) for i, c in enumerate(REACHED)))
    keys = [F.when(F.col(REACHED[len(m) - 1]).isNotNull(), F.xxhash64(F.lit(k), *(c for c, one in zip(REACHED, m, strict=False) if one == "1"))) for k, (m, _) in enumerate(masks)]
    return placed.select(*keep, "w", "at", *REACHED, F.posexplode(F.array(*keys)).alias("k", "seed")).filter("seed is not null")


def around_of(at: Column) -> Column:
    """The hash of all words that masks reach from `at` on and of the word before; null where the text has fewer."""
    return F.when((at >= 1) & F.col(REACHED[-1]).isNotNull(), F.xxhash64(F.get("w", at - 1), *REACHED))


def pieces(df: DataFrame, keep: list[str], around: int) -> DataFrame:
    """df's words in pieces of PIECE, each with `around` words on either side, so that no row is longer however long a text is.

    base is the place in the document of a piece's first word.
    """
    starts = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / PIECE).cast("int")), lambda i: i * PIECE)
    cut = df.filter("size(w) > 0").select(*keep, "w", F.explode(starts).alias("start")).withColumn("base", F.greatest(F.col("start") - around, F.lit(0)))
    own = F.least(F.lit(PIECE), F.size("w") - F.col("start"))
    return cut.select(*keep, "base", (F.col("start") - F.col("base")).alias("first"), own.alias("own"), F.slice("w", F.col("base") + 1, F.col("start") - F.col("base") + PIECE + around).alias("w"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", most_sent: int = MOST_SENT) -> DataFrame:
    """(id, item_id, item_words, matched, overlap) for each document of docs(id, text) that has a passage of benchmark(item_id, text).

    matched is the most equal words in a window of an item, overlap its share of the window. Null and empty texts hold
    nothing and aren't held; an item of a few words is in every document with these words in line; repeated rows of an id are one document.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("w"), F.lit(0).alias("first")).withColumn("own", F.size("w"))
    n_words, short = items.agg(F.sum(F.col("own").cast("long")), F.collect_set(F.when((F.col("own") > 0) & (F.col("own") < SHORT), F.col("own")))).first()
    masks = masks_for(short)
    few = (n_words or 0) * len(masks) <= most_sent
    sent = F.broadcast if few else (lambda df: df)
    fits = [(F.col("k") == k) & ((F.size("w") >= SHORT) if n is None else (F.size("w") == n)) for k, (_, n) in enumerate(masks)]
    right = fits[0]
    for x in fits[1:]:
        right = right | x
    item_seeds = seeds(items, ["item_id"], masks).filter(right).select("seed", "item_id", F.col("at").alias("item_at"), around_of(F.col("at")).alias("item_around"))
    around = CHUNK + RUN + REACH
    # rows of one id may have different texts
    row = [id_col, "__text"]
    cut = pieces(docs.select(id_col, F.xxhash64("text").alias("__text"), words(F.col("text")).alias("w")), row, around)
    chunk = F.floor(F.col("item_at") / CHUNK).cast("int")
    # where all words around a hit are equal, the place before it on the diagonal is a hit, too
    new = lambda around: ~F.coalesce(around == F.col("item_around"), F.lit(False)) | (F.col("item_at") % CHUNK == 0)
    start = F.col("at") - F.col("item_at") + F.greatest(chunk * CHUNK - RUN + 1, F.lit(0))
    near = F.struct(F.greatest(-start, F.lit(0)).alias("pad"), F.slice("w", F.greatest(start, F.lit(0)) + 1, F.greatest(F.lit(CHUNK + 2 * RUN) + F.least(start, F.lit(0)), F.lit(0))).alias("w")).alias("near")
    key = [*row, "item_id", (F.col("base") + F.col("at") - F.col("item_at")).alias("diagonal"), chunk.alias("chunk")]
    names = [*row, "item_id", "diagonal", "chunk"]
    if few:
        met = seeds(cut, [*row, "base"], masks).join(F.broadcast(item_seeds), "seed").filter(new(around_of(F.col("at"))))
        hits = met.select(*key, near).groupBy(*names).agg(F.first("near").alias("near"))
    else:  # only places are shuffled by seed; each diagonal then gets the words around it
        met = seeds(cut, [*row, "base"], masks).select(*row, "base", "at", "seed", around_of(F.col("at")).alias("around"))
        met = met.join(item_seeds, "seed").filter(new(F.col("around")))
        places = met.select(*key, F.struct("base", "at", "item_at").alias("p")).groupBy(*names).agg(F.min("p").alias("p")).select(*names, "p.*")
        sides = cut.select(F.col(id_col).alias("__id"), F.col("__text").alias("__t"), F.col("base").alias("__base"), "w").dropDuplicates(["__id", "__t", "__base"])
        hits = places.join(sides, F.col(id_col).eqNullSafe(F.col("__id")) & F.col("__text").eqNullSafe(F.col("__t")) & (F.col("base") == F.col("__base"))).select(*names, near)
    held = sent(items.select(F.col("item_id").alias("__item"), F.col("w").alias("item_w")))
    full = hits.join(held, F.col("item_id").eqNullSafe(F.col("__item"))).withColumn("n", F.size("item_w")).withColumn("long", F.least("n", F.lit(RUN)))
    full = full.withColumn("from", F.greatest(F.col("chunk") * CHUNK - RUN + 1, F.lit(0))).withColumn("lo", F.greatest(F.col("chunk") * CHUNK - F.col("long") + 1, F.lit(0))).withColumn("hi", F.least(F.col("chunk") * CHUNK + CHUNK - 1, F.col("n") - F.col("long")))
    same = lambda i: F.coalesce((F.get("near.w", i - F.col("from") - F.col("near.pad")) == F.get("item_w", i)).cast("int"), F.lit(0))
    # a sum that slides along the diagonal; shorter windows at its beginning have no more than the first whole one
    slide = lambda a, i: F.struct((a["s"] + same(i) - F.when(i - F.col("long") >= F.col("lo"), same(i - F.col("long"))).otherwise(0)).alias("s"), F.greatest(a["best"], a["s"]).alias("best"))
    matched = F.aggregate(F.sequence("lo", F.col("hi") + F.col("long") - 1), F.struct(F.lit(0).alias("s"), F.lit(0).alias("best")), slide, lambda a: F.greatest(a["best"], a["s"]))
    checked = full.select(id_col, "item_id", "n", "long", matched.alias("matched")).filter(F.col("matched") >= SHARE * F.col("long"))
    best = checked.groupBy(id_col, "item_id").agg(F.max("n").alias("item_words"), F.max("long").alias("long"), F.max("matched").alias("matched"))
    return best.select(id_col, "item_id", F.col("item_words").cast("long"), F.col("matched").cast("long"), F.round(F.col("matched") / F.col("long"), 6).alias("overlap"))


def _sql_words(table: str, key: str) -> str:
    return f"SELECT {key}, row_number() OVER () AS r, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\pL\\pN]+'), lambda x: x <> '') AS w FROM {table}"


#: Without seeds: all diagonals on which enough words are equal.
SQL = f"""
WITH d AS MATERIALIZED ({_sql_words("documents", "doc_id")}), b AS MATERIALIZED ({_sql_words("benchmark", "item_id")}),
dp AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS p FROM d), bp AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS q, least(len(w), {RUN}) AS k FROM b),
lines AS (SELECT dp.r AS dr, bp.r AS br, p - q AS s FROM dp JOIN bp ON dp.x = bp.x GROUP BY ALL HAVING count(*) >= {SHARE} * any_value(k)),
hits AS (SELECT doc_id, item_id, d.w AS w, b.w AS iw, s, least(len(b.w), {RUN}) AS k FROM lines JOIN d ON d.r = dr JOIN b ON b.r = br),
windows AS (SELECT *, unnest(range(len(iw) - k + 1)) AS a FROM hits),
checked AS (SELECT doc_id, item_id, len(iw) AS n, k, list_sum(list_transform(range(a, a + k), lambda i: CASE WHEN s + i >= 0 AND w[s + i + 1] = iw[i + 1] THEN 1 ELSE 0 END)) AS matched FROM windows)
SELECT doc_id, item_id, CAST(max(n) AS BIGINT) AS item_words, CAST(max(matched) AS BIGINT) AS matched, round(max(matched) / max(k), 6) AS overlap
FROM checked WHERE matched >= {SHARE} * k GROUP BY doc_id, item_id
"""
