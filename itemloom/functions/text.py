"""Text expressions of item records: columns in, columns out, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"
TEX_IMAGE = r"\\includegraphics(\[[^\]]*\])?\{([^}]+)\}"
WORD = r"[\p{L}\p{N}\p{Co}]+"
CJK = r"[\x{4e00}-\x{9fff}]"

def _accent_pairs() -> tuple[str, str]:
    """Each letter and its base letter, from the letters' own decomposition."""
    import unicodedata

    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250)) if unicodedata.normalize("NFD", c)[0] != c]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BASE = _accent_pairs()


def sub(c: Column, pattern: str, to: str = "") -> Column:
    """Replaces each match; in `to`, $1 is a group and \\$ a dollar."""
    return F.regexp_replace(c, pattern, to)


#: What the pattern for Unicode white space matches.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    return strip(sub(c, r"(?U)\s+", " "))


def plain_text(c: Column) -> Column:
    """Markdown without images, link targets, heading marks, quote marks and backticks, white space collapsed."""
    c = sub(sub(c, IMAGE, " "), r"\[([^\]]+)\]\([^)]+\)", "$1")
    c = sub(sub(c, r"(?Umd)^\s{0,3}#{1,6}\s*"), r"(?Umd)^\s{0,3}>\s?")
    return collapse(F.replace(c, F.lit("`"), F.lit("")))


def title(body: Column, given: Column, fallback: Column, plain: Column | None = None) -> Column:
    """The given title, else the first # line with text, else the first 60 characters of plain text, else the fallback. plain: the body's plain text where it is at hand."""
    blank = lambda c: F.when(strip(c) != "", strip(c))
    heads = F.transform(F.filter(F.split(body, r"\r\n|[\n\r]"), lambda x: strip(x).startswith("#")), lambda x: strip(sub(strip(x), "^#+")))
    first = F.get(F.filter(heads, lambda x: x != ""), F.lit(0))
    return F.coalesce(blank(given), first, blank(F.substring(plain_text(body) if plain is None else plain, 1, 60)), fallback)


def search_parts(title_: Column, plain: Column, plain_answer: Column, metadata_json: Column) -> Column:
    return F.concat_ws("\n", title_, plain, plain_answer, F.coalesce(metadata_json, F.lit("")))


def search_text(title_: Column, body: Column, answer: Column, metadata_json: Column) -> Column:
    return search_parts(title_, plain_text(body), plain_text(F.coalesce(answer, F.lit(""))), metadata_json)


def lexical_tokens(c: Column) -> Column:
    """Runs of letters and digits, lower case, Latin accents removed; an unbroken CJK run is one token."""
    return F.regexp_extract_all(F.translate(F.lower(c), ACCENTED, BASE), F.lit(f"({WORD})"), F.lit(1))


def query_phrases(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9_.\-]+|[\x{4e00}-\x{9fff}]+)"), F.lit(1))


def strict_terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9_.\-]{4,})"), F.lit(1))


def hash_tokens(c: Column) -> Column:
    """Words, numbers and single CJK characters, then all two-character windows of the text without white space."""
    low = F.lower(c)
    words = F.regexp_extract_all(low, F.lit(rf"(?U)([a-z]+|\d+(?:\.\d+)?|{CJK})"), F.lit(1))
    compact = sub(low, r"(?U)\s+")
    # a look-ahead matches at every place, so all windows come from one pass
    windows = F.regexp_extract_all(compact, F.lit("(?s)(?=(..))"), F.lit(1))
    return F.concat(words, windows)


def content_hash(body: Column, answer: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(body, F.lit("")), F.lit("\n---ANSWER---\n"), F.coalesce(answer, F.lit(""))), 256)


def stable_question_id(explicit: Column, source_hash: Column, filename: Column, number: Column, pages: Column, title_: Column, index: Column, use_filename: bool = True) -> Column:
    """The explicit id, else qf_ and 16 digits of the hash of source, file name and logical key.

    The key is the item's own number, else its index with pages and title where there are any.
    """
    page_key, title_key = F.coalesce(F.array_join(pages, ","), F.lit("")), strip(F.coalesce(title_, F.lit("")))
    item = F.concat(F.lit("item-"), index.cast("string"))
    by_place = F.when((page_key != "") | (title_key != ""), F.concat_ws("|", item, page_key, title_key)).otherwise(item)
    key = F.when(F.coalesce(strip(number), F.lit("")) != "", strip(number)).otherwise(by_place)
    name = F.substring_index(filename, "/", -1)
    parts = [source_hash, *([name] if use_filename else []), key]
    made = F.concat(F.lit("qf_"), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 16))
    return F.when(F.coalesce(strip(explicit), F.lit("")) != "", strip(explicit)).otherwise(made)


def base_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def image_refs(c: Column) -> Column:
    """Names of images referred to, by kind of reference, each name once."""
    found = [
        F.regexp_extract_all(c, F.lit(IMAGE), F.lit(2)), F.regexp_extract_all(c, F.lit(TEX_IMAGE), F.lit(2)), F.regexp_extract_all(c, F.lit(r"""(?i)src\s*=\s*["']([^"']+)["']"""), F.lit(1)),
        F.regexp_extract_all(c, F.lit(r"(?i)\b([\w.-]+\.(?:png|jpg|jpeg|gif|pdf|svg|eps))\b"), F.lit(1)),
    ]
    return F.array_distinct(F.filter(F.transform(F.concat(*found), base_name), lambda x: x != ""))


def problem_numbers(c: Column) -> Column:
    """Numbers of one or two digits that begin a line before a full stop, first seen first."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?U)(?:^|\n)\s*(\d{1,2})\s*[.．]"), F.lit(1)), lambda x: x.cast("int")))


def paper_hints(c: Column) -> tuple[Column, Column]:
    """How many problems and points the text says there are."""
    number = lambda p: F.regexp_extract(c, p, 1).try_cast("int")
    return number(r"(?U)共\s*(\d+)\s*题"), number(r"(?U)(?:满分|总分)\s*(\d+)\s*分")


RENDERED = r"(?:page|p)[_-]?\d{1,4}\.(?:png|jpg|jpeg|webp)"


def is_rendered_page(name: Column) -> Column:
    return F.lower(name).rlike(f"^{RENDERED}$")


def rendered_refs(c: Column) -> Column:
    """Sorted names of referred images that are whole rendered pages."""
    names = F.concat(F.regexp_extract_all(c, F.lit(IMAGE), F.lit(2)), F.regexp_extract_all(c, F.lit(TEX_IMAGE), F.lit(2)))
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, base_name), is_rendered_page)))


def strip_rendered_refs(c: Column) -> Column:
    """References to rendered pages become a note that the figure has to be cut out by hand."""
    page = rf"(?:[^)]*/)?({RENDERED})"
    c = sub(c, rf"(?i)!\[\s*\]\({page}\)", "[$1 需人工裁剪为独立题图]")
    c = sub(c, rf"(?i)!\[\s*([^\]]*?)\s*\]\({page}\)", "[$1 需人工裁剪为独立题图]")
    return strip(sub(c, rf"(?i)\\includegraphics(?:\[[^\]]*\])?\{{(?:[^}}]*/)?{RENDERED}\}}", r"\\textit{[题图需人工裁剪为独立图片资产]}"))


def fix_math(c: Column) -> Column:
    """Repairs of recognised formulas in their order. The superscript rule has the pattern of the subscript rule before it, so it never applies."""
    # fixed values
    c = sub(c, r"([a-zA-Zα-ω])(\d)(?=[\s,;.+\-*/=)}\]>]|$)", r"$1_{$2}")
    c = sub(c, r"([a-zA-Zα-ω])(\d)(?=[\s,;.+\-*/=)}\]>]|$)", r"$1^{$2}")
    c = sub(c, r"(\d\})\s*([A-Z])", "$1 $2")
    for latin, greek in (("a", "α"), ("b", "β"), ("y", "γ")):
        c = sub(c, rf"(?<![a-zA-Zα-ω]){latin}(?=\s*[=+\-*/])", greek)
    c = sub(c, r"\\frac(\d)(\d)", r"\\frac{$1}{$2}")
    return sub(c, r"(?<!\\)(frac|sqrt|sum|int|prod|lim)(?=\s*[{])", r"\\$1")


def wrap_math(c: Column) -> Column:
    """Bare LaTeX in dollars, unless the text is delimited already."""
    s = strip(c)
    done = s.rlike(r"(?s)^\$.*\$$") | (s == "$") | s.rlike(r"(?s)^\\\(.*\\\)$") | s.rlike(r"(?s)^\\\[.*\\\]$")
    bare = s.rlike(r"\\[a-zA-Z]|[a-zA-Z)\]}][_^]\d|[_^]\{")
    return F.when(s == "", s).when(~done & bare, F.concat(F.lit("$"), s, F.lit("$"))).otherwise(c)


def unwrap_math(c: Column) -> Column:
    """Dollars around a text with Chinese are dropped, and so is a section of source images."""
    s = strip(c)
    inner = F.when(F.length(s) > 1, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(F.lit(""))
    s = F.when(s.startswith("$") & s.endswith("$") & inner.rlike(CJK), inner).otherwise(s)
    return sub(s, r"(?U)\n*##\s*Source\s*Images\s*\n!\[[^\]]*\]\([^)]+\)\s*")


def topic_name(c: Column) -> Column:
    return collapse(c)


def topic_key(c: Column) -> Column:
    """White space collapsed, case folded (lower case, and ss for ß)."""
    return F.replace(F.lower(collapse(c)), F.lit("ß"), F.lit("ss"))


def topic_id(c: Column) -> Column:
    return F.concat(F.lit("kp_"), F.substring(F.sha1(topic_key(c)), 1, 12))


def _stem_suffix(c: Column) -> tuple[Column, Column]:
    name = base_name(c)
    suffix = F.lower(F.regexp_extract(name, r"(?s).(\.[^.]*)$", 1))
    suffix = F.when(suffix == ".", F.lit("")).otherwise(suffix)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix)), suffix


def safe_asset_name(c: Column, fallback: str = "asset.bin") -> Column:
    stem, suffix = _stem_suffix(c)
    clean = sub(sub(stem, r"[^A-Za-z0-9_.\-]+", "_"), r"^[._-]+|[._-]+$")
    own_stem, _, own_suffix = fallback.rpartition(".")
    clean_suffix = sub(suffix, r"[^A-Za-z0-9.]+")
    return F.concat(F.when(clean != "", clean).otherwise(F.lit(own_stem)), F.when(clean_suffix != "", clean_suffix).otherwise(F.lit(f".{own_suffix}")))


def slugify(c: Column, fallback: str = "source") -> Column:
    s = sub(sub(c, r"[^A-Za-z0-9_.\-]+", "_"), r"^[._-]+|[._-]+$")
    return F.when(s != "", s).otherwise(F.lit(fallback))


# fixed values: suffixes and media types
MIME = {".svg": "image/svg+xml", ".pdf": "application/pdf", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif"}


def mime_hint(c: Column) -> Column:
    _, suffix = _stem_suffix(c)
    out = F.lit("application/octet-stream")
    for k, v in MIME.items():
        out = F.when(suffix == k, F.lit(v)).otherwise(out)
    return out


def title_from_filename(c: Column) -> Column:
    stem, _ = _stem_suffix(c)
    t = strip(F.translate(stem, "_-", "  "))
    return F.when(t != "", t).otherwise(c)


def model_json(c: Column) -> Column:
    """The JSON array of a model's reply: that of the first fence, else from the first [ to the last ]; null where there is none."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\[.*?\])\s*```", 1)
    bare = F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    return F.when(fenced != "", fenced).when(bare != "", bare)


def paper_heading(number: Column, duplicated: Column, position: Column, label: Column) -> Column:
    """第 n 题 by the item's own number; by position and source where that number occurs twice; by position where it has none."""
    own = F.coalesce(strip(number), F.lit(""))
    heading = lambda n: F.concat(F.lit("第 "), n, F.lit(" 题"))
    return F.when((own != "") & ~duplicated, heading(own)).when(own != "", F.concat(heading(position.cast("string")), F.lit("（"), label, F.lit("）"))).otherwise(heading(position.cast("string")))
