"""BPE encoding and decoding by tree concatenation, with the ids that the tokenizers library gives.

Text that a tokenizer doesn't split by itself (a pre-token) can be very long. Such a one is cut into halves, these into halves
again, and the leaves are encoded apart, in parallel. Two neighbours are joined by encoding anew a window around the join: some
ids of either side. If the window's first id is the left side's id there and its last id the right side's, the ids outside stay
and the window's replace those inside; otherwise the window grows on the side that differs, at most to the whole of both.

The result is exact: a sequence of tokens is the encoding of its text if and only if every two neighbours are the encoding of
their own text, as the first merge across a border depends on nothing but the tokens beside it. All neighbours in the joined
sequence stood side by side in the left, in the window or in the right.

Short words are encoded once while they are cached. Texts with a very long unsplit run are cut into rows of their own, so that their
leaves are encoded by many tasks; each text is then joined in one.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm.common import BoundedCache, cut_long, stored, texts_of
from itemloom.llm.token_planes import CHUNK, WordEncoder

TOKENIZER = "word_bpe_49k.json"
#: Bytes of an unsplit run that are encoded at once; longer ones are cut into halves.
LEAF = 1024
#: Characters between white space from which a text's unsplit runs are encoded by tasks of their own, in leaves of so many bytes.
SPREAD = 1 << 16
#: Ids of a window on either side of a join, at first.
WINDOW = 2
#: Ids that are turned into text at once.
DECODED = 1 << 22


def tokenizer_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class TreeEncoder(WordEncoder):
    """Ids of texts, as the library's encode(text, add_special_tokens=False) gives them."""

    def __init__(self, path: str, leaf: int = LEAF):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        added = [(x["content"], x["id"]) for x in spec["added_tokens"]]
        plain = not any(x[k] for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.special = {text.encode(): np.array([i], "<u4") for text, i in added if text}
        self.apart = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        self.by_words = self.by_words and plain
        self.leaf, self.suffix = leaf, model.get("end_of_word_suffix") or ""
        byte_level = all(x in model["vocab"] for x in self.letters.values())
        # else a run is encoded whole: the joins rest on plain merges over an alphabet without gaps
        self.tree = self.by_words and model["type"] == "BPE" and byte_level and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges"))
        self.inner = None
        if self.tree:
            from tokenizers import models

            self.inner = models.BPE(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
            self.names = {i: token for token, i in model["vocab"].items()}

    def run(self, text: str, last: bool) -> list[int]:
        """Ids of a run of byte letters, of the end of a word if it is the last."""
        return [t.id for t in (self.tokenizer.model if last else self.inner).tokenize(text)]

    def half(self, text: str, last: bool) -> list[int]:
        if len(text) <= self.leaf:
            return self.run(text, last)
        middle = len(text) // 2
        return self.join(self.half(text[:middle], False), self.half(text[middle:], last), last)

    def text_of(self, ids: Sequence[int]) -> str:
        """The byte letters of a run's ids, without the mark of a word's end."""
        out = "".join(map(self.names.__getitem__, ids))
        return out.removesuffix(self.suffix) if self.suffix else out

    def join(self, left: list[int], right: list[int], last: bool, window: int = WINDOW) -> list[int]:
        """Ids of two neighbouring runs as one. last: the right one is the end of a word."""
        if not left or not right:
            return left or right
        a = b = window
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            found = self.run(self.text_of(left[len(left) - a :]) + self.text_of(right[:b]), last and b == len(right))
            left_agrees, right_agrees = a == len(left) or found[0] == left[-a], b == len(right) or found[-1] == right[b - 1]
            if left_agrees and right_agrees:
                return [*left[: len(left) - a], *found, *right[b:]]
            a, b = a * (1 if left_agrees else 4), b * (1 if right_agrees else 4)

    def join_all(self, runs: list[list[int]], last: bool = True) -> list[int]:
        """Ids of neighbouring runs as one, joined in pairs, pairs of pairs and so on."""
        while len(runs) > 1:
            runs = [self.join(*runs[i : i + 2], last and i + 2 == len(runs)) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
        return runs[0] if runs else []

    def pre_tokens(self, word: bytes) -> list[str]:
        text = self.tokenizer.normalizer.normalize_str(word.decode()) if self.tokenizer.normalizer else word.decode()
        return [t for t, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def known(self, words: list[bytes]) -> list[bytes]:
        """Long words aren't cached."""
        long = {k for k, w in enumerate(words) if len(w) > self.leaf}
        found = super().known([b"" if k in long else w for k, w in enumerate(words)] if long else words)
        for k in long:
            found[k] = np.array([i for t in self.pre_tokens(words[k]) for i in self.half(t, True)], "<u4").tobytes() if self.tree else self.word(words[k])
        return found

    def sections(self, text: bytes) -> list[bytes | np.ndarray]:
        """A text's parts between special tokens, and the ids of these."""
        if self.apart is None or b"<" not in text and not any(x in text for x in self.special):
            return [text]
        return [self.special.get(x, x) for x in self.apart.split(text) if x]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_words:
            return [self.whole(t) for t in texts]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held, size = [], 0
        for k, t in enumerate(texts):
            for part in self.sections(t.encode()):
                if not isinstance(part, bytes):
                    self.add(held, out)
                    held, size = [], 0
                    out[k].append(part)
                    continue
                for piece in cut_long(part.lower(), CHUNK):
                    held.append((k, piece))
                    size += len(piece)
                    if size >= CHUNK:
                        self.add(held, out)
                        held, size = [], 0
        self.add(held, out)
        return [x[0] if len(x) == 1 else np.concatenate([*x, np.zeros(0, "<u4")]) for x in out]

    def add(self, held: list[tuple[int, bytes]], out: list[list[np.ndarray]]) -> None:
        if held:
            super().add(held, out)

    def cut(self, text: str, size: int) -> Iterator[tuple[np.ndarray | None, str | None, bool]]:
        """A text as (ids, None, False) and the leaves (None, byte letters, end of a word) of runs of more than `size` bytes."""
        ids: list[np.ndarray] = []
        for part in self.sections(text.encode()):
            if not isinstance(part, bytes):
                ids.append(part)
                continue
            for word in re.findall(rb"[^\t-\r ]+", part):
                if len(word) <= size:
                    ids += self([word.decode("utf-8", "replace")])
                    continue
                for token in self.pre_tokens(word):
                    if len(token) <= size:
                        ids.append(np.array(self.half(token, True), "<u4"))
                        continue
                    if ids:
                        yield np.concatenate(ids), None, False
                        ids = []
                    for at in range(0, len(token), size):
                        yield None, token[at : at + size], at + size >= len(token)
        if ids:
            yield np.concatenate(ids), None, False


_ENCODERS = BoundedCache(lambda key: TreeEncoder(*key), 4)


def _lists(values: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate([*values, np.zeros(0, "<u4")]).astype(np.int32)))


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, keep: Sequence[str] = ("doc_id",), leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """(keep..., ids) for each row of docs(keep..., text), in any order.

    tokenizer: a path, or a name that public_tokenizers knows. Null and empty texts have no ids; repeated rows and null ids
    are rows like others; bytes that aren't UTF-8 are read as U+FFFD. Strings of special tokens are these tokens, as in the library.
    A tokenizer whose pieces cross white space or whose merges aren't plain is asked for whole texts.
    """
    keep, kinds = list(keep), dict(docs.dtypes)
    own = [f"`{c}` {kinds[c]}" for c in keep]
    long = F.coalesce((F.length("text") >= spread) & F.exists(F.split("text", "[\t-\r ]+"), lambda w: F.length(w) >= spread), F.lit(False))
    rows = docs.select(*keep, "text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = _ENCODERS[tokenizer_path(tokenizer), leaf]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = to_ids([t or "" for t in texts_of(part.column("text"))])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), _lists(ids)], names=[*keep, "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        to_ids, row = _ENCODERS[tokenizer_path(tokenizer), leaf], TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                text, row = texts_of(one.column("text"))[0], row + 1
                parts = to_ids.cut(text, spread) if to_ids.tree else [(to_ids([text])[0], None, False)]
                for k, (ids, run, end) in enumerate(parts):
                    listed = _lists([ids]) if ids is not None else pa.array([None], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [*(one.column(c) for c in keep), pa.array([row]), pa.array([k]), listed, pa.array([run], pa.string()), pa.array([end])], names=[*keep, "row", "part", "ids", "run", "end"]
                    )

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = _ENCODERS[tokenizer_path(tokenizer), leaf]
        for batch in batches:
            ids = [np.array(to_ids.half(t, e), "<u4") for t, e in zip(batch.column("run").to_pylist(), batch.column("end").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("part"), _lists(ids), batch.column("end")], names=["row", "part", "ids", "end"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = _ENCODERS[tokenizer_path(tokenizer), leaf]
        for batch in batches:
            found = []
            for parts in batch.column("parts").to_pylist():
                out, runs = [], []
                for x in parts:
                    if not x["is_run"]:
                        out += x["ids"]
                        continue
                    runs.append(x["ids"])
                    if x["end"]:
                        out += to_ids.join_all(runs)
                        runs = []
                found.append(np.array(out, "<u4"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), _lists(found)], names=["row", "ids"])

    usual = rows.filter(~long).mapInArrow(whole, ", ".join([*own, "ids array<int>"]))
    parts = stored(rows.filter(long).mapInArrow(cut, ", ".join([*own, "row long, part long, ids array<int>, run string, end boolean"])), "bpe-parts")
    runs = parts.filter("run is not null").repartition("row", "part").select("row", "part", "run", "end").mapInArrow(leaves, "row long, part long, ids array<int>, end boolean")
    ready = parts.filter("run is null").select("row", "part", F.lit(False).alias("is_run"), "ids", "end").unionByName(runs.withColumn("is_run", F.lit(True)))
    # a row for each part of one text, so no group is larger than a text
    texts = ready.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("part", "is_run", "end", "ids"))).alias("parts")).mapInArrow(join, "row long, ids array<int>")
    joined = parts.filter("part = 0").select("row", *keep).join(texts, "row").select(*keep, "ids")
    return usual.unionByName(joined)


def decode(encoded: DataFrame, tokenizer: str = TOKENIZER, keep: Sequence[str] = ("doc_id",), column: str = "ids") -> DataFrame:
    """(keep..., text) of encoded(keep..., ids): the library's decode(ids, skip_special_tokens=False).

    Without a decoder in the tokenizer that is the tokens with a space between two; ids that it doesn't know are left out. Null ids give ''.
    """
    keep, kinds = list(keep), dict(encoded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = _ENCODERS[tokenizer_path(tokenizer), LEAF]
        known = to_ids.tokenizer
        size = known.get_vocab_size(with_added_tokens=True)
        tokens = pa.array([known.id_to_token(i) for i in range(size)], pa.string())
        for batch in batches:
            lengths = pa.compute.list_value_length(batch.column("__ids")).fill_null(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // DECODED)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                flat = part.column("__ids").flatten().to_numpy()
                if known.decoder is None and (not len(flat) or (flat.min() >= 0 and flat.max() < size and not tokens.null_count)):
                    texts = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths[a:b]]), pa.int32()), tokens.take(pa.array(flat))), " ")
                else:
                    texts = pa.array([known.decode([i for i in x or () if i >= 0], skip_special_tokens=False) for x in part.column("__ids").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), texts], names=[*keep, "text"])

    return encoded.select(*keep, F.col(column).alias("__ids")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string"]))


def digests(docs: DataFrame, tokenizer: str = TOKENIZER, leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of docs(doc_id, text): hashes of the decimal ids with a space between two, and of the text that they decode to."""
    back = decode(encode(docs, tokenizer, leaf=leaf, spread=spread), tokenizer, ("doc_id", "ids"))
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return stored(back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")), "bpe-digests")
