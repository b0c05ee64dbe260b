"""BPE by tree concatenation against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from itemloom.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\t", "a", "ab" * 3000, "x" * 5000, "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|endoftex", "<|" + "q" * 3000 + "<|endoftext|>" + "z" * 3000, "don't've'''t", "ﬁ é é ́x İ Σ ς", "東京" * 900, "1234567" * 300, "-=" * 1500 + "a", "�\x00b", "the " * 4000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("leaf", [1, 2, 7, 64])
def test_joins_are_exact(library, leaf):
    """Random runs over small and large alphabets, among them ones whose windows have to grow."""
    rng, encoder = random.Random(leaf), bpe.TreeEncoder(PATH, leaf)
    for alphabet in ("a", "ab", "ing", "aeiounrst", "=-", "thequickbrownfoxjumpsoverlazydogs"):
        for n in (1, 2, 3, 9, 30, 120, 700):
            run = "".join(rng.choices(alphabet, k=n))
            assert encoder.half(run, True) == [t.id for t in library.model.tokenize(run)]
            pieces = [run[i : i + leaf] for i in range(0, n, leaf)]
            assert encoder.join_all([encoder.run(p, k + 1 == len(pieces)) for k, p in enumerate(pieces)]) == [t.id for t in library.model.tokenize(run)]


def test_windows_grow_until_both_sides_agree(library):
    encoder, grown = bpe.TreeEncoder(PATH, 8), 0
    plain = encoder.run
    for n in range(20, 400, 7):
        run, calls = "a" * n + "n" * (n // 3), []
        encoder.run = lambda text, last: calls.append(text) or plain(text, last)
        left, right = plain(run[: n // 2], False), plain(run[n // 2 :], True)
        assert encoder.join(left, right, True) == plain(run, True)
        grown += len(calls) > 1
    assert grown


@pytest.mark.parametrize(("leaf", "spread"), [(1024, 1 << 16), (16, 1000), (5, 40)])
def test_odd_texts(spark, library, leaf, spread):
    rows = [(k, t, 1, "x") for k, t in enumerate(ODD)] + [(3, "again again", 1, "y"), (3, "again again", 1, "y"), (None, "b" * 2000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, row string")
    got = sorted((r.doc_id is None, r.doc_id, list(r.ids)) for r in bpe.encode(docs, leaf=leaf, spread=spread).collect())
    assert got == sorted((d is None, d, want(library, t)[0]) for d, t, *_ in rows)
    back = bpe.decode(bpe.encode(docs, leaf=leaf, spread=spread)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in back) == sorted((d is None, d, want(library, t)[1]) for d, t, *_ in rows)


def test_invalid_utf8_and_empty_table(spark):
    docs = spark.sql("select 1L doc_id, cast(x'41ff42' as string) text")
    assert [list(r.ids) for r in bpe.encode(docs).collect()] == [Tokenizer.from_file(PATH).encode("A�B", add_special_tokens=False).ids]
    assert bpe.digests(docs.limit(0)).count() == 0


def test_other_tokenizer(spark):
    """A byte-level one, whose pieces cross white space."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    known, texts = Tokenizer.from_file(path), ["Hello  World's end\n\n x", None, "a" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = bpe.encode(docs, path)
    assert {r.doc_id: list(r.ids) for r in coded.collect()} == {k: known.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in bpe.decode(coded, path).collect()} == {k: t or "" for k, t in enumerate(texts)}


def test_unknown_ids_are_left_out(spark, library):
    coded = spark.createDataFrame([(1, [5, 99999, 7]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(coded).collect()} == {1: library.decode([5, 99999, 7], skip_special_tokens=False), 2: "", 3: ""}


def test_query_is_the_library(spark, sf, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    for d in docs:
        ids, text = want(library, d.text)
        assert got[d.doc_id] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert len(got) == len(docs)
