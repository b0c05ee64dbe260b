"""WARC, token files, media, language and SimHash, against plain Python over the same rows."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
import xxhash

from itemloom.llm import language, media, queries, simhash, token_planes, warc

ODD = "doc_id long, text string, lang string, source string, n_chars long, extra string, fp long"
ODD_ROWS = [
    (1, None, None, None, None, "x", 1), (2, "", "en", "s", 0, None, 2), (3, "  \n\t ", "en", "s", 4, "x", 3), (4, "one", "en", "s", 3, "x", 4), (5, "one", "en", "s", 3, "x", 4), (5, "one", "en", "s", 3, "x", 4),
    (6, "word " * 60_000, "en", "s", 1, "x", 5), (7, "1234 !!", None, "s", 7, "x", 6), (None, "lost id", "fr", "t", 7, "x", 7), (8, "Ünïcode İ <|endoftext|> a̸=.", "de", "t", 9, "x", 8),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


def rows_of(df, *by):
    return sorted((tuple(r) for r in df.collect()), key=repr) if not by else {r[by[0]]: r for r in df.collect()}


# --- WARC


def test_warc_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas()
    least = {}
    for p, h in sorted(zip(pages.page_id, pages.html.fillna(""), strict=True)):
        least.setdefault(h, p)
    got = rows_of(queries.op10_warc(spark, sf), "page_id")
    assert len(got) == len(pages)
    for p, h in zip(pages.page_id, pages.html.fillna(""), strict=True):
        r, b = got[p], h.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if least[h] == p else ("revisit", least[h]))


def test_warc_odd(spark):
    df = spark.createDataFrame([(1, None, None, 0), (2, "http://a/ b\r\nX: y", "", 0), (3, "http://a/", "é" * 300_000, 0), (3, "http://a/", "é" * 300_000, 0), (None, "u", "é" * 300_000, 0), (4, "u", "WARC/1.1\r\n\r\n", 0)], "page_id long, url string, html string, refers_to int")
    got = rows_of(warc.read_archives(warc.write_archives(df, archive_bytes=1)).select("page_id", "payload_bytes", "record_type", "refers_to"))
    assert got == sorted([(1, 0, "response", None), (2, 0, "revisit", 1), (3, 600_000, "response", None), (3, 600_000, "response", None), (None, 600_000, "revisit", 3), (4, 12, "response", None)], key=repr)
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_warc_reader_is_incremental_and_strict(tmp_path, spark):
    data = b"".join(warc.write_record(i, "http://x", bytes([i]) * 100_000, None, False, "2024-01-01T00:00:00Z") for i in range(3))
    assert [r["page_id"] for r in warc.read_records(data[i : i + 7] for i in range(0, len(data), 7))] == [0, 1, 2]
    with pytest.raises(ValueError):
        list(warc.read_records([data[:-5]]))
    z = zlib.compressobj(wbits=31)
    bad = zlib.decompress(warc.write_record(1, "u", b"abc", None, False, "d"), 31).replace(b"abc", b"abd")
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records([z.compress(bad) + z.flush()]))
    (tmp_path / "a.warc.gz").write_bytes(data)
    assert warc.read_warc_files(spark, str(tmp_path)).count() == 3


def test_warc_of_others(tmp_path, spark):
    """Records of other writers: warcinfo, a response without digests, a request, a revisit by record id, odd header spacing; and a wrong digest of another."""
    import gzip

    def record(kind, block, **head):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", f"Content-Length:  {len(block)}", *(f"{k.replace('_', '-')}:{v}" for k, v in head.items())]
        return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    sha = base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    data = [
        record("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"), record("response", http + b"body", Content_Type="application/http; msgtype=response", WARC_Record_ID="<urn:a>", WARC_Target_URI="http://a/", X_Page_Id=5),
        record("request", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http"), record("revisit", http, Content_Type="application/http", WARC_Refers_To="<urn:a>", WARC_Payload_Digest=f"sha1:{sha}"), record("resource", b"body", WARC_Payload_Digest="md5:00"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(data))
    got = warc.resolved(warc.read_warc_files(spark, str(tmp_path))).collect()
    rows = {r.record_type: r for r in got}
    assert len(got) == 5 and (rows["response"].payload_bytes, rows["response"].payload_digest, rows["response"].verified) == (4, sha, False)
    assert (rows["revisit"].refers_to, rows["revisit"].payload_bytes, rows["revisit"].payload_digest) == (5, None, sha) and rows["warcinfo"].payload_bytes == 13 and rows["resource"].payload_digest == "md5:00"
    with pytest.raises(ValueError, match="payload digest"):
        list(warc.read_records([record("response", http + b"body", Content_Type="application/http", WARC_Payload_Digest=f"sha1:{sha[::-1]}")]))
    with pytest.raises(ValueError, match="content-length"):
        list(warc.read_records([gzip.compress(b"WARC/1.0\r\nWARC-Type: x\r\n\r\n\r\n\r\n")]))


# --- token files


def test_words_encode_like_whole_texts():
    """Random strings, long texts and odd white space through the cached words and through the tokenizer alone."""
    import random

    import public_tokenizers

    encoder, r = token_planes.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), most=300), random.Random(1)
    signs = "abcZÉßé ,.'’!-<|>0123\n\t \u0085中я́𝒳İſ\x1c"
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(30))) for _ in range(5000)] + ["", " ", "word, x " * 200_000, "q" * 300_000 + " a", ""]
    assert encoder.by_words
    for text, ids in zip(texts, encoder(texts), strict=True):
        assert ids.tolist() == encoder.whole(text).tolist()
    assert encoder([]) == []


def expected_ids(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        yield doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_token_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id")
    assert rows_of(queries.op9_token_planes(spark, sf)) == sorted(expected_ids(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)), key=repr)


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_token_odd(spark, odd, empty, mode):
    files = token_planes.write_token_files(odd, mode=mode, block=50, file_ids=100)
    want = sorted(((r[0], r[1]) for r in ODD_ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert rows_of(token_planes.read_token_files(files)) == sorted(expected_ids(want), key=repr)
    assert token_planes.read_token_files(token_planes.write_token_files(empty)).count() == 0


@pytest.mark.parametrize("mode", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 1000])
def test_token_file_round_trip(mode, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    content = token_planes.encode_file(ids, [5, None], [n, 0], mode, block=64)
    back, names, lengths = token_planes.decode_file(content)
    assert (back == ids).all() and names == [5, None] and lengths.tolist() == [n, 0]


# --- media


def test_media_query_and_odd(spark, sf, odd, empty):
    for docs, got in ((spark.read.parquet(f"{sf}/documents.parquet"), queries.op4_media(spark, sf)), (odd, media.media_digest(media.probe_media(media.write_media(odd))))):
        want = []
        for r in docs.collect():
            b = (r.text or "").encode()
            p = b + b" " * ((-len(b)) % 192 if b else 192)
            m = media.build_container(b)
            want.append((r.doc_id, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest()))
        assert rows_of(got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")) == sorted(want, key=repr)
    assert media.probe_media(media.write_media(empty)).count() == 0


def test_media_boxes_and_damage(spark):
    payload = bytes(range(256)) * 100
    content = media.build_container(payload)
    x = media.probe(content)
    n = len(media.pad(payload)) // 192
    assert (x["codec"], x["width"], x["height"], x["duration"] / x["timescale"], len(x["starts"])) == ("raw", 16, 12, n * 25 / 600, n)
    assert x["keys"] == list(range(0, n, 12)) and media.read_payload(content, x) == media.pad(payload)
    assert [p[-1] for p, _, _ in media.walk(memoryview(content))][:3] == [b"ftyp", b"moov", b"mvhd"]
    df = spark.createDataFrame([(1, content), (2, content[:-1]), (3, content[:300]), (4, b""), (5, None), (6, b"text" * 9)], "doc_id long, media binary")
    assert {r.doc_id for r in media.probe_media(df).filter("error is null").collect()} == {1}


def test_media_tables_are_of_one_track():
    """An audio-like first track without sync samples or wide offsets, and a second that has both."""
    import struct

    def track(handler, n, extra, offsets):
        entry = media.box(b"twos", bytes(28)) if handler == b"soun" else media.box(b"raw ", bytes(24), struct.pack(">HH", 16, 12), bytes(50))
        stbl = media.box(b"stbl", media.full(b"stsd", 0, struct.pack(">I", 1), entry), media.full(b"stts", 0, struct.pack(">III", 1, n, 5)), media.full(b"stsc", 0, struct.pack(">IIII", 1, 1, n, 1)), media.full(b"stsz", 0, struct.pack(">II", 4, n)), *extra, offsets)
        mdhd = media.full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, 100 * n, 5 * n, 0, 0))
        return media.box(b"trak", media.box(b"mdia", mdhd, media.full(b"hdlr", 0, bytes(4), handler, bytes(13)), media.box(b"minf", stbl)))

    def build(at):
        first = track(b"soun", 4, [], media.full(b"stco", 0, struct.pack(">II", 1, at)))
        second = track(b"vide", 3, [media.full(b"stss", 0, struct.pack(">III", 2, 1, 3))], media.full(b"co64", 0, struct.pack(">IQ", 1, at + 16)))
        return media.box(b"moov", first, second) + media.box(b"mdat", bytes(range(28)))

    at = len(build(0)) - 28
    sound, video = (media.probe(build(at), k) for k in (0, 1))
    assert (sound["codec"], sound["width"], sound["keys"], sound["starts"], sound["timescale"]) == ("twos", 0, [0, 1, 2, 3], [at, at + 4, at + 8, at + 12], 400)
    assert (video["codec"], video["width"], video["height"], video["keys"], video["starts"]) == ("raw", 16, 12, [0, 2], [at + 16, at + 20, at + 24])
    assert media.read_payload(build(at), video) == bytes(range(16, 28))


# --- language


def test_language_accuracy_and_odd(spark, sf, odd, empty):
    got = queries.op6_language(spark, sf.replace("0.001", "0.01")).join(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    profiles = language.fit_profiles(docs)
    out = {r.doc_id: r for r in language.predict_language(odd, profiles).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3, 7)] == ["und"] * 4 and out[4].lang_pred in profiles and len(out) == 9
    assert language.fit_profiles(empty) == {} and language.predict_language(empty, profiles).count() == 0
    assert {r.lang_pred for r in language.predict_language(odd, {}).collect()} == {"und"}
    again = language.fit_profiles(docs.repartition(7))
    assert all((again[k] == profiles[k]).all() for k in profiles)


def test_language_is_brute_force(spark):
    """Vectors and cosines letter by letter, with scripts whose letters would share places modulo 256."""
    texts = {"el": ["αβγ αβδ", "γαβ, δ"], "ru": ["мир и труд", "труд мира"], "en": ["the cat", "that hat 7"], "zh": ["中文字", "文字中"]}
    rows = [(t, k) for k, ts in texts.items() for t in ts]
    ask = ["αβγδ", "мира труд", "a cat that", "中文字文", "Ünï", "中", "12"]
    letters = language.Letters(256, 7)

    def vector(text):
        places = [0]
        for c in text:
            p = ord(c.lower()) if c.isalpha() else 0
            places += [p] if p or places[-1] else []
        places += [0] if places[-1] else []
        v = [letters.vector(p).astype(int) for p in places]
        return sum((np.roll(a, 2) * np.roll(b, 1) * c for a, b, c in zip(v, v[1:], v[2:], strict=False)), np.zeros(256, int))

    unit = lambda v: v / (np.linalg.norm(v) or 1)
    want = {k: unit(sum(np.rint(10_000 * unit(vector(t))) for t in ts)) for k, ts in texts.items()}
    profiles = language.fit_profiles(spark.createDataFrame(rows, "text string, lang string"), dim=256)
    assert set(profiles) == set(want) and all(np.allclose(profiles[k], want[k]) for k in want)
    got = {r.text: r for r in language.predict_language(spark.createDataFrame([(t,) for t in ask], "text string"), profiles, keep=["text"], dim=256).collect()}
    for t in ask:
        cosines = {k: float(unit(vector(t)) @ want[k]) for k in sorted(want)}
        best = max(cosines, key=cosines.get)
        assert (got[t].lang_pred, round(got[t].score, 9)) == ((best, round(max(cosines[best], 0), 9)) if any(c.isalpha() for c in t) else ("und", 0.0))
    assert [got[t].lang_pred for t in ask[:4]] == ["el", "ru", "en", "zh"]


# --- SimHash


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def plain_components(ids, fps):
    comp = list(range(len(ids)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    arr = np.array(fps, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 3) + i + 1:
            a, b = root(i), root(int(j))
            comp[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        r = root(i)
        known = [x for x in (least.get(r), ids[i]) if x is not None]
        least[r] = min(known) if known else None
    return [least[root(i)] for i in range(len(ids))]


def test_simhash_query(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").toPandas().sort_values("doc_id")
    fps = [plain_fingerprint(t) for t in docs.text]
    comp = plain_components(docs.doc_id.tolist(), fps)
    got = rows_of(queries.op2_simhash(spark, sf.replace("0.001", "0.01")), "doc_id")
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == {d: (f"{f:016x}", c) for d, f, c in zip(docs.doc_id, fps, comp, strict=True)}


@pytest.mark.parametrize("block", [simhash.BLOCK, 16])
def test_simhash_links_are_those_of_brute_force(spark, block):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = []
    for b in base:
        x = int(b)
        for _ in range(40):  # chains, and one dense ball
            x ^= sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), replace=False))
            near.append(x)
    near += [int(base[0]) ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)]
    fps = np.unique(np.array([*map(int, base), *near, 0, (1 << 64) - 1], np.uint64))
    comp = plain_components(list(range(len(fps))), fps.tolist())
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), block)
    place = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges.collect():
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 3
        x, y = root(place[a]), root(place[b])
        parent[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(fps))] == comp


def test_simhash_odd(spark, odd, empty):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(odd).collect()]
    fps = [plain_fingerprint(r[1]) for r in ODD_ROWS]
    comp = plain_components([r[0] for r in ODD_ROWS], fps)
    assert sorted(got, key=repr) == sorted(((r[0], f"{f:016x}", c) for r, f, c in zip(ODD_ROWS, fps, comp, strict=True)), key=repr)
    assert simhash.simhash_groups(empty).count() == 0
