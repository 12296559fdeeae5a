"""The numbered operators against plain versions, round trips and SQL, on small tables with the odd cases."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import minhash, mixing, pieces, pii, quality, queries, sstable, substring, suffix, topk, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, b string, part int"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh é字") for _ in range(rnd.randint(1, 5))).replace(" ", "x")
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(120), text(60)
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, base), (6, base), (7, base.replace(" ", "\n", 5) + " tail"), (8, text(50) + " " + passage + " " + text(30)), (9, passage + "\n" + text(40)), (10, passage + " " + passage)]
    out += [(11, text(20_000)), (12, "same line here\n" * 40), (13, "x" * 5_000), (14, "a b c d e f g h i j k"), (15, "A B c d E f g h i J k"), (16, "##$ %& |<> * " + text(12))]
    near = base.split()
    out += [(20 + k, " ".join([*near[:k], f"w{k}", *near[k + 1 :]])) for k in range(12)]
    out += [(40, "mail a.b+c@ex-ample.co.uk, 10.0.0.255 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111 +1 (555) 010-9999 +12 x@y @a.b"), (41, "call (555) 010-1234 or 555-010-4321.")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = [(d, t, ("en", "de", None)[d % 3], ("src0", "src1", "src2", None)[d % 4], None if t is None else len(t), "clash", d % 5) for d, t in rows]
    return spark.createDataFrame(made, DOCS).repartition(4)


def of(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_quality(docs, rows, spark):
    got = quality.quality(docs)
    assert of(got, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == brute.quality(rows)
    kept = {d for (d,) in got.filter("kept").select("doc_id").collect()}
    assert {5, 8, 11} <= kept and not kept & {1, 2, 3, 4, 12, 13}
    assert quality.keep_good(docs).columns == docs.columns and quality.quality(empty(spark)).count() == 0


def test_bands():
    import zstandard

    z = zstandard.ZstdCompressor(level=quality.LEVEL)
    rnd = random.Random(1)
    assert not quality.band_verdict(b"abc " * 5_000, z)[3]
    assert not quality.band_verdict(rnd.randbytes(20_000), z)[3]
    prose = " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(5)) for _ in range(3_000)).encode()
    assert quality.band_verdict(prose, z)[3]
    assert not quality.band_verdict(prose[:9_000] + b"spam " * 4_000, z)[3]


def test_bands_of_short_text():
    """Below 200 bytes, too: repeats are rejected at any length, base64 from 130 bytes on, prose never."""
    import base64

    import zstandard

    z, rnd = zstandard.ZstdCompressor(level=quality.LEVEL), random.Random(8)
    prose = b"The clerk wrote down every parcel that left the yard before noon, and whoever asked later could read who had carried it, where it went and what the weather was like on the road that day."
    for n in range(40, len(prose) + 1):
        assert quality.band_verdict(prose[:n], z)[3], n
        if n > 100:
            assert not quality.band_verdict((b"buy now " * 40)[:n], z)[3], n
        if n >= 130:
            assert not any(quality.band_verdict(base64.b64encode(rnd.randbytes(n))[:n], z)[3] for _ in range(20)), n


def test_bands_of_encoded_text():
    """Base64 and random letters and digits are rejected from 200 bytes on, also behind the last whole chunk; prose is not."""
    import base64
    import string

    import zstandard

    z, rnd = zstandard.ZstdCompressor(level=quality.LEVEL), random.Random(6)
    alphabet = string.ascii_letters + string.digits
    chars = lambda n: "".join(rnd.choices(alphabet, k=n)).encode()
    words = lambda n: b" ".join(chars(rnd.randint(3, 10)) for _ in range(n // 4))[:n]
    for n in (200, 299, 300, 499, 500, 699, 700, 999, 1_000, 1_999, 2_000, 3_999, 4_000, 8_000, 16_000, 40_000):
        whole = base64.b64encode(rnd.randbytes(n))[:n]
        lines = base64.encodebytes(rnd.randbytes(n))[:n]
        assert not any(quality.band_verdict(x, z)[3] for x in (whole, lines, chars(n), words(n)))
    prose = " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(5)) for _ in range(3_000)).encode()
    assert all(quality.band_verdict(prose[:n], z)[3] for n in (200, 500, 1_000, 4_096, 4_396, 8_000, 16_000))
    assert quality.band_verdict(prose[: 2 * 4_096] + words(4_000), z)[1:] == (3, 1, False)


def test_substring(docs, rows, spark):
    got = substring.remove_repeats(docs)
    assert of(got, "n_words", "n_removed", "kept_sha256") == brute.substring(rows)
    assert substring.remove_repeats(empty(spark)).count() == 0


def test_suffix(docs, rows, spark):
    got = suffix.remove_earlier(docs)
    assert of(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix(rows)
    assert suffix.remove_earlier(empty(spark)).count() == 0


def test_doubling_ranks():
    rnd = np.random.default_rng(2)
    data = rnd.integers(97, 100, 4_000).astype(np.uint8)
    starts = np.arange(4_000 - 50)
    ranks = suffix.double(data, starts, 50)
    seen = {}
    for s, r in zip(starts, ranks):
        assert seen.setdefault(int(r), data[s : s + 50].tobytes()) == data[s : s + 50].tobytes()
    assert len(seen) == len({data[s : s + 50].tobytes() for s in starts})


@pytest.mark.parametrize(("width", "percent"), [(4, 80), (5, 80)])
def test_near_duplicates(docs, rows, spark, width, percent):
    got = minhash.near_duplicates(docs, width, percent)
    assert of(got, "n_shingles", "component_id", "kept") == brute.near(rows, width, percent)
    assert minhash.near_duplicates(empty(spark)).count() == 0
    assert minhash.keep_first(docs).columns == docs.columns


def test_near_duplicate_chain(spark):
    """A chain whose ends share nothing is one component, whatever block its members fall in."""
    words = [f"w{k}" for k in range(900)]
    chain = [(k, " ".join(words[k * 4 : k * 4 + 120])) for k in range(190)]
    got = minhash.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), 4, 80)
    assert of(got, "n_shingles", "component_id", "kept") == brute.near(chain)


def test_bit_estimate(spark):
    """The estimate from low bits is close to the true similarity."""
    rnd = np.random.default_rng(4)
    for shared in (200, 800):
        a = rnd.integers(0, 2**63, 1_000).astype(np.uint64)
        b = np.concatenate([a[:shared], rnd.integers(0, 2**63, 1_000 - shared).astype(np.uint64)])
        x, y = (minhash.pack(minhash.minima([s])).view(np.int64)[0].tolist() for s in (a, b))
        got = spark.createDataFrame([(x, y)], "x array<long>, y array<long>").select(minhash.estimate("x", "y")).first()[0]
        assert abs(got - shared / (2_000 - shared)) < minhash.MARGIN


def test_personal_data(docs, rows, spark):
    got = {r["doc_id"]: r for r in pii.find_spans(docs).collect()}
    for doc_id, text in rows:
        base = brute.personal(text)
        assert got[doc_id]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(got[doc_id]["spans"].split(",")) | {""}
    assert got[41]["n_added"] == 2  # numbers without a country code
    masked = {r["doc_id"]: r for r in pii.mask(docs).collect()}
    assert "@ex-ample" not in masked[40]["text"] and "<email>" in masked[40]["text"] and masked[1]["text"] is None
    assert masked[11]["text"] == dict(rows)[11] and pii.find_spans(empty(spark)).count() == 0


def test_field_on_held_out_rows():
    field = pii.train()
    data = pii.labelled_rows(400, seed=99)
    labels = field.decode([field.scores(pii.features(w, before, after)) for w, _, before, after in data])
    right = [pii.LABELS[y] == t for (_, tags, *_), ys in zip(data, labels) for t, y in zip(tags, ys)]
    assert sum(right) / len(right) > 0.95


#: Sentences of another hand than the generator's, with what a reader would mark.
MARKED = (
    ("Please call 5550101234 before noon.", [("phone", "5550101234")]),
    ("Her mobile 0171 5550199 rings all day", [("phone", "0171 5550199")]),
    ("Reach us at (555) 010-7788, any time", [("phone", "(555) 010-7788")]),
    ("Fax 555-010-4321.", [("phone", "555-010-4321")]),
    ("tel. 555.010.9876 or write ann_lee@mail.example", [("phone", "555.010.9876"), ("email", "ann_lee@mail.example")]),
    ("ping 10.1.2.3 from the gateway", [("ip", "10.1.2.3")]),
    ("Charge card 4111-1111-1111-1111 please", [("card", "4111-1111-1111-1111")]),
    ("In 1984 about 12,500 people of 3 towns left", []),
    ("See page 214 of chapter 12, version 3.14.2", []),
    ("The train at 10:45 took 3 hours and 20 minutes", []),
    ("Order 7731 costs $129.99 until 2021-05-06", []),
    ("Room 101 holds 250 people, 95% of them seated", []),
    ("The year 2019 saw 1000000 visitors", []),
    ("Isotope C14 and model X200 of 1999", []),
    ("https://site.example.net/a/12345 has 42 links", []),
    ("Follow @someone on the 4th of July 1776", []),
    ("ISBN 978-3-16-148410-0 in the catalogue", []),
    ("x" * 60 + "1 and " + "y1" * 40, []),
)


def test_field_on_marked_sentences(spark):
    """Precision and recall on sentences that the generator did not write."""
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(MARKED)], "doc_id long, text string")
    found = {(r["doc_id"], *s.split(":")) for r in pii.find_spans(df).collect() for s in r["spans"].split(",") if s}
    want = {(i, kind, str(t.index(x)), str(t.index(x) + len(x))) for i, (t, xs) in enumerate(MARKED) for kind, x in xs}
    assert len(found & want) / len(want) >= 0.9 and len(found & want) / len(found) >= 0.9


def test_shards(docs, rows, spark, tmp_path):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    tok, start, want = Tokenizer.from_file(file), 0, {}
    for d, t in sorted(rows):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert of(sstable.round_trip(docs, file), "start", "n_tokens", "ids_crc32") == want
    assert sstable.round_trip(empty(spark), file).count() == 0


def test_shard_lookup():
    shard, stored = sstable.Shard(2), {}
    for d in [None, -5, -5, *range(0, 60_000, 7)]:
        value = np.arange((d or 0) % 50, dtype="<u2")
        stored.setdefault(d, []).append(value)
        shard.add(sstable.key_of(d), value.tobytes())
    data = shard.finish()
    reader = sstable.Reader(data)
    assert len(reader.first) > 1
    for d in (None, -5, 0, 7, 700, 59_997):
        assert [x.tolist() for x in reader.lookup(d)] == [x.tolist() for x in stored[d]]
    assert not any(reader.lookup(d) for d in (1, 8, -1, 10**9))
    with pytest.raises(ValueError):
        sstable.Reader(data[:-60] + b"x" + data[-59:])


def test_shard_lookup_table(docs, spark, tmp_path):
    """Looking ids up gives what a scan gives, repeated and null ids included, and nothing for ids that are not there."""
    file = public_tokenizers.path("word_bpe_49k.json")
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(7, "again"), (None, "no id"), (-3, "minus")], "doc_id long, text string"))
    shards = sstable.write_shards(more, str(tmp_path / "sst"), file)
    stored = {}
    for r in sstable.read_shards(spark, str(tmp_path / "sst"), shards).collect():
        stored.setdefault(r["doc_id"], []).append(r["ids"])
    wanted = spark.createDataFrame([(i,) for i in (None, -3, 1, 7, 7, 11, 26, 999)], "doc_id long")
    got = {}
    for r in sstable.lookup(spark, str(tmp_path / "sst"), shards, wanted).collect():
        got.setdefault(r["doc_id"], []).append(r["ids"])
    norm = lambda d: {k: sorted(v) for k, v in d.items()}
    assert len(stored[7]) == 2 and norm(got) == norm({k: v for k, v in stored.items() if k in (None, -3, 1, 7, 11, 26)})


def test_ids_of_the_library(spark):
    """Whatever the characters, ids are those of the tokenizers library, also when the kept words change."""
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(file)
    odd = ["it's THEY'RE we'll 'sup o'clock''s", "ÀÉÎ ñandú İstanbul ſharp ŉ ª º µ ²³ ¼x x²y", "a\u0301b e\u0301", "x\u00a0y z\u2003w", "<|endoftext|> <|ENDOFTEXT|> a<|b", "Ünïcödé,ends. 3.14, v2.0.1 $$$%%% ...", "字a字1 ΣΑΣ ΟΔΟΣ ǅ ﬁ Ａ", "\u00ad\u00d7\u00f7 don't;can't!"]
    odd += [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for cache in (sstable.CACHE, 50):
        sstable._caches.clear()
        old, sstable.CACHE = sstable.CACHE, cache
        try:
            got = [np.frombuffer(x, "<u2").tolist() for x in sstable.encode_texts(odd, file, "<u2")]
        finally:
            sstable.CACHE = old
        assert got == [e.ids for e in tok.encode_batch(odd, add_special_tokens=False)]


def test_warc(spark):
    made = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "http://d e", ""), (5, "u", "é\r\n\r\nz"), (6, "u", "y" * 200_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in made], "page_id long, url string, html string, payload string")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert {k: (v["payload_bytes"], v["payload_digest"]) for k, v in got.items()} == {i: (len((h or "").encode()), warc.sha1_base32((h or "").encode())) for i, _, h in made}
    assert {k: (v["record_type"], v["refers_to"]) for k, v in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert warc.round_trip(pages.filter("false")).count() == 0


def test_warc_long_urls(spark):
    """Pages come back whatever the length of their url, also as the stored response of a revisit."""
    made = [(1, "http://a", "<p>x</p>"), (2, "data:" + "x y" * 33_332, "<p>x</p>"), (3, "u" * 100_000, "z")]
    pages = spark.createDataFrame(made, "page_id long, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert got == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None)}
    for _, url, html in made:
        record, end = warc.parse_record(data := warc.encode_record("r", url, html.encode()), 0)
        assert end == len(data) and record["uri"] == url.replace(" ", "%20")


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    """Damage costs the record it hits; all bytes are in a record or in a gap."""
    wrap = warc.gzip_member if packed else bytes
    parts = [wrap(warc.encode_record(f"r{k}", "u", f"body {k} WARC/1.1\r\n".encode() * 20)) for k in range(6)]
    data = bytearray(b"junk" + b"".join(parts) + parts[0][:30])
    data[4 + len(parts[0]) + len(parts[1]) // 2] ^= 0xFF
    found = list(warc.salvage(bytes(data)))
    assert [x[2]["record_id"] for x in found if x[0] == "record"] == ["r0", "r2", "r3", "r4", "r5"]
    gaps = [(at, x[0]) for kind, at, x in found if kind == "gap"]
    assert gaps == [(0, 4), (4 + len(parts[0]), len(parts[1])), (len(data) - 30, 30)]


def test_pieces(docs, rows, spark):
    file = public_tokenizers.path("piece_bpe_32k.model")
    voc = pieces.load(file)
    got = {r["doc_id"]: r for r in pieces.encode(docs, file, one_in=200).collect()}
    for doc_id, text in rows:
        assert got[doc_id]["ids"] == [i for w in pieces.split_marked(text or "") for i in pieces.fold_word(w, voc)]
        assert got[doc_id]["round_trip"]
    back = {r["doc_id"]: r["text"] for r in pieces.decode(spark.createDataFrame([(k, v["ids"]) for k, v in got.items()], "doc_id long, ids array<int>"), file).collect()}
    assert back == {d: t or "" for d, t in rows}


def test_members_of_many_records():
    """Whole-file archives: all records of a whole member, those before the damage of a cut one, in time that grows with the bytes."""
    import time

    record = lambda k: warc.encode_record(f"urn:r:{k}", "u", f"body {k} ".encode() * 50)
    names = lambda data: [x[2]["record_id"] for x in warc.salvage(data) if x[0] == "record"]
    whole = warc.gzip_member(b"".join(map(record, range(5))))
    assert names(whole) == [f"urn:r:{k}" for k in range(5)] and names(whole + whole) == names(whole) * 2
    long = warc.gzip_member(b"".join(map(record, range(200))))
    for cut in (len(long) // 2, len(long) - 4):
        found = list(warc.salvage(long[:cut] + whole))
        got = [x[2]["record_id"] for x in found if x[0] == "record"]
        kept = len(got) - 5
        assert kept > 50 and got == [f"urn:r:{k}" for k in (*range(kept), *range(5))]
        assert [(at, x[0]) for kind, at, x in found if kind == "gap"] == [(0, cut)]
    bad = warc.gzip_member(record(0) + record(1)[:-30] + b"x" * 30 + record(2))
    found = list(warc.salvage(bad))
    assert [x[2]["record_id"] for x in found if x[0] == "record"] == ["urn:r:0", "urn:r:2"] and [x[0] for x in found] == ["record", "gap", "record"]
    assert found[1][2][0] == len(record(1)) and found[1][2][2] == len(record(0))
    took = []
    for n in (2_000, 8_000):
        data = b"".join(warc.gzip_member(record(k)) for k in range(n))
        began = time.process_time()
        assert len(names(data)) == n
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0]


def test_damaged_archives_as_a_table(spark, tmp_path):
    """The table has the records that can be read and a row for each gap."""
    folder = str(tmp_path / "warc")
    rows = spark.createDataFrame([(f"urn:page:{k}", "u", bytearray(f"body {k}".encode() * 30), None) for k in range(20)], "record_id string, uri string, payload binary, refers_to string").repartition(2)
    files = warc.write_archives(rows, folder)
    name = sorted(r["file"] for r in files.collect())[0]
    data = bytearray((tmp_path / "warc" / name).read_bytes())
    data[len(data) // 2] ^= 0xFF
    (tmp_path / "warc" / name).write_bytes(bytes(data))
    got = warc.read_archives(spark, folder, files).collect()
    assert sum(r["kind"] == "record" for r in got) == 19 and {r["file"] for r in got if r["kind"] == "gap"} == {name}
    assert all(r["reason"] and r["payload_bytes"] > 0 for r in got if r["kind"] == "gap")


@pytest.fixture(scope="module")
def unigram_file(tmp_path_factory):
    file = tmp_path_factory.mktemp("model") / "unigram.model"
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        file.write_bytes(pieces.as_unigram(f.read()))
    return str(file)


def test_lattice_is_best_path(spark, unigram_file):
    """With a unigram model the relational fold gives the best-scoring split of every word, found here by trying all."""
    voc = pieces.load(unigram_file)
    assert voc.unigram
    words = [pieces.MARK + w for w in ("lower", "é字x", "aaa", "running", "q")]

    def splits(w):
        if not w:
            yield 0.0, []
        for k in range(1, len(w) + 1):
            p = w[:k]
            if p in voc.ids or k == 1:
                for s, rest in splits(w[k:]):
                    yield s + voc.scores.get(p, voc.fallback), [p, *rest]

    table = pieces.piece_table(spark, voc)
    got = {r["word"]: r["ids"] for r in pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), table, voc).collect()}
    for w in words:
        best = max(s for s, _ in splits(w))
        assert got[w] == pieces.fold_word(w, voc)
        assert sum(voc.scores.get(p, voc.fallback) for p in pieces.best_split(w, voc)) == best


def test_best_paths_of_the_library(spark, unigram_file):
    """With a unigram model the ids are those of the library, of whole texts and of words in the relational fold."""
    import sentencepiece

    lib, voc = sentencepiece.SentencePieceProcessor(model_file=unigram_file), pieces.load(unigram_file)
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(9_000, "\U0001f600 字x  zzzq qqq"), (9_001, "ab" * 300)], "doc_id long, text string"))
    want = {r["doc_id"]: lib.encode(r["text"] or "") for r in texts.collect()}
    assert {r["doc_id"]: r["ids"] for r in pieces.encode(texts, unigram_file, one_in=2_000).collect()} == want
    assert {r["doc_id"]: r["ids"] for r in pieces.encode(texts, public_tokenizers.path("piece_bpe_32k.model"), best_path=True).collect()} == want
    words = sorted({pieces.MARK + w for r in texts.limit(40).collect() for w in (r["text"] or "").split(" ") if w})
    got = {r["word"]: r["ids"] for r in pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), pieces.piece_table(spark, voc), voc).collect()}
    assert got == {w: lib.encode(w[1:]) for w in words}


def test_pieces_of_the_library(docs, rows, spark):
    """The ids are those of the sentencepiece library, of texts and of words in the relational fold."""
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    lib, voc = sentencepiece.SentencePieceProcessor(model_file=file), pieces.load(file)
    more = [(100, "the model is running lower  than   the others "), (101, " baaa" + " " * 70 + "x"), (102, "supercalifragilistic" * 400), (103, "a\u2581b \U0001f600\x07 字字")]
    texts = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    texts = texts.union(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1_000, "text"))
    want = {r["doc_id"]: lib.encode(r["text"] or "") for r in texts.collect()}
    assert {r["doc_id"]: r["ids"] for r in pieces.encode(texts, file, one_in=500).collect()} == want
    words = sorted({pieces.MARK + w for r in texts.limit(150).collect() for w in (r["text"] or "").split(" ") if 0 < len(w) < 24})
    got = {r["word"]: r["ids"] for r in pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), pieces.piece_table(spark, voc), voc).collect()}
    assert got == {w: lib.encode(w[1:]) for w in words}


def test_mixing(docs, rows, spark):
    got = mixing.mix(docs, queries.domain_of(F.col("source")), queries.MIX_WEIGHTS, F.expr("total * 80 div 100"), 4, 17).collect()
    total = sum(len(brute.WORD.findall(t or "")) for _, t in rows)
    assert len(got) == len(rows) and sum(r["tokens"] * r["full"] + r["part"] for r in got) == total * 80 // 100
    assert mixing.mix(empty(spark), F.lit("web"), {}, F.expr("total * 80 div 100")).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "s1", 10), ("a", "x", "s2", 1_000), ("b", "x", "s3", 1_000)], "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["share"] for r in mixing.budgets(leaves, {}, F.lit(400), 1).collect()}
    assert got == {"s1": 10, "s2": 190, "s3": 200}


def test_top_k(spark):
    rnd = random.Random(5)
    data = [(i, [rnd.choice((-1.0, 0.25, 0.5, 0.75, 1.0)) for _ in range(6)]) for i in range(300)]
    data += [(301, None), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (305, [])]
    df = spark.createDataFrame([(*r, "clash") for r in data], "vec_id long, embedding array<float>, rank string")
    vecs = topk.quantized(df, "vec_id", "embedding", 64)
    got = [tuple(r) for r in topk.top_k(vecs, vecs.filter("id % 20 = 0"), 20).select("query_id", "rank", "vec_id", "score").collect()]
    ints = {i: [int(np.floor(64 * x)) for x in v] for i, v in data[:300]}
    want = []
    for q in range(0, 300, 20):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:20]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(vecs.filter("false"), vecs.filter("false")).count() == 0


def test_search_stops_early():
    """Lists are left when the bound says so, with a floor at once; results are those of scoring all."""
    rng = np.random.default_rng(3)
    rows = rng.integers(-20, 21, (5_000, 8)) * (rng.random((5_000, 1)) < 0.02) + rng.integers(-2, 3, (5_000, 8))
    ids, queries = rng.permutation(5_000), rows[:6] * 2
    want = [np.sort(rows @ q)[::-1][:5].tolist() for q in queries]
    read: list[int] = []
    got = [s.tolist() for _, _, s in topk.threshold_search(rows, ids, queries, -1 - np.arange(6), 5, read=read)]
    assert got == want and read[0] < 2_500
    over = np.array([w[0] + 10**6 for w in want])
    assert [len(s) for _, _, s in topk.threshold_search(rows, ids, queries, -1 - np.arange(6), 5, over, read)] == [0] * 6 and read[1] == 0


def test_large_numbers(spark):
    """Products beyond 64 bits are exact; what does not fit in a score or a component raises."""
    rows = np.array([[10**13, 3], [10**13, 4], [-(10**13), 1], [5, 5]])
    got = list(topk.threshold_search(rows, np.array([1, 2, 3, 4]), np.array([[10**13, 10**13]]), np.array([9]), 3))
    assert [int(x) for x in got[0][2]] == [10**26 + 4 * 10**13, 10**26 + 3 * 10**13, 10**14] and got[0][1].tolist() == [2, 1, 4]
    far = spark.createDataFrame([(20, [1e17]), (1, [1e17])], "vec_id long, embedding array<double>")
    vecs = topk.quantized(far, "vec_id", "embedding", 64)
    with pytest.raises(Exception, match="int64|large|overflow"):
        topk.top_k(vecs, vecs.filter("id = 20")).collect()
    with pytest.raises(Exception, match="does not fit"):
        topk.quantized(far.withColumn("embedding", F.array(F.lit(1e300))), "vec_id", "embedding", 64).collect()


def test_blocks_with_floors(spark, monkeypatch):
    """Many blocks of rows and queries, repeated query ids included, give what one block gives."""
    rnd = random.Random(6)
    data = [(i if i % 7 else 20, [rnd.randint(-9, 9) for _ in range(4)], 4) for i in range(400)]
    df = spark.createDataFrame(data, "id long, vec array<long>, dim int")
    run = lambda: sorted(map(tuple, topk.top_k(df, df.filter("id % 20 = 0"), 5).collect()))
    one = run()
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 10)
    assert run() == one


def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    out = duck().execute(queries.oracle_sql()[name])
    order = [[d[0] for d in out.description].index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in out.fetchall())
