"""Repeated rows, repeated and null ids, clashing columns, empty tables: every operator and stage keeps its word."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm import brute
from tidemark.llm import minhash, mixing, pieces, pii, quality, queries, sstable, substring, suffix, topk, warc

DDL = "doc_id long, text string, lang string, source string, n_chars long, h long, v long, row string, k int, mix_k int, tokens long, numbers string, kept boolean"


def prose(seed: int, n: int = 80) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("etaoinshrdlucm") for _ in range(rnd.randint(2, 9))) for _ in range(n))


A, B, C = prose(1), prose(2), prose(3)
NEAR = A.replace(A.split()[40], "changed")
#: (doc_id, text): equal rows, one id with two texts, null ids with equal and other texts, null and empty texts.
ROWS = [(1, A), (1, A), (1, B), (2, B), (None, A), (None, A), (None, C), (3, None), (3, None), (4, ""), (5, NEAR), (6, C), (6, NEAR + " " + B)]


@pytest.fixture(scope="module")
def docs(spark):
    made = [(d, t, "en", "src1", None if t is None else len(t), 7, 8, "r", 9, 7, 5, "x", True) for d, t in ROWS]
    return spark.createDataFrame(made, DDL).repartition(3)


def counted(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_substring(docs):
    """Every row is a document of its own; rows without an id neither lose nor remove."""
    named = [(i, t) for i, (d, t) in enumerate(ROWS) if d is not None]
    plain = brute.substring(named) | {i: (*brute.substring([(i, t)])[i],) for i, (d, t) in enumerate(ROWS) if d is None}
    want = sorted(((ROWS[i][0], *v) for i, v in plain.items()), key=repr)
    assert counted(substring.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_suffix(docs):
    named = [(d, (t or "").encode()) for d, t in ROWS if d is not None]
    want = []
    for d, t in ROWS:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49) if d is not None else ():
            if any(e < d and b[i : i + 50] in x for e, x in named):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((d, len(b), sum(gone), hashlib.sha256(kept).hexdigest()))
    assert counted(suffix.remove_earlier(docs), "doc_id", "n_bytes", "n_removed", "kept_sha256") == sorted(want, key=repr)


def test_near_duplicates(docs):
    """Links go by text: rows of id 1 lie in two components if their texts do."""
    near = brute.near([(i, t) for i, (d, t) in enumerate(ROWS) if d is not None], 4, 80)
    want = []
    for i, (d, t) in enumerate(ROWS):
        if d is None:
            want.append((d, len(brute.shingles(t, 4)), None, True))
        else:
            c = min(ROWS[j][0] for j, v in near.items() if v[1] == near[i][1])
            want.append((d, near[i][0], c, c == d))
    assert counted(minhash.near_duplicates(docs, 4, 80), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)


def test_keep_first(docs):
    """One row of each component, all rows without an id or without words, all columns as they were."""
    out = minhash.keep_first(docs, 4, 80)
    assert out.columns == docs.columns
    got = counted(out, "doc_id", "text")
    by_text = {t: [d for d, x in got if x == t and d is not None] for t in (A, B, NEAR, NEAR + " " + B)}
    assert by_text[A] + by_text[NEAR] == [1] and by_text[B] == [1] and by_text[NEAR + " " + B] == [6]
    assert sorted(d is None for d, t in got if t in (A, C)) == [False, False, True, True, True] and got.count((3, None)) == 2 and (4, "") in got
    assert counted(out, "h", "v", "row", "k", "kept")[0] == (7, 8, "r", 9, True)


def test_keep_good(docs):
    """Rows are judged one by one; only texts decide."""
    out = quality.keep_good(docs)
    assert out.columns == docs.columns and counted(out, "doc_id", "text") == sorted(((d, t) for d, t in ROWS if t), key=repr)
    assert quality.quality(docs).count() == len(ROWS)


def test_mixture(docs):
    """Each row is read as often as the budget says, with its columns as they were."""
    args = (F.lit("web"), {}, F.lit(10_000))
    out = mixing.selected(docs, *args, max_epochs=2, seed=3)
    assert out.columns == docs.columns and counted(out, "doc_id", "text") == sorted([(d, t) for d, t in ROWS if t] * 2, key=repr)
    assert counted(out, "h", "v", "row", "k", "mix_k", "tokens", "kept")[0] == (7, 8, "r", 9, 7, 5, True)
    total = sum(len((t or "").split()) for _, t in ROWS)
    part = mixing.selected(docs, F.lit("web"), {}, F.lit(total * 3 // 5), max_epochs=1, seed=3)
    assert sum(len(r["text"].split()) for r in part.collect()) == total * 3 // 5
    assert mixing.mix(docs, F.lit("web"), {}, F.lit(500)).count() == len(ROWS)


def test_personal_data_and_pieces(docs, spark):
    assert pii.find_spans(docs).count() == len(ROWS) and counted(pii.mask(docs), "doc_id", "text") == sorted(ROWS, key=repr)
    file = public_tokenizers.path("piece_bpe_32k.model")
    got = pieces.encode(docs, file)
    assert sorted((r["doc_id"] is None, r["n_bytes"]) for r in got.collect()) == sorted((d is None, len((t or "").encode())) for d, t in ROWS)
    assert pieces.encode(docs.filter("false"), file).count() == 0


def test_shards(docs):
    got = counted(sstable.round_trip(docs, public_tokenizers.path("word_bpe_49k.json")), "doc_id", "n_tokens", "start")
    assert sorted(d is None for d, *_ in got) == sorted(d is None for d, _ in ROWS)
    order = sorted(got, key=lambda r: r[2])
    assert [r[0] is None for r in order[:3]] == [True] * 3 and all(a[2] + a[1] == b[2] for a, b in zip(order, order[1:]))


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "x", 0), (1, "u", "x", 0), (None, "u", "x", 0), (None, None, None, 0), (2, "w", "x", 0)], "page_id long, url string, html string, n long")
    got = counted(warc.round_trip(pages), "page_id", "payload_bytes", "record_type", "refers_to")
    assert got == sorted([(1, 1, "revisit", 2), (1, 1, "revisit", 2), (None, 1, "revisit", 2), (None, 0, "response", None), (2, 1, "response", None)], key=repr)


def test_vectors(spark):
    df = spark.createDataFrame([(20, [1.0, 2.0], 1), (20, [1.0, 2.0], 1), (20, [3.0, 0.0], 1), (None, [9.0, 9.0], 1), (7, [1.0, 1.0], 1), (7, [1.0, 1.0], 1)], "vec_id long, embedding array<double>, rank int")
    rows = topk.quantized(df, "vec_id", "embedding", 1)
    got = counted(topk.top_k(rows, rows.filter("id % 20 = 0"), 1), "query_id", "vec_id", "score")
    assert {g[:2] for g in got} == {(20, 7)}


@pytest.mark.parametrize("k", range(len(P.STAGES)))
def test_empty_stages(docs, spark, k):
    out = P.STAGES[k][1](spark, docs.filter("false"), "")
    assert out.count() == 0 and (k == len(P.STAGES) - 1 or out.columns == docs.columns)
