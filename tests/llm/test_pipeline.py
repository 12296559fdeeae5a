"""Each stage of the pipeline on its own input, and the whole run."""

import corpus_pipeline as P
from tidemark.llm import pii, pieces, quality
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = {r["doc_id"]: r for r in docs.collect()}
    good = P.good(spark, docs, SF)
    kept = {r["doc_id"] for r in good.collect()}
    assert kept == {r["doc_id"] for r in quality.quality(docs).filter("kept").collect()}

    first = P.first_of_near_duplicates(spark, good, SF)
    near = brute.near([(d, start[d]["text"]) for d in kept], 5, 80)
    assert {r["doc_id"] for r in first.collect()} == {d for d, (_, _, k) in near.items() if k}

    clean = P.without_personal_data(spark, first, SF)
    assert clean.columns == docs.columns and clean.count() == first.count()
    assert not any(brute.personal(r["text"]) for r in clean.collect())

    mixed = P.mixture(spark, clean, SF)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    words = lambda t: brute.WORD.findall(t or "")
    total = sum(map(len, map(words, texts.values())))
    got = mixed.collect()
    assert mixed.columns == docs.columns and sum(len(words(r["text"])) for r in got) == total * P.MIX_PERCENT // 100
    assert all(words(texts[r["doc_id"]])[: len(words(r["text"]))] == words(r["text"]) for r in got)

    ids = P.token_ids(spark, mixed, SF).collect()
    voc = pieces.load(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    assert len(ids) == len(got) and all(r["round_trip"] for r in ids)
    want = sorted((r["doc_id"], [i for w in pieces.split_marked(r["text"]) for i in pieces.fold_word(w, voc)]) for r in got)
    assert sorted((r["doc_id"], r["ids"]) for r in ids) == want
    assert pii.KINDS and len(P.STAGES) == 5
