"""The Kneser-Ney model and the importance draw against their definitions, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm import brute
from tidemark.llm import importance, ngrams

DDL = "doc_id long, text string, held_out boolean, shard int, bucket int, rank long, words array<string>, row long"
LOOSE = ("A b c a B c d", "", None, " \t\n ", "é 字 é 字 x1 é", "a", "b b b b b b b b")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    words = [f"w{int(rnd.paretovariate(0.8))}" for _ in range(4_000)]
    out = [(k, " ".join(words[k * 30 : k * 30 + rnd.randint(0, 60)])) for k in range(100)] + [(200 + k, t) for k, t in enumerate(LOOSE)]
    return [*out, (3, "again a row"), (4, out[4][1]), (None, "no id here"), (None, None), (500, " ".join(words) * 20)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, True, 1, 2, 3, ["x"], 4) for d, t in rows], DDL).repartition(4)


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=repr), sorted(want, key=repr)):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_scores(docs, rows, order):
    close([tuple(r) for r in ngrams.score_documents(docs, order).collect()], brute.language_model(rows, order)[0])


def test_many_small_chunks_and_shards(spark, docs, rows, monkeypatch):
    """What is counted, and scored, at a time, and the number of shards change nothing; arrays that cannot be mapped are read."""
    want = brute.language_model(rows, 2)[0]
    monkeypatch.setattr(ngrams, "COUNT_BYTES", 300)
    monkeypatch.setattr(ngrams, "parts", lambda spark: 29)
    close([tuple(r) for r in ngrams.score_documents(docs, 2).collect()], want)
    model = ngrams.trained(docs.filter("doc_id < 50"), 2, 3)
    mapped = ngrams.log_probabilities(model, [b"w1 w2 w1 none"])[0]
    monkeypatch.setattr(ngrams, "_mapped", lambda folder, path, total: np.zeros(0, np.uint64))
    assert (ngrams.log_probabilities(model, [b"w1 w2 w1 none"])[0] == mapped).all()


def test_probabilities_add_up(docs):
    """After any word, known or not, the known words, the end and one unknown word share 1."""
    model = ngrams.trained(docs.filter("doc_id < 80"), 2, 5)
    known = {w for r in docs.filter("doc_id < 80").collect() for w in brute.WORD.findall((r["text"] or "").lower())}
    for before in ("w1", "w2", "never"):
        texts = [f"{before} {w}".encode() for w in [*sorted(known), "unknown"]] + [before.encode()]
        logs, _, sizes = ngrams.log_probabilities(model, texts)
        ends = np.cumsum(sizes)
        second = [logs[e - n + 1] for e, n in zip(ends, sizes)]
        assert math.isclose(sum(10**x for x in second), 1, rel_tol=1e-9)


def test_held_out_documents_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = ngrams.score_documents(docs).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_blocks():
    rnd = np.random.default_rng(1)
    words = rnd.integers(0, 2**63, 50, dtype=np.uint64)[rnd.integers(0, 50, (400, 3))]
    got, stats = ngrams.unpack(ngrams.pack(words, [np.arange(400, dtype=np.uint64), np.full(400, 2**40, np.uint64)]))
    assert sorted(map(tuple, np.column_stack([got, stats[0]]).tolist())) == sorted(map(tuple, np.column_stack([words, np.arange(400, dtype=np.uint64)]).tolist())) and (stats[1] == 2**40).all()


def test_nothing_to_learn(spark, docs):
    assert ngrams.score_documents(docs.filter("false")).count() == 0
    held = next(d for d in range(5, 100) if zlib.crc32(str(d).encode()) % 5 == 1)
    got = ngrams.score_documents(docs.filter(f"doc_id = {held}")).collect()
    assert [(r["train_tokens"], r["n_known"], r["score"]) for r in got] == [(0, 0, 0.0)]


def plain_draw(rows, target, percent=5, seed=42):
    term = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: term.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    runs = lambda w: [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    docs = [(d, words(t)) for d, t in rows]
    s, t = Counter(b for _, w in docs for b in runs(w)), Counter(b for x in target for b in runs(words(x)))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (t_s + 10_000) / ((s[b] + 1) * (t_t + 10_000))))
    t_s, t_t = sum(s.values()), sum(t.values())
    out = []
    for d, w in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, runs(w)))
        out.append([d, len(runs(w)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((x for x, (_, w) in zip(out, docs) if len(w) >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for k, x in enumerate(may[: percent * len(may) // 100]):
        x[4] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_draw(spark, docs, rows, percent):
    target = ["w1 w2 w3 W4 x", None, "", "é 字 é w1"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, bench, percent)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_draw(rows, target, percent)


def test_draw_from_nothing(spark, docs, rows):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(docs.filter("false"), none).count() == 0
    assert sorted((tuple(r) for r in importance.resample(docs, none, 100).collect()), key=repr) == plain_draw(rows, [], 100)
