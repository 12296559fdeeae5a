"""The prefix trie against its definition, in small blocks and with odd rows."""

import random

import pytest

from tests.llm import brute
from tidemark.llm import prefixes

DDL = "conv_id long, turn long, role string, text string, d long, ka long, path string, n_convs int"


def made(seed: int, n: int, ids: range) -> list:
    rnd = random.Random(seed)
    out = []
    for c in rnd.sample(list(ids), n):
        for k in range(rnd.choice([1, 2, 3, 5, 9])):
            out.append((c, rnd.choice([k, k, k, None, 3]), rnd.choice(["user", "user", None]), rnd.choice(["a b", "a b", "c", "", None, "d é 字"])))
    return out + out[:3]


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], DDL).repartition(3)
    got = sorted((tuple(r) for r in prefixes.trie(df).collect()), key=repr)
    assert got == sorted(brute.trie(rows), key=repr)


def test_trie_in_small_blocks(spark, monkeypatch):
    """Blocks, ranges and broadcasts of a few rows: everything is carried on; negative ids, ties, nulls, equal rows, columns named like the operator's own."""
    monkeypatch.setattr(prefixes, "BLOCK", 3)
    monkeypatch.setattr(prefixes, "RANGE_BITS", 3)
    monkeypatch.setattr(prefixes, "HOT", 20)
    rows = made(1, 120, range(-60, 200)) + [(400, k, "user", f"t {k % 7}") for k in range(50)] + [(401, k, "user", f"t {k % 7}") for k in range(40)]
    check(spark, rows + [(None, 1, "user", "lost"), (2**62, None, None, None)])


def test_trie_at_its_edges(spark):
    """One turnless conversation; all equal; empty; ids without a long conversation."""
    lonely = next(c for c in range(1, 200) if c % 20 and __import__("zlib").crc32(str(c).encode()) % 4 == 3)
    check(spark, [(lonely, 1, "user", "x")])
    check(spark, [(c, 1, "user", "same words here") for c in range(60)])
    check(spark, [(None, 1, "user", "x")])
    assert prefixes.trie(spark.createDataFrame([], DDL)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_trie_of_the_table(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, prefixes.trie(df).collect()), key=repr) == sorted(brute.trie(rows), key=repr)
