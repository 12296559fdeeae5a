"""Greedy quotas, placebo slots and replays against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cases, masking, memory, replay


def plain_quota(rows, kinds, targets, total, required):
    """The same over all rows: a queue of conditions, each asked for its best row until it is content."""
    parts, out = sum(targets.values()), []
    queue = [(name, f, None) for name, f in required.items()]
    queue += [(f"stratum:{s}", lambda r, s=s: r["stratum"] == s, round(n * total / parts)) for s, n in targets.items()] + [("rest", lambda r: True, total)]
    for reason, fits, quota in queue:
        content = False
        while not content and len(out) < total and (quota is None or sum(fits(r) for r, _ in out) < quota):
            took = [r for r, _ in out]
            ranked = sorted((sum(all(r[k] != t[k] for t in took) for k in kinds), all(abs(r["number"] - t["number"]) != 1 for t in took), r["key"]) for r in rows if fits(r) and r not in took)
            content = quota is None or not ranked
            if ranked:
                out.append((next(r for r in rows if r["key"] == ranked[-1][2]), reason))
    return [(r["key"], reason, k) for k, (r, reason) in enumerate(out, 1)]


@pytest.mark.parametrize("total", [1, 9, 40, 200])
def test_diverse_quota(spark, total):
    """The same rows in the same order as the greedy over all rows: required ones first, quotas met, what is missing made up."""
    rnd = random.Random(total)
    rows = [{"key": k, "number": k // 2, "stratum": rnd.choice(["a", "a", "b", "c"]), "u": rnd.choice([None, "1", "2"]), "v": rnd.choice(["x", "y", "z", "w"]), "q": rnd.random() < 0.02} for k in range(150)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "key long, number long, stratum string, u string, v string, q boolean").repartition(5)
    targets = {"c": 3, "a": 1, "none": 2, "b": 2}
    got = cases.diverse_quota(df, "key", "number", "stratum", ["u", "v"], targets, total, {"seldom": F.col("q"), "never": F.col("v") == "?"})
    assert [tuple(r) for r in got.orderBy("place").collect()] == plain_quota(rows, ["u", "v"], targets, total, {"seldom": lambda r: r["q"], "never": lambda r: False})
    with pytest.raises(ValueError, match="too many combinations"):
        cases.diverse_quota(df, "key", "number", "stratum", ["u", "v"], targets, total, most=3)


def test_placebo_slots(spark):
    rows = spark.createDataFrame([("a", p, f"S{p:03d}") for p in (1, 3, 5, 8, 9)], "e string, p long, id string")
    targets = spark.createDataFrame([("a", 4, "S004"), ("a", 6, "S006"), ("a", 7, "S007")], "e string, p long, id string")
    got = {r["slot"]: r["donor"] for r in masking.placebo_slots(targets, rows, ["e"], "p", "id").collect()}
    assert got == {"S004": "S003", "S006": "S005", "S007": "S008"}
    with pytest.raises(Exception, match="no unused donor"):
        masking.placebo_slots(targets, rows.limit(1), ["e"], "p", "id").collect()


def test_replay_finds_what_is_planted(spark):
    """Differences of each kind, an orphan, and nothing for snapshots that agree; a month without changes counts too."""
    ddl = "entity string, path string, op string, value string, month int, seq int, source string"
    changes = spark.createDataFrame([("t", "p", "create", "a", 1, 1, "e1"), ("t", "p", "update", "b", 4, 2, "e2"), ("t", "q", "set_pending", "z", 2, 3, "e1"), ("t", "r", "create", "r", 3, 4, "lost"), (None, "p", "create", "n", 1, 5, "e1")], ddl)
    instances = spark.createDataFrame([("t", "e1"), ("t", "e2")], "entity string, source string")
    good = [("t", 2, "p", "a", "current"), ("t", 3, "p", "a", "current"), ("t", 3, "r", "r", "current"), ("t", 9, "p", "b", "current"), ("t", 9, "r", "r", "current")]
    run = lambda rows: sorted(tuple(r) for r in replay.replay_audit(changes, spark.createDataFrame(rows, "entity string, month int, path string, value string, status string"), instances).collect())
    orphan = ("t", "r", 3, "orphan_update")
    assert run(good) == [orphan]
    bad = [("t", 2, "p", "x", "current"), ("t", 3, "p", "a", "stale"), ("t", 9, "p", "b", "current"), ("t", 9, "r", "r", "current"), ("t", 9, "s", "s", "current")]
    assert run(bad) == sorted([("t", "p", 2, "value_differs"), ("t", "p", 3, "status_differs"), ("t", "r", 3, "missing_in_snapshot"), ("t", "s", 9, "unknown_path"), orphan])
    taken = spark.createDataFrame([("t", 2), ("t", 3), ("t", 9)], "entity string, month int")
    lost = replay.snapshot_differences(changes, spark.createDataFrame(good[1:], "entity string, month int, path string, value string, status string"), taken=taken)
    assert [tuple(r) for r in lost.collect()] == [("t", "p", 2, "missing_in_snapshot")]  # a snapshot without any row left
    assert replay.effective_cell([]) is None and replay.effective_cell([memory.Cell("v", "pending", 0.5, 1, None, None, None)]) is None
