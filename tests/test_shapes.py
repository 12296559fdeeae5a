"""Slots, deep texts, sequences and clashing names against plain versions and expectations by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import joins, projections, sets, windows
from tidemark.operators._stage import staged
from tidemark.sources import files


def plain_slots(rows, most):
    """By search: the first slot that is free, late enough, and leaves one for each row behind; else the floor or the slot before."""
    last, out = 0, []
    for (wish, earliest), latest in zip(rows, range(most - len(rows) + 1, most + 1)):
        least = max(wish, earliest or 1)
        free = [d for d in range(last + 1, latest + 1) if d >= least]
        slot = free[0] if free else min(most, max(least, last))
        out.append((slot, slot != wish, not free and slot == last))
        last = slot
    return out


def slots(spark, keys, most):
    df = spark.createDataFrame([(k, i, w, e, 1, 2) for k, rows in keys.items() for i, (w, e) in enumerate(rows)], "k string, i int, wish int, earliest int, n int, row int")
    got = {}
    for r in sorted(windows.increasing_slots(df, ["k"], ["i"], "wish", most, "earliest").collect(), key=lambda r: r["i"]):
        got.setdefault(r["k"], []).append((r["slot"], r["shifted"], r["tied"]))
        assert (r["n"], r["row"]) == (1, 2)
    return got


def test_slots(spark):
    """Floors hold, the tail keeps its room, late pins tie and never pass the last slot."""
    rnd = random.Random(2)
    keys = {"late": [(28, None), (28, None), (1, None)], "pinned": [(k + 1, 15 if k == 2 else None) for k in range(17)], "full": [(k + 1, None) for k in range(28)], "one": [(5, 9)]}
    keys |= {f"r{j}": [(rnd.randint(1, 28), rnd.choice([None, None, rnd.randint(1, 28)])) for _ in range(rnd.randint(1, 28))] for j in range(40)}
    want = {k: plain_slots(v, 28) for k, v in keys.items()}
    assert slots(spark, keys, 28) == want
    assert want["late"][-1][0] == 28 and any(t for _, _, t in want["pinned"])
    assert all(1 <= s <= 28 for v in want.values() for s, *_ in v)
    with pytest.raises(Exception, match="more than 28 rows"):
        slots(spark, {"x": [(1, None)] * 40}, 28)


def test_crowded_slots(spark):
    """More rows than slots share them in order; a row whose stretch holds no slot has no wish and is not said to be shifted."""
    n, most = 30, 12
    df = spark.range(n).select(F.lit("k").alias("k"), F.col("id").cast("int").alias("i"), F.lit(None).cast("int").alias("earliest"))
    df = df.withColumn("wish", windows.spread_slot(F.col("i"), F.lit(n), most, F.lit(5)))
    got = sorted(windows.increasing_slots(df, ["k"], ["i"], "wish", most, "earliest", crowded=True).collect(), key=lambda r: r["i"])
    wishes = [(i + 1) * most // n if (i + 1) * most // n > i * most // n else None for i in range(n)]
    want = plain_slots([(w or 1, None) for w in wishes], most)
    assert [r["wish"] for r in got] == wishes
    assert [(r["slot"], r["tied"]) for r in got] == [(s, t) for s, _, t in want]
    assert [r["shifted"] for r in got] == [None if w is None else s != w for w, (s, *_) in zip(wishes, want)]


def test_similar_sets_in_blocks(spark):
    """Pairs within a block and between blocks, of frequent and rare items, are those of all pairs; no row is made for a pair below the limit."""
    rnd = random.Random(4)
    rows = {f"k{i}": sorted({rnd.choice("abcdef") for _ in range(rnd.randint(0, 4))} | {f"r{rnd.randint(0, 40)}" for _ in range(rnd.randint(0, 3))}) for i in range(120)}
    first = {}
    for k, s in sorted(rows.items()):
        first.setdefault(tuple(s), k)
    named = sorted((k, set(s)) for s, k in first.items() if s)
    df = spark.createDataFrame(list(rows.items()), "k string, s array<string>")
    for percent in (15, 60):
        want = sorted((a, b, len(x & y), len(x), len(y)) for a, x in named for b, y in named if a < b and 100 * len(x & y) >= percent * len(x | y))
        for block in (7, 4_096):
            assert sorted(map(tuple, joins.similar_sets(df, "k", "s", percent, block).collect())) == want
    assert joins.similar_sets(df.filter("false"), "k", "s", 15).count() == 0
    # many equal sets and a word of all: the frequent items go by products
    many = spark.range(400).selectExpr("id as k", "array('all', 'x' || id % 3, 'y' || id % 100) as s")
    assert joins.similar_sets(many, "k", "s", 50).count() == sum(i % 3 == j % 3 or i % 100 == j % 100 for i in range(300) for j in range(i))
    plan = joins.similar_sets(df, "k", "s", 60)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") <= 1  # the sets are sent to their pairs, pairs are not joined


def test_similar_sets_with_copies(spark):
    """All pairs of keys, also of equal sets in one block and in several; a null item counts in a size, null keys and empty sets have no partner."""
    rnd = random.Random(6)
    rows = [(k, sorted({rnd.choice("abcdef") for _ in range(rnd.randint(0, 3))}) + [None] * (k % 4 == 0)) for k in range(80)]
    rows += [(k, ["all", "x"]) for k in range(100, 400)] + [(None, ["a"]), (None, ["lonely"]), (None, ["x", "y"])]
    df = spark.createDataFrame(rows, "k long, s array<string>")
    held = [(k, set(s)) for k, s in rows if k is not None]
    for percent in (15, 60, 100):
        want = [(a, b, len((x & y) - {None}), len(x), len(y)) for a, x in held for b, y in held if a < b]
        want = sorted(w for w in want if w[2] and 100 * w[2] >= percent * (w[3] + w[4] - w[2]))
        for block in (100, 4_096) if percent == 60 else (4_096,):
            assert sorted(map(tuple, joins.similar_sets(df, "k", "s", percent, block, copies=True).collect())) == want


def test_flattened_to_any_depth(spark):
    deep = "leaf"
    for k in range(50):
        deep = {"k": deep} if k % 2 else [0, deep]
    texts = [json.dumps(deep), json.dumps({"a": [1, {"b": None, "c": []}], "d.e": True, "f": {}}), "no json", None, "3", "null"]

    def plain(v, at="$"):
        if isinstance(v, dict):
            return [x for k, y in v.items() for x in plain(y, f"{at}.{k}")]
        if isinstance(v, list):
            return [x for i, y in enumerate(v) for x in plain(y, f"{at}[{i}]")]
        return [] if v is None else [(at, json.dumps(v) if isinstance(v, bool) else str(v))]

    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = sorted((r["id"], r["path"], r["value"]) for r in projections.flattened(df, ["id"], "text").collect())
    want = []
    for i, t in enumerate(texts):
        try:
            want += [(i, *x) for x in plain(json.loads(t))] if t else []
        except ValueError:
            pass
    assert got == sorted(want)


def test_flattened_in_one_go(spark, monkeypatch):
    """Levels are not written out one by one."""
    written = []
    monkeypatch.setattr(projections, "staged", lambda df: written.append(1) or staged(df))
    nested = lambda depth: json.loads("[" * depth + "7" + "]" * depth)
    df = spark.createDataFrame([(json.dumps({"a": nested(8), "b{[": [], "c": "[]", "d": "{"}),), ("{[",)], "text string")
    got = sorted(tuple(r) for r in projections.flattened(df, [], "text").collect())
    assert got == [("$.a" + "[0]" * 8, "7"), ("$.c", "[]"), ("$.d", "{")] and not written
    deep = spark.createDataFrame([(k, json.dumps(nested(k))) for k in (0, 15, 16, 17, 32, 33)], "id int, text string")
    got = sorted(tuple(r) for r in projections.flattened(deep, ["id"], "text").collect())
    assert got == [(k, "$" + "[0]" * k, "7") for k in (0, 15, 16, 17, 32, 33)] and len(written) == 2
    wide = spark.createDataFrame([(json.dumps([{"k": i} for i in range(100)] + [[], {}, [None], [{}]]),)], "text string")
    assert sorted(tuple(r) for r in projections.flattened(wide, [], "text").collect()) == sorted((f"$[{i}].k", str(i)) for i in range(100))
    assert len(written) == 3  # empty containers are not carried on


def test_flattened_keeps_columns_of_any_name(spark):
    names = ["pos_", "key_", "item_", "path_", "variant"]
    df = spark.createDataFrame([(*range(5), "[3]")], ", ".join(f"{n} int" for n in names) + ", text string")
    assert [tuple(r) for r in projections.flattened(df, names, "text").collect()] == [(*range(5), "$[0]", "3")]


def test_sequences():
    rnd = random.Random(4)
    for _ in range(200):
        a, b = ([rnd.randint(0, 5) for _ in range(rnd.randint(0, 12))] for _ in range(2))
        lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        ed = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                lcs[i][j] = lcs[i - 1][j - 1] + 1 if x == y else max(lcs[i - 1][j], lcs[i][j - 1])
                ed[i][j] = min(ed[i - 1][j] + 1, ed[i][j - 1] + 1, ed[i - 1][j - 1] + (x != y))
        assert (T.lcs_length(a, b), T.edit_distance(a, b)) == (lcs[-1][-1], ed[-1][-1])


def test_names_that_operators_use_themselves(spark):
    """Columns named like an operator's own come back as they were."""
    a = spark.createDataFrame([(1, "x", 5, 6, 7, 8)], "k int, v string, hit int, `right` int, held int, digest int")
    out = joins.left_overwrite(a, spark.createDataFrame([(1, "y", 9)], "k int, v string, w int"), ["k"]).first()
    assert (out["v"], out["hit"], out["right"], out["w"]) == ("y", 5, 6, 9)
    assert sets.hash_sample(a, 1, "s", "k").first()["hit"] == 5
    out = windows.carry_forward(a.withColumn("repeats", F.lit(False)), ["k"], ["hit"], ["v"], "repeats").first()
    assert out["held"] == 7 and windows.flag_repeats(a, ["k"], ["hit"], ["v"]).first()["digest"] == 8


def test_exact_windows(spark):
    rows = [("a", w, p, p == 3, 10 * w + p) for w in (0, 1) for p in (1, 2, 3)]
    make = lambda rows: windows.exact_windows(spark.createDataFrame(rows, "u string, w int, p int, hit boolean, id int"), ["u"], "w", "p", 3, F.col("hit"), "id").collect()
    assert sorted((r["w"], r["target"], r["last"]) for r in make(rows)) == [(0, 3, 3), (1, 13, 13)]
    for bad in (rows[:-1], [*rows, ("a", 1, 3, False, 99)], [*rows[:-1], ("a", 1, 4, True, 14)], [*rows[:-1], ("a", 1, 3, False, 13)], [*rows[:-2], ("a", 1, 2, True, 12), ("a", 1, 3, True, 13)], [*rows[:-1], ("a", 1, 3, None, 13)]):
        with pytest.raises(Exception, match="positions 1 to 3"):
            make(bad)


def test_rows_for_a_table_of_keys(spark):
    rows = spark.range(1000).selectExpr("id % 100 as k", "id")
    keys = spark.createDataFrame([(3,), (7,), (7,), (None,)], "k long")
    assert files.rows_for(rows, keys, "k").count() == 20
    with pytest.raises(KeyError, match="500"):
        files.rows_for(rows, spark.createDataFrame([(3,), (500,)], "k long"), "k")


def test_impacts_by_what_specs_state(spark):
    """Label, path and both are told apart; conditions and hooks hold; the first transition wins, then the lower spec; a repeated path counts once."""
    specs = spark.createDataFrame([("e", "h", 1, "L", None, "execute", {}, "t1", "low"), ("e", "h", 2, None, "p", "review", {"a": ["1"]}, "t2", "low"), ("f", "h", 1, "L", "p", "execute", {}, "t3", "high"), ("f", "h", 2, None, None, "review", {}, "t4", "high")], "event string, hook string, spec_no int, label string, path string, decision string, wanted map<string,array<string>>, impact_type string, risk string")
    steps = spark.createDataFrame([("x", 1, "e", "h", {"a": "2"}), ("x", 2, "f", "h", {}), ("x", 3, "e", "h", {"a": "1"}), ("x", 0, "e", "other", {"a": "1"})], "u string, t int, event string, hook string, params map<string,string>")
    actions = spark.createDataFrame([("x", 1, "L", ["p", "p"], "live", True), ("x", 2, "M", ["p"], "live", None), ("x", 3, "L", ["p"], "cancelled", True), ("x", 4, "M", None, "live", False), ("x", 5, "L", [], None, False)], "u string, action_id int, kind string, paths array<string>, status string, moves_funds boolean")
    got = {r["action_id"]: (r["t"], r["spec_no"], r["decision"], r["must_not_execute"], r["impact_type"]) for r in joins.impacts(steps, specs, actions, "u", ["t"]).collect()}
    assert got == {1: (1, 1, "ask_confirmation", True, "t1"), 2: (3, 2, "review", False, "t2"), 5: (1, 1, "execute", False, "t1")}
