"""Runs with shared prefixes, stored states and masks against folds from scratch."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import branching, memory

DDL = "entity string, run string, path string, op string, value string, month int, seq int, source string, evidence array<string>, kind string"
OPS = ["create", "update", "mark_stale", "archive", "needs_verification", "set_pending", "clear_pending", "reactivate", "set_not_applicable", "no_update"]


@pytest.fixture(scope="module")
def runs(spark):
    """Runs of two entities that leave each other's histories at random places; one is a prefix of another, two are equal, values and sources may be null."""
    rnd = random.Random(7)
    rows = []
    for entity in ("a", None):
        trunk = []
        for r in range(6):
            keep = trunk[: rnd.randint(0, len(trunk))] if r != 3 else list(trunk)
            keep += [(rnd.choice("pq"), rnd.choice(OPS), rnd.choice(["x", "y", None]), 1 + len(keep) // 4, rnd.choice(["e1", "e2", None]), rnd.choice([["D1"], [], None]), rnd.choice("km")) for _ in range(0 if r in (3, 4) else 12)]
            trunk = keep if len(keep) > len(trunk) else trunk
            rows += [(entity, f"r{r}", p, op, v, m, i, s, ev, k) for i, (p, op, v, m, s, ev, k) in enumerate(keep)]
    return spark.createDataFrame(rows, DDL).repartition(5)


def norm(df, *cols):
    return sorted((tuple(map(str, (r[c] for c in cols))) for r in df.collect()))


CELL = ["path", "seq", "value", "status", "confidence", "valid_from", "valid_until", "last_confirmed_at", "source", "evidence"]


def test_forked_fold_is_the_fold_of_each_run(runs):
    whole = runs.withColumn("e", F.coalesce("entity", F.lit("-"))).withColumn("entity", F.concat_ws(":", "e", "run")).drop("e")
    want = memory.fold(whole).withColumn("run", F.substring_index("entity", ":", -1)).withColumn("entity", F.substring_index("entity", ":", 1))
    got = branching.forked_fold(runs).withColumn("entity", F.coalesce("entity", F.lit("-")))
    assert norm(got, "entity", "run", *CELL) == norm(want, "entity", "run", *CELL)
    assert branching.forked_fold(runs.filter("false")).count() == 0


def test_shared_work(runs):
    """Nodes and clones are those of the prefix tree, and every node is folded once."""
    seqs = {}
    for r in sorted(runs.collect(), key=lambda r: r["seq"]):
        seqs.setdefault((r["entity"], r["run"]), []).append(str([r[c] for c in ("path", "op", "value", "month", "source", "evidence")]))
    want = {}
    for entity in ("a", None):
        mine = [s for (e, _), s in seqs.items() if e == entity]
        nodes = {tuple(s[:d]) for s in mine for d in range(1, len(s) + 1)}
        kids = [sum(n[:-1] == p for n in nodes) for p in nodes | {()}]
        want[entity] = (sum(map(len, mine)), len(nodes), sum(k for k in kids if k > 1))
    nodes = branching.prefix_nodes(runs, ["entity", "run"], ["month", "seq"], ["path", "op", "value", "month", "source", "evidence"])
    got = {r["entity"]: (r["n_changes"], r["n_nodes"], r["n_clones"]) for r in branching.shared_work(nodes, ["entity"], ["entity", "run"]).collect()}
    assert got == want


def test_resumed_fold(runs):
    """A state that is stored and gone on from is the state of the whole; paths without changes keep their cells."""
    one = runs.filter("run = 'r0' and entity = 'a'").drop("run")
    for cut in (0, 2, 9):
        got = branching.resumed_fold(memory.fold(one.filter(f"month <= {cut}")), one.filter(f"month > {cut}"))
        assert norm(got, *CELL) == norm(memory.fold(one), *CELL)


def test_rows_of_a_key_are_dealt_for_themselves(spark):
    """The exchange of a fold's rows stays in the plan, though both sides of its union are dealt by the key."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = spark.range(100).selectExpr("'e' || id % 9 as entity", "'p' as path", "'create' as op", "'v' as value", "cast(id % 30 as int) as month", "id as seq", "'s' as source")
        plan = branching.resumed_fold(memory.fold(one.filter("month <= 15")), one.filter("month > 15"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    fold = plan[plan.index("MapInArrow fold") :]
    assert fold.index("Exchange hashpartitioning(xxhash64") < fold.index("Union")


def test_masks(runs):
    """Each level is the fold without the masked rows of the event, up to its last session; other paths are left out."""
    one = runs.filter("run = 'r1' and entity = 'a'").drop("run")
    levels = {"full": [], "some": ["k"], "all": ["k", "m"]}
    got = branching.counterfactual_states(one, levels, ["m"], ["month", "seq"])
    rows = [r.asDict() for r in one.collect()]
    want = []
    for event in ("e1", "e2"):
        mine = [r for r in rows if r["source"] == event]
        if not any(r["kind"] == "m" for r in mine):
            continue
        until = max((r["month"], r["seq"]) for r in mine)
        paths = {r["path"] for r in mine if r["op"] != "no_update"}
        for level, masked in levels.items():
            for p in paths:
                cells = []
                for r in sorted(rows, key=lambda r: (r["month"], r["seq"])):
                    if r["path"] == p and (r["month"], r["seq"]) <= until and not (r["source"] == event and r["kind"] in masked):
                        cells = memory.apply_change(cells, r["op"], r["value"], r["month"], r["source"], r["evidence"] or ())
                want += [tuple(map(str, (event, level, p, i, *c[:7]))) for i, c in enumerate(cells)]
    assert norm(got, "event", "level", *CELL[:-1]) == sorted(want)
    verdicts = branching.counterfactual_verdicts(got, "full", "all").collect()
    assert all(r["target_gone"] for r in verdicts) and any(r["n_own"] for r in verdicts)


def test_masks_in_one_pass(runs):
    """The states are the folds of the masked runs, which are never written out; null places, kinds and sources included."""
    more = runs.withColumn("source", F.when(F.col("seq") % 5 < 3, F.concat("source", F.lit("b"))).otherwise(F.col("source"))).withColumn("kind", F.when(F.col("seq") % 7 > 0, F.col("kind")))
    more = more.withColumns({"entity": F.concat("entity", "run"), "path": F.when(F.col("seq") % 11 > 0, F.col("path")), "seq": F.when(F.col("seq") > 0, F.col("seq"))}).drop("run")
    levels = {"full": [], "some": ["k"], "same": ["k"], "all": ["k", "m"]}
    got = branching.counterfactual_states(more, levels, ["m"], ["month", "seq"])
    want = branching.forked_fold(branching.masked_runs(more, levels, ["m"], ["month", "seq"]), "run", ["month", "seq"]).select("run.*", *got.columns[2:])
    assert norm(got, "event", "level", "entity", *CELL) == norm(want, "event", "level", "entity", *CELL) and got.count() > 100
    assert branching.counterfactual_states(more.filter("false"), levels, ["m"], ["month", "seq"]).count() == 0
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_verdicts_fold_once(runs):
    """The verdicts of all levels are those of the two that they read, and the states are worked out once."""
    one = runs.filter("entity = 'a'").withColumn("entity", F.concat("entity", "run")).drop("run")
    levels = {"full": [], "some": ["k"], "all": ["m"]}
    states = branching.counterfactual_states(one, levels, ["m"], ["month", "seq"])
    got = branching.counterfactual_verdicts(states, "full", "all")
    rows = [r.asDict() for r in states.collect()]
    want = []
    for entity, event in {(r["entity"], r["event"]) for r in rows if r["level"] != "some"}:
        cells = {level: [(tuple(map(str, (r[c] for c in ("path", "value", "status", "confidence", "valid_from", "valid_until", "source")))), r["source"] == event) for r in rows if (r["entity"], r["event"], r["level"]) == (entity, event, level)] for level in levels}
        own = {level: sum(mine for _, mine in cs) for level, cs in cells.items()}
        count = lambda level, x: sum(c == x and not mine for c, mine in cells[level])  # noqa: E731, B023
        others = {c for level in ("full", "all") for c, mine in cells[level] if not mine}
        want.append(tuple(map(str, (entity, event, own["full"], own["all"] == 0, sum(abs(count("full", x) - count("all", x)) for x in others)))))
    assert norm(got, "entity", "event", "n_own", "target_gone", "n_moved") == sorted(want) and len(want) > 5
    two = branching.counterfactual_states(one, {k: levels[k] for k in ("full", "all")}, ["m"], ["month", "seq"])
    assert norm(branching.counterfactual_verdicts(two, "full", "all"), "entity", "event", "n_own", "target_gone", "n_moved") == sorted(want)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow fold") == 1


def test_all_paths(spark):
    """Stated paths that an entity lacks are unknown; those without any state are there too; others are left out."""
    ddl = "entity string, path string, op string, value string, month int, seq int, source string"
    changes = spark.createDataFrame([("a", "p", "create", "x", 1, 1, "e"), ("a", "q", "create", "y", 1, 2, "e"), ("b", "r", "set_pending", "z", 1, 3, "e")], ddl)
    states = memory.effective(memory.fold(changes))
    got = memory.with_all_paths(states, ["p", "r"], spark.createDataFrame([("c",), ("a",)], "entity string"))
    assert sorted((r["entity"], r["path"], r["value"], r["status"]) for r in got.collect()) == [("a", "p", "x", "current"), ("a", "r", None, "unknown"), ("b", "p", None, "unknown"), ("b", "r", None, "unknown"), ("c", "p", None, "unknown"), ("c", "r", None, "unknown")]


def test_tasks_grow_with_the_rows(spark):
    """Many changes are dealt to more tasks than Spark's own number, by every exchange of nodes."""
    rows = spark.range(0, 1_900_000, 1, 4).selectExpr("cast(id div 20 as string) as entity", "'r' as run", "'p' as path", "'create' as op", "'v' as value", "cast(id % 20 as int) as month", "id as seq", "'s' as source")
    nodes = branching.prefix_nodes(rows, ["entity", "run"], ["month", "seq"], ["path", "op", "value", "month", "source"])
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (branching.shared_work(nodes, ["entity"], ["entity", "run"]), branching.forked_fold(rows))]
    assert [p.count(", 10), REPARTITION_BY_NUM") for p in plans] == [2, 5]
