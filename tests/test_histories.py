"""Folds, chains, donors and masks against expectations written by hand."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import align, masking, memory

CHANGES = "entity string, path string, op string, value string, month int, seq int, source string, evidence array<string>"


def cells_of(spark, changes, **kw):
    rows = [("t", "p", op, value, month, i, source, ev) for i, (op, value, month, source, ev) in enumerate(changes)]
    out = memory.fold(spark.createDataFrame(rows, CHANGES), **kw).orderBy("seq").collect()
    return [(r["value"], r["status"], r["confidence"], r["valid_from"], r["valid_until"], r["source"], r["evidence"]) for r in out]


def test_own_proposal_moves_in_place(spark):
    """A second proposal of the same event replaces value, start and evidence of the first."""
    got = cells_of(spark, [("create", "a", 1, "e1", ["D001"]), ("set_pending", "b", 2, "e2", ["D002"]), ("set_pending", "c", 4, "e2", ["D003"])])
    assert got == [("a", "current", 1.0, 1, None, "e1", ["D001"]), ("c", "pending", 0.5, 4, None, "e2", ["D003"])]


def test_other_proposals_are_cancelled(spark):
    got = cells_of(spark, [("set_pending", "b", 2, "e2", []), ("set_pending", "c", 3, "e3", [])])
    assert got == [("b", "cancelled", 0.5, 2, 3, "e2", []), ("c", "pending", 0.5, 3, None, "e3", [])]


def test_confirmed_proposal_closes_what_was(spark):
    got = cells_of(spark, [("create", "a", 1, "e1", []), ("set_pending", "b", 2, "e2", []), ("update", "b", 5, "e2", ["D9"])])
    assert got == [("a", "historical", 1.0, 1, 5, "e1", []), ("b", "current", 1.0, 5, None, "e2", ["D9"])]


def test_reactivated_cell_starts_anew(spark):
    got = cells_of(spark, [("create", "a", 1, "e1", []), ("update", "b", 3, "e2", []), ("reactivate", None, 7, "e3", [])])
    assert got == [("a", "current", 1.0, 7, None, "e1", []), ("b", "historical", 1.0, 3, 7, "e2", [])]


def test_doubt_and_clearing(spark):
    got = cells_of(spark, [("create", "a", 1, "e1", []), ("needs_verification", None, 2, "e1", []), ("mark_stale", None, 3, "e1", []), ("set_pending", "z", 3, "e1", []), ("clear_pending", None, 4, "e1", [])])
    assert got == [("a", "stale", 0.4, 1, None, "e1", []), ("z", "cancelled", 0.5, 3, 4, "e1", [])]
    got = cells_of(spark, [("needs_verification", None, 2, "e1", []), ("clear_pending", None, 4, "e1", []), ("archive", None, 6, "e2", [])])
    assert got == [(None, "historical", 1.0, 2, 6, "e1", [])]
    assert cells_of(spark, [("archive", None, 6, "e2", []), ("mark_stale", None, 6, "e2", []), ("reactivate", None, 6, "e2", []), ("no_update", "x", 7, "e", [])]) == []


def test_noops_are_left_out(spark):
    changes = [("create", "a", 1, "e1", []), ("update", "a", 2, "e2", []), ("set_not_applicable", None, 3, "e2", []), ("set_not_applicable", None, 4, "e2", []), ("archive", None, 5, "e2", []), ("clear_pending", None, 6, "e2", [])]
    assert [c[:5] for c in cells_of(spark, changes, skip_noops=True)] == [("a", "historical", 1.0, 1, 3), (None, "not_applicable", 1.0, 3, None)]
    assert len(cells_of(spark, changes)) == 4
    rows = [("t", "p", op, v, m, i, s, e) for i, (op, v, m, s, e) in enumerate(changes)]
    got = [(r["old_value"], r["is_noop"]) for r in memory.applied(spark.createDataFrame(rows, CHANGES)).orderBy("month").collect()]
    assert got == [(None, False), ("a", True), ("a", False), (None, True), (None, True), (None, True)]
    assert not memory.is_noop([memory.Cell("5", "current", 1.0, 1, None, None, "e")], memory.REPEATABLE[0], "update", "5", "f")


def test_templates(spark):
    t = spark.createDataFrame([("t", "move", "occurred", "occurred", {"kind": "rent", "to": "Busan"}, 4, "ev1", 1), ("t", "move", "occurred", "occurred", {"kind": "buy"}, 6, "ev2", 2)], "entity string, event string, hook string, status string, params map<string,string>, month int, instance string, order int")
    kinds = "event string, hook string, spec_no int, path string, op string, value_from string, wanted map<string,array<string>>"
    specs = spark.createDataFrame([("move", "occurred", 1, "home.city", "update", "param:to", {}), ("move", "occurred", 2, "home.lease", "create", "literal:yes", {"kind": ["rent", "lease"]}), ("move", "occurred", 3, "home.pet", "create", "x", {"pet": ["dog"]})], kinds)
    got = sorted((r["source"], r["spec_no"], r["path"], r["value"]) for r in memory.template_changes(t, specs).collect())
    assert got == [("ev1", 1, "home.city", "Busan"), ("ev1", 2, "home.lease", "yes"), ("ev2", 1, "home.city", None)]
    bad = specs.limit(1).withColumn("op", F.lit("clear_pending"))
    with pytest.raises(Exception, match="operation not allowed"):
        memory.template_changes(t, bad).collect()


def test_chains_end_at_a_gap(spark):
    """A phantom at two checkpoints in a row is one chain of two; one that is missing in between starts anew."""
    kinds = "entity string, event string, checkpoint int, ord int, anchor int"
    grid = spark.createDataFrame([("t", c) for c in (15, 30, 45, 60)], "entity string, checkpoint int")
    rows = [("t", "marriage", 15, 0, 2), ("t", "marriage", 30, 0, 2), ("t", "move", 15, 1, 9), ("t", "move", 45, 0, 9)]
    got = sorted(tuple(r) for r in align.hallucination_chains(spark.createDataFrame(rows, kinds), grid).collect())
    assert got == [("t", "marriage", 0, 2, 15, 30), ("t", "move", 0, 1, 15, 15), ("t", "move", 1, 1, 45, 45)]


def test_chains_against_plain(spark):
    rnd = random.Random(4)
    rows = [(f"t{rnd.randint(0, 2)}", rnd.choice("abc"), rnd.randint(1, 8), i, rnd.randint(0, 9)) for i in range(150)]
    points = [(f"t{t}", c) for t in range(3) for c in range(1, 9)]
    want = []
    for t in range(3):
        open_ = []
        for c in range(1, 9):
            free, kept = [r for r in rows if r[0] == f"t{t}" and r[2] == c], []
            for chain in open_:
                hit = next((r for r in free if r[1] == chain[0] and abs(r[4] - chain[1]) <= 3), None)
                if hit:
                    free.remove(hit)
                    kept.append([chain[0], hit[4], chain[2] + 1, chain[3], c])
                else:
                    want.append((f"t{t}", chain[0], *chain[2:]))
            open_ = kept + [[r[1], r[4], 1, c, c] for r in free]
        want += [(f"t{t}", chain[0], *chain[2:]) for chain in open_]
    got = align.hallucination_chains(spark.createDataFrame(rows, "entity string, event string, checkpoint int, ord int, anchor int"), spark.createDataFrame(points, "entity string, checkpoint int"))
    assert sorted((r["entity"], r["event"], r["n"], r["first_checkpoint"], r["last_checkpoint"]) for r in got.collect()) == sorted(want)


def test_alignment_ties():
    """A match comes before leaving out gold, and that before leaving out a prediction."""
    e = frozenset()
    assert align.align_lists([("a", 1, e), ("a", 1, e)], [("a", 1, e)]) == [(0, 0)]
    assert align.align_lists([("a", 1, e)], [("a", 1, e), ("a", 1, e)]) == [(0, 0)]
    assert align.align_lists([("a", 1, e), ("b", 1, e)], [("b", 1, e), ("a", 1, e)]) == [(1, 0)]
    assert align.align_lists([], [("a", 1, e)]) == [] and align.align_lists([("a", 3, frozenset("x"))], [("a", 9, frozenset("y")), ("a", 9, frozenset("x"))]) == [(0, 1)]


def test_donors_against_plain(spark):
    rnd = random.Random(2)
    slots = [(u, f"S{i:03d}", rnd.randint(0, 9)) for i in range(40) for u in [rnd.randint(0, 3)]]
    donors = [(u, f"C{u}{i:03d}", rnd.choice((None, *range(10)))) for u in range(4) for i in range(30)]
    want, used = [], set()
    for u, s, m in sorted(slots, key=lambda r: (r[0], r[2], r[1])):
        free = [d for d in donors if d[0] == u and d[1] not in used]
        score = lambda d: (1, hashlib.sha256(f"x:{s}:{d[1]}".encode()).hexdigest(), d[1]) if d[2] is None else (0, abs(d[2] - m), d[1])  # noqa: B023, E731
        used.add(best := min(free, key=score)[1])
        want.append((u, s, best))
    args = spark.createDataFrame(slots, "u int, slot string, month int"), spark.createDataFrame(donors, "u int, donor string, month int")
    got = masking.assign_donors(*args, ["u"], ["month", "slot"], "x")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    with pytest.raises(Exception, match="no unused donor"):
        masking.assign_donors(args[0], args[1].filter("donor < 'C0005'"), ["u"], ["slot"], "x").collect()


def test_masks(spark):
    kinds = ("routine_financial", "weak_signal_evidence", "upcoming_evidence", "occurred_evidence", "cancellation_evidence", "consequence_session", "hard_negative", "stale_recall_session")
    df = spark.createDataFrame([(k, 1) for k in kinds], "kind string, v int")
    got = {}
    for r in masking.ladder(df, "kind", ["v"]).filter("masked").collect():
        got.setdefault(r["level"], set()).add(r["kind"])
    end = {"occurred_evidence", "cancellation_evidence", "consequence_session", "stale_recall_session"}
    assert got == {"mask_terminal": end, "mask_upcoming": end | {"upcoming_evidence"}, "mask_all": end | {"upcoming_evidence", "weak_signal_evidence"}}


def test_neutral_sessions(spark):
    rows = [("routine_financial", None, "t1", ["task_intent"], 8), ("routine_financial", None, "t1", [], 8), ("routine_financial", None, "t1", ["task_intent", "event"], 8), ("routine_financial", "ev1", "t1", [], 8), ("routine_financial", None, "t9", [], 8), ("hard_negative", None, "t1", [], 8), ("routine_financial", "", "t1", None, 0), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "kind string, linked string, task string, cues array<string>, n int")
    got = [r[0] for r in df.select(masking.is_neutral(F.col("kind"), F.col("linked"), F.col("task"), ["t1", "t2"], F.col("cues"), F.col("n"))).collect()]
    assert got == [True, True, False, False, False, False, False, False]
    sess = spark.createDataFrame([("S1", "occurred_evidence", "real", "ev1", 3), ("S2", "routine_financial", "other", None, 4)], "sid string, kind string, turns string, linked string, month int")
    gave = spark.createDataFrame([("S1", "filler")], "sid string, turns string")
    out = masking.neutral(sess, gave, ["sid"], ["month"], {"kind": "routine_financial"})
    assert sorted(map(tuple, out.collect())) == [("S1", "routine_financial", "filler", None, 3, True), ("S2", "routine_financial", "other", None, 4, False)]
    assert masking.changed_rows(sess, sess).count() == 0 and masking.changed_rows(sess, out.drop("replaced")).count() == 2
    bad = masking.target_retracted(sess, sess.filter("sid = 'S1'"), F.col("linked") == "ev1")
    assert sorted((r["sid"], r["code"]) for r in bad.collect()) == [("S1", "target_remains"), ("S2", "drift")]
