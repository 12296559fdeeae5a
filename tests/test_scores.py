"""Scores, parsers and cases against plain versions and expectations written by hand."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from tidemark.functions import answers as A
from tidemark.operators import align, cases, memory, parsing, projections, scoring as S
from tidemark.plans import registry
from tidemark.streaming import state

SF = "/root/testdata/sf0.001"


def prf(m, p, g):
    if not p and not g:
        return 1.0
    return 0.0 if not p or not g else 2 * m / (p + g)


def test_item_scores(spark):
    """Every score of random ledgers against its definition."""
    rnd = random.Random(9)
    kinds = "item string, ord int, event string, status string, anchor int, core array<string>, supporting array<string>"
    make = lambda item: [(item, o, rnd.choice("abc"), rnd.choice(S.STATUSES[:4]), rnd.randint(1, 9), rnd.sample(["D001", "D002", "D003"], rnd.randint(0, 3)), rnd.sample(["D004", "D005"], rnd.randint(0, 2))) for o in range(rnd.randint(0, 5))]
    gold = [r for i in range(12) for r in make(f"i{i}")]
    pred = [(*r, rnd.choice((None, 0.2, 0.9, 1.5))) for i in range(12) for r in make(f"i{i}")]
    got = {r["item"]: r.asDict() for r in S.item_scores(spark.createDataFrame(gold, kinds), spark.createDataFrame(pred, kinds + ", confidence double")).collect()}
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    for item in {r[0] for r in gold + pred}:
        g, p = [r for r in gold if r[0] == item], [r for r in pred if r[0] == item]
        pairs = align.align_lists([(r[2], r[4], frozenset(r[5])) for r in g], [(r[2], r[4], frozenset(r[5])) for r in p])
        left, right = {a for a, _ in pairs}, {b for _, b in pairs}
        st = [(g[a][3], p[b][3]) for a, b in pairs] + [(r[3], "no_event") for k, r in enumerate(g) if k not in left] + [("no_event", r[3]) for k, r in enumerate(p) if k not in right]
        f1s = []
        for c in S.STATUSES:
            tp, wrong = sum(x == y == c for x, y in st), sum((x == c) != (y == c) for x, y in st)
            if tp + wrong:
                f1s.append(2 * tp / (2 * tp + wrong))
        core = [prf(len({*g[a][5]} & {*p[b][5]}), len(p[b][5]), len(g[a][5])) for a, b in pairs]
        supp = [prf(len({*g[a][6]} & {*p[b][6]}), len(p[b][6]), len(g[a][6])) for a, b in pairs]
        dist = [abs(g[a][4] - p[b][4]) for a, b in pairs]
        good = {b for a, b in pairs if g[a][3] == p[b][3]}
        conf = [(r[7], float(k in good)) for k, r in enumerate(p) if r[7] is not None and r[7] <= 1]
        gs, ps = [r[2] for r in g if r[3] == "occurred"], [r[2] for r in p if r[3] == "occurred"]
        want = {
            "full_ledger_event_f1": prf(len(pairs), len(p), len(g)), "status_macro_f1": mean(f1s), "core_evidence_f1": mean(core), "supporting_evidence_f1": mean(supp), "core_evidence_f1_end_to_end": sum(core) / len(g) if g else None,
            "anchor_exact_accuracy": mean([float(d == 0) for d in dist]), "anchor_median_absolute_error": float(median(dist)) if dist else None, "anchor_within_3_sessions": mean([float(d <= 3) for d in dist]), "event_count_mae": float(abs(len(p) - len(g))),
            "brier_score": mean([(c - o) ** 2 for c, o in conf]), "mean_confidence_correct": mean([c for c, o in conf if o]), "mean_confidence_incorrect": mean([c for c, o in conf if not o]), "exact_occurred_trajectory_match": float(gs == ps),
        }
        assert {k: got[item][k] for k in want} == pytest.approx(want)


def test_zero_rules(spark):
    """A path that neither changed nor was predicted is a true negative, but not correct; precision of changes without any is 0."""
    rows = [("t", 1, "p", "a", "a", None, False, True, [], []), ("t", 1, "q", "a", "b", "b", True, True, ["D001"], ["D001", "D002"])]
    df = spark.createDataFrame(rows, "trajectory string, checkpoint int, path string, initial string, gold string, predicted string, is_predicted boolean, dynamic boolean, gold_evidence array<string>, predicted_evidence array<string>")
    r = S.cell_scores(S.cell_outcomes(df), ["trajectory"]).first()
    assert (r["tn"], r["tp_correct"], r["final_state_accuracy"], r["unchanged_state_accuracy"], r["evidence_citation_precision"]) == (1, 1, 0.5, 0.0, 0.5)
    none = S.cell_scores(S.cell_outcomes(df.filter("path = 'p'")), ["trajectory"]).first()
    assert (none["change_detection_precision"], none["change_detection_recall"], none["change_detection_f1"]) == (0.0, None, None)
    late = S.cell_outcomes(df.filter("path = 'q'")).withColumn("gold_events", F.array(F.lit("D009")))
    with pytest.raises(Exception, match="future update event"):
        S.update_events(late).collect()


def test_ledger_parser(spark):
    raws = [None, "", "[1]", '{"events": {}}', '{"events": [3, {"event_id": 7, "status": "occurred"}, {"event_id": "move", "status": "maybe", "first_evidence_session_id": "D002", "status_anchor_session_id": "D001", "core_evidence_session_ids": "D001", "supporting_session_ids": ["D9", null], "confidence": true}]}']
    raws.append('note\n{"events": [{"event_id": "move", "status": "occurred", "first_evidence_session_id": "D002", "status_anchor_session_id": "D002", "confidence": 1}, {"event_id": "move", "status": "upcoming", "first_evidence_session_id": "D001", "status_anchor_session_id": "D001", "supporting_session_ids": ["D002", "D001", "D002"], "confidence": 0.25, "prediction_id": "x"}]} end')
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    visible = F.create_map(F.lit("D001"), F.lit("S001"), F.lit("D002"), F.lit("S002"))
    got = {r["i"]: r["p"] for r in df.select("i", parsing.ledger(F.col("raw"), visible, ["move", "job"]).alias("p")).collect()}
    assert [got[i]["parse_error"] for i in range(6)] == ["invalid_json", "invalid_json", "missing_events_list", "missing_events_list", None, None]
    assert got[4]["n_rejected"] == 3 and got[4]["events"] == []
    assert got[4]["errors"][0] == "events[0]: not_an_object" and {"events[1]: unknown_event_id", "events[1]: invalid_confidence", "events[2]: invalid_status", "events[2]: core_evidence_session_ids:not_a_list", "events[2]: supporting_session_ids:malformed", "events[2]: invalid_confidence"} <= set(got[4]["errors"])
    a, b = got[5]["events"]
    assert (a["prediction_id"], a["first_evidence_session"], a["confidence"], a["core_evidence_sessions"]) == ("P001", "S002", 1.0, [])
    assert (b["prediction_id"], b["supporting_sessions"], b["confidence"]) == ("x", ["S002", "S001"], 0.25) and got[5]["errors"] == ["events_not_ordered_by_first_evidence"]


def test_answers():
    assert A.normalize_answer("가, 나", "string_list", {"가": "다"}) == '["나","다"]' and A.normalize_answer(None, "krw") == A.NONE
    assert projections.selection("b,a", ["a", "b", "c"]) == ["a", "b"] and projections.selection("all", ["x"]) == ["x"]
    with pytest.raises(ValueError):
        projections.selection("z", ["a"])


def test_cases_raise(spark):
    a = spark.createDataFrame([(1, "x", "p"), (2, "y", "q")], "k int, v string, w string")
    with pytest.raises(ValueError, match="no anchor"):
        cases.anchored_pairs(a, a.filter("k = 1").select("k"), ["k"])
    for bad in (a.union(a), a.filter("k = 1")):
        with pytest.raises(ValueError, match="not exactly one"):
            cases.exactly_one(bad, ["k"], a)
    with pytest.raises(ValueError, match="differs in w"):
        cases.patched(a, a.withColumn("w", F.lit("other")), ["k"], ["v"])
    with pytest.raises(ValueError, match="no row"):
        cases.patched(a, a.withColumn("k", F.col("k") + 9), ["k"], ["v"])
    with pytest.raises(ValueError, match="repeated"):
        cases.paired_conditions(a.union(a), "k", "v", ["x"], "w")
    with pytest.raises(ValueError):
        cases.chosen(a, "v", include=["x"], exclude=["x"])
    with pytest.raises(Exception, match="unknown condition"):
        a.select(projections.visible_for(F.array("v"), F.lit("half"), F.array("v"))).collect()


def test_streamed_fold(spark, tmp_path):
    """Changes that come in three micro-batches, over two runs, give the state of the batch fold."""
    changes = registry.queries()["memory_fold"].__globals__["_changes"](spark, SF).drop("event_type").orderBy("month", "seq")
    parts = [changes.filter(f"month between {a} and {b}").coalesce(1) for a, b in ((1, 9), (10, 20), (21, 31))]
    folder, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    for p in parts[:2]:
        p.write.mode("append").parquet(folder)
    state.fold_available(spark, folder, changes.schema, target, checkpoint, files_at_once=1)
    parts[2].write.mode("append").parquet(folder)
    got = state.fold_available(spark, folder, changes.schema, target, checkpoint, files_at_once=1)
    cols = ["entity", "path", "seq", "value", "status", "confidence", "valid_from", "valid_until", "source"]
    rows = lambda df: sorted(map(repr, map(tuple, df.select(*cols).collect())))
    assert rows(got) == rows(memory.fold(changes))
