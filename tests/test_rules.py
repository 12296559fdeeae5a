"""Each rule of the session audit with a session that breaks it, and sessions that break none."""

import copy

import pytest

from tidemark.operators import rules

GOOD = {
    "session_id": 0, "session_type": "occurred_evidence", "status": "occurred",
    "turns": [("user", "이체 한도 moved last month"), ("assistant", "ok"), ("user", "the rent is new"), ("assistant", "done")],
    "cues": [(0, "state_change", "moved last month", "p.home", "update", "x", "d1"), (2, "memory_fact", "rent", "p.rent", "update", "y", None)],
    "must_include": ["moved"], "forbidden": ["secret"], "target_paths": ["p.home", "p.rent"], "no_update": False,
    "dimensions": [("d1", "state_change", True), ("d2", "amount", False)], "deadline": 2, "final_reveal": False,
    "stale_pairs": [("p.a", "old", "new")], "facts": [("p.rent", "update", "y")],
}


def turn(k, text=None, speaker=None):
    def change(s):
        who, said = s["turns"][k]
        s["turns"][k] = (speaker or who, said if text is None else text)

    return change


def cue(k, **new):
    names = ["turn_index", "cue_type", "evidence_text", "path", "operation", "value", "dimension_id"]

    def change(s):
        s["cues"][k] = tuple(new.get(n, v) for n, v in zip(names, s["cues"][k]))

    return change


def put(**new):
    return lambda s: s.update(new)


BREAKS = {
    "no_turns": put(turns=[]), "first_turn_not_user": turn(0, speaker="assistant"), "last_turn_not_assistant": turn(3, speaker="user"), "speaker_alternation": turn(1, speaker="user"),
    "fa_code_leakage": turn(1, "see FA-07"), "emoji": turn(1, "ok \U0001f600"), "choseongche": turn(1, "ㅋㅋ"), "assistant_event_summary": turn(1, "이사하셨군요"), "offline_banking_context": turn(1, "영업점"),
    "cue_index_out_of_range": cue(1, turn_index=9), "cue_not_user_turn": cue(1, turn_index=1), "cue_text_not_in_annotated_turn": cue(1, evidence_text="nowhere"), "cue_linked_path_not_target": cue(1, path="p.other"),
    "missing_cue_annotation": put(cues=[]), "missing_memory_fact_grounding": put(facts=[("p.rent", "update", "z")]), "stale_old_current_confusion": put(session_type="stale_recall_session"),
    "evidence_dimension_annotation_mismatch": cue(0, dimension_id="d9"), "required_evidence_not_realized": cue(0, dimension_id="d2"), "insufficient_event_evidence": cue(0, dimension_id=None),
    "generic_financial_task_only": cue(0, cue_type="memory_fact"), "evidence_revealed_too_late": put(deadline=1, cues=[(2, "state_change", "rent", "p.home", "update", "x", "d1")]), "hard_negative_unintended_update": put(no_update=True),
    "missing_required_cue": put(must_include=["absent"]), "required_cue_not_in_user_turn": put(must_include=["done"]), "required_cue_not_annotated": put(must_include=["done"]), "forbidden_term": put(forbidden=["rent"]),
    "status_inconsistent": put(session_type="routine_financial"), "occurred_without_consequence_cue": put(cues=None), "weak_signal_overcommitted": lambda s: (turn(1, "이미 확정")(s), s.update(status="weak_signal")),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [GOOD]
    for k, change in enumerate(BREAKS.values(), 1):
        row = copy.deepcopy(GOOD) | {"session_id": k}
        change(row)
        rows.append(row)
    odd = copy.deepcopy(GOOD) | {"session_id": 900, "turns": [(None, None), ("assistant", None)], "cues": [(None,) * 7], "must_include": [None, ""], "forbidden": None, "dimensions": None, "facts": None, "stale_pairs": None, "session_type": None, "status": None, "deadline": None, "target_paths": None}
    held = copy.deepcopy(GOOD) | {"session_id": 901, "status": "weak_signal"}
    turn(1, "이미 확정? 확정은 아니")(held)
    out = {}
    for r in rules.session_audit(spark.createDataFrame([tuple(r.values()) for r in [*rows, odd, held]], rules.SESSION)).collect():
        out.setdefault(r["session_id"], {})[r["code"]] = r["n"]
    return out


def test_each_rule(found):
    """A whole session breaks none; each change breaks its own rule; every rule has one."""
    assert set(BREAKS) == {r.code for r in rules.SESSION_RULES}
    assert 0 not in found and 901 not in found and 900 in found
    assert {code: code in found.get(k, {}) for k, code in enumerate(BREAKS, 1)} == dict.fromkeys(BREAKS, True)


def test_nothing_else(found):
    """What a single fault breaks, in full."""
    at = {code: k for k, code in enumerate(BREAKS, 1)}
    assert found[at["fa_code_leakage"]] == {"fa_code_leakage": 1} and found[at["forbidden_term"]] == {"forbidden_term": 1}
    assert found[at["cue_text_not_in_annotated_turn"]] == {"cue_text_not_in_annotated_turn": 1}
    assert found[at["required_cue_not_in_user_turn"]] == {"required_cue_not_in_user_turn": 1, "required_cue_not_annotated": 1}
    assert found[at["cue_index_out_of_range"]] == {"cue_index_out_of_range": 1}


def test_tables_of_rules(spark):
    df = rules.prepared(spark.createDataFrame([tuple(GOOD.values())], rules.SESSION))
    with pytest.raises(ValueError, match="twice"):
        rules.broken_rules(df, ["session_id"], [rules.SESSION_RULES[0]] * 2)
    with pytest.raises(ValueError, match="unknown"):
        rules.broken_rules(df, ["session_id"], [rules.Rule("x", "galaxy", "true")])
    own = rules.broken_rules(df, ["session_id"], [rules.Rule("user_turns", "turn", "x.speaker = 'user'")]).collect()
    assert [tuple(r) for r in own] == [(0, "user_turns", 2)]
