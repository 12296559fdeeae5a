"""Audits from a table of rules: each is a code, a scope and an expression, and all of a table go by in one pass.

A session is a row with its turns, the cues that annotate them, and what its plan
demands. A rule of a scope is asked of each element of that scope; what several
rules need (the visible text, the turns with cues) is worked out once for a row.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.answers import EMOJI, FA_CODE, JAMO
from tidemark.operators._stage import free


class Rule(NamedTuple):
    """``broken`` is SQL over the row's columns and, but for scope session, the element ``x``."""

    code: str
    scope: str
    broken: str


#: What an assistant must not say about events, terms of branch banking, and phrases that take a weak signal for settled, or do not.
ASSISTANT_SUMMARIES = ("이사하셨군요", "결혼하셨군요", "출산하셨군요", "이직하셨군요", "퇴사하셨군요", "장례 치르셨군요", "신혼이시군요")
OFFLINE_TERMS = ("창구", "영업점", "방문", "모시겠습니다", "신분증 지참", "실물 신분증", "신청서", "서명", "출력", "우편 발송", "우편 배송", "배송", "방문 수령", "창구 수령", "실물 수령")
OVERCOMMITTED = ("이미 확정", "확정됐", "확정되었", "확정되었습니다", "확정된 상태", "확정된 일정", "확정된 건입니다", "완전히 확정")
NOT_COMMITTED = ("확정된 건 아닌", "확정은 아니", "확정된 상태는 아니", "확정된 일정은 아니", "확정된 것은 아니")
#: Types of session that show an event, and roles that say more than that there is financial activity.
EVIDENCE_TYPES = ("weak_signal_evidence", "upcoming_evidence", "occurred_evidence", "cancellation_evidence")
TELLING_ROLES = ("state_change", "entity_change", "subtype_disambiguation", "uncertainty", "future_timing", "cancellation", "prior_current_contrast")

#: What a rule's ``x`` ranges over: turns with their index, annotated cues, cues that must come, forbidden terms, evidence dimensions.
SCOPES = {"session": "array(true)", "turn": "turns_at", "cue": "cues_at", "must": "must_include", "term": "forbidden", "dimension": "dimensions", "stale": "stale_pairs", "fact": "facts"}

SESSION = (
    "session_id long, session_type string, status string, turns array<struct<speaker:string,text:string>>, "
    "cues array<struct<turn_index:int,cue_type:string,evidence_text:string,path:string,operation:string,value:string,dimension_id:string>>, must_include array<string>, forbidden array<string>, "
    "target_paths array<string>, no_update boolean, dimensions array<struct<dimension_id:string,role:string,required:boolean>>, deadline int, final_reveal boolean, "
    "stale_pairs array<struct<path:string,old_value:string,current_value:string>>, facts array<struct<path:string,operation:string,value:string>>"
)

_one_of = lambda words: "array(" + ", ".join(f"'{w}'" for w in words) + ")"
_says = lambda text, words: f"exists({_one_of(words)}, w -> contains({text}, w))"
_EVIDENCE = f"array_contains({_one_of(EVIDENCE_TYPES)}, session_type)"
_SHOWN = "exists(cues_at, c -> c.on_user and coalesce(c.dimension_id = x.dimension_id, false))"

#: The rules of a session; the codes are fixed values.
SESSION_RULES = (
    Rule("no_turns", "session", "n_turns = 0"),
    Rule("first_turn_not_user", "session", "n_turns > 0 and turns[0].speaker <> 'user'"),
    Rule("last_turn_not_assistant", "session", "n_turns > 0 and turns[n_turns - 1].speaker <> 'assistant'"),
    Rule("speaker_alternation", "session", "exists(turns_at, x -> x.speaker = x.before)"),
    Rule("fa_code_leakage", "session", f"rlike(visible, r'{FA_CODE}')"),
    Rule("emoji", "session", f"rlike(visible, '{EMOJI}')"),
    Rule("choseongche", "session", f"rlike(visible, '{JAMO}')"),
    Rule("assistant_event_summary", "session", _says("assistant_text", ASSISTANT_SUMMARIES)),
    Rule("offline_banking_context", "session", _says("visible", OFFLINE_TERMS)),
    Rule("cue_index_out_of_range", "cue", "not x.in_range"),
    Rule("cue_not_user_turn", "cue", "x.in_range and not x.on_user"),
    Rule("cue_text_not_in_annotated_turn", "cue", "x.on_user and x.evidence_text <> '' and not contains(x.turn_text, x.evidence_text)"),
    Rule("cue_linked_path_not_target", "cue", "x.path is not null and not array_contains(target_paths, x.path)"),
    Rule("missing_cue_annotation", "session", "n_turns > 0 and size(must_include) > 0 and size(cues) = 0"),
    Rule("missing_memory_fact_grounding", "fact", "not exists(cues, c -> c.cue_type <=> 'memory_fact' and c.path <=> x.path and c.operation <=> x.operation and c.value <=> x.value)"),
    Rule("stale_old_current_confusion", "stale", "session_type = 'stale_recall_session' and not (exists(cues, c -> c.cue_type <=> 'stale_value' and c.path <=> x.path and c.value <=> x.old_value and coalesce(c.evidence_text, '') <> '') "
         "and exists(cues, c -> c.cue_type <=> 'current_value' and c.path <=> x.path and c.value <=> x.current_value and coalesce(c.evidence_text, '') <> ''))"),
    Rule("evidence_dimension_annotation_mismatch", "cue", f"{_EVIDENCE} and x.dimension_id <> '' and (not exists(dimensions, d -> d.dimension_id <=> x.dimension_id) "
         "or exists(dimensions, d -> d.dimension_id = x.dimension_id and x.cue_type <> d.role and x.cue_type <> 'memory_fact'))"),
    Rule("required_evidence_not_realized", "dimension", f"{_EVIDENCE} and coalesce(x.required, true) and not {_SHOWN}"),
    Rule("insufficient_event_evidence", "session", f"{_EVIDENCE} and exists(dimensions, x -> coalesce(x.required, true) and not {_SHOWN})"),
    Rule("generic_financial_task_only", "session", f"{_EVIDENCE} and size(dimensions) > 0 and not exists(dimensions, x -> coalesce(array_contains({_one_of(TELLING_ROLES)}, x.role), false) and exists(cues_at, c -> c.on_user and c.dimension_id <=> x.dimension_id and c.cue_type <=> x.role))"),
    Rule("evidence_revealed_too_late", "session", f"{_EVIDENCE} and not final_reveal and exists(cues_at, c -> c.on_user and exists(dimensions, d -> d.dimension_id = c.dimension_id) and c.turn_index > deadline_at)"),
    Rule("hard_negative_unintended_update", "session", "(session_type = 'hard_negative' or no_update) and exists(cues, c -> c.cue_type = 'memory_fact' or coalesce(c.operation, 'no_update') <> 'no_update')"),
    Rule("missing_required_cue", "must", "x <> '' and not contains(visible, x)"),
    Rule("required_cue_not_in_user_turn", "must", "x <> '' and contains(visible, x) and not contains(user_text, x)"),
    Rule("required_cue_not_annotated", "must", "x <> '' and contains(visible, x) and not exists(cues_at, c -> c.on_user and contains(c.turn_text, x))"),
    Rule("forbidden_term", "term", "x <> '' and contains(visible, x)"),
    Rule("status_inconsistent", "session", "session_type in ('hard_negative', 'routine_financial') and status <> 'no_event'"),
    Rule("occurred_without_consequence_cue", "session", "n_turns > 0 and status = 'occurred' and session_type = 'occurred_evidence' and size(cues) = 0"),
    Rule("weak_signal_overcommitted", "session", f"status = 'weak_signal' and {_says('visible', OVERCOMMITTED)} and not {_says('visible', NOT_COMMITTED)}"),
)


def prepared(sessions: DataFrame) -> DataFrame:
    """Sessions (columns of SESSION) with what rules share: n_turns, visible, user_text, assistant_text, turns_at, cues_at, deadline_at. Null lists are empty, a null text is."""
    kinds = {f.name: f.dataType.simpleString() for f in sessions.schema.fields if f.dataType.typeName() == "array"}
    rows = sessions.withColumns({c: F.coalesce(c, F.expr(f"cast(array() as {t})")) for c, t in kinds.items()})
    rows = rows.withColumns({
        "turns": F.transform("turns", lambda t: F.struct(t["speaker"].alias("speaker"), F.coalesce(t["text"], F.lit("")).alias("text"))),
        "status": F.coalesce("status", F.lit("no_event")), "no_update": F.coalesce("no_update", F.lit(False)), "final_reveal": F.coalesce("final_reveal", F.lit(False)),
    })
    said = lambda who: F.expr(f"array_join(transform(filter(turns, t -> {who}), t -> t.text), ' ')")
    rows = rows.withColumns({"n_turns": F.size("turns"), "visible": said("true"), "user_text": said("t.speaker = 'user'"), "assistant_text": said("t.speaker = 'assistant'")})
    inside = "c.turn_index between 0 and n_turns - 1"
    on_user = f"coalesce({inside} and get(turns, c.turn_index).speaker = 'user', false)"
    return rows.withColumns({
        "turns_at": F.expr("transform(turns, (t, i) -> struct(t.speaker, t.text, get(turns, i - 1).speaker as before))"),
        "cues_at": F.expr(f"transform(cues, c -> struct(c.*, coalesce({inside}, false) as in_range, {on_user} as on_user, case when {on_user} then get(turns, c.turn_index).text end as turn_text))".replace("c.*", "c.turn_index, c.cue_type, c.evidence_text, c.path, c.operation, c.value, c.dimension_id")),
        "deadline_at": F.expr("get(filter(transform(turns, (t, i) -> case when t.speaker = 'user' then i end), i -> i is not null), least(greatest(coalesce(deadline, 3), 1), size(filter(turns, t -> t.speaker = 'user'))) - 1)"),
    })


def broken_rules(df: DataFrame, key: Sequence[str], rules: Sequence[Rule] = SESSION_RULES) -> DataFrame:
    """Key, code and n: how many elements of its scope break a rule. A rule that is null is not broken. A code that is stated twice, or an unknown scope, raises."""
    codes = [r.code for r in rules]
    if len(set(codes)) < len(codes) or (wrong := {r.scope for r in rules} - set(SCOPES)):
        raise ValueError(f"codes stated twice or unknown scopes: {sorted(c for c in set(codes) if codes.count(c) > 1) or wrong}")
    found = free("found", df)
    count = lambda r: f"size(filter({SCOPES[r.scope]}, {'y' if r.scope == 'session' else 'x'} -> coalesce({r.broken}, false)))"
    each = F.array(*[F.struct(F.lit(r.code).alias("code"), F.expr(count(r)).cast("long").alias("n")) for r in rules])
    return df.select(*key, F.explode(F.filter(each, lambda x: x["n"] > 0)).alias(found)).select(*key, f"{found}.*")


def session_audit(sessions: DataFrame) -> DataFrame:
    """Every rule of SESSION_RULES that a session breaks: session_id, code, n."""
    return broken_rules(prepared(sessions), ["session_id"])
