"""Audits of sessions made from the conversations by the rules of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import rules
from tidemark.plans._base import query, table

#: Sessions with plans that follow from the conversation's number, in Spark and in SQL.
_PLAN = """element_at(array('routine_financial', 'occurred_evidence', 'hard_negative', 'stale_recall_session', 'upcoming_evidence'), cast(k % 5 as int) + 1) as session_type,
element_at(array('no_event', 'occurred', 'weak_signal', 'occurred'), cast(k % 4 as int) + 1) as status, turns,
if(k % 9 = 0, array(), array(named_struct('turn_index', cast(k % 7 as int), 'cue_type', 'state_change', 'evidence_text', substr(t0, 1, 12), 'path', concat('p', k % 3), 'operation', 'update', 'value', 'v', 'dimension_id', concat('d', k % 2)),
    named_struct('turn_index', 0, 'cue_type', 'memory_fact', 'evidence_text', if(k % 6 = 0, 'zzz9', ''), 'path', null, 'operation', 'no_update', 'value', 'v', 'dimension_id', null))) as cues,
array(substr(t0, 1, 6), 'qqq9') as must_include, array('ing', 'zz9') as forbidden, array('p0', 'p1') as target_paths, k % 8 = 0 as no_update,
array(named_struct('dimension_id', 'd0', 'role', 'state_change', 'required', true), named_struct('dimension_id', 'd1', 'role', 'amount', 'required', false)) as dimensions,
cast(1 + k % 3 as int) as deadline, k % 4 = 0 as final_reveal, array(named_struct('path', concat('p', k % 3), 'old_value', 'o', 'current_value', 'v')) as stale_pairs,
if(k % 2 = 1, array(named_struct('path', null, 'operation', 'no_update', 'value', 'v')), array(named_struct('path', 'p9', 'operation', 'update', 'value', 'v'))) as facts"""

_BASE_SQL = """with t as (select conv_id as k, list(struct_pack(speaker := role, text := coalesce(text, '')) order by turn) as turns from conversations group by 1),
s as (select *, turns[1].text as t0, len(turns) as n, array_to_string(list_transform(turns, lambda t: t.text), ' ') as visible, array_to_string(list_transform(list_filter(turns, lambda t: t.speaker = 'user'), lambda t: t.text), ' ') as user_text,
    ['routine_financial', 'occurred_evidence', 'hard_negative', 'stale_recall_session', 'upcoming_evidence'][k % 5 + 1] as kind, ['no_event', 'occurred', 'weak_signal', 'occurred'][k % 4 + 1] as status, k % 7 as pos,
    list_filter(range(1, len(turns) + 1), lambda i: turns[i].speaker = 'user') as user_at from t),
c as (select *, k % 9 <> 0 as cued, pos < n as inside, coalesce(turns[pos + 1].speaker = 'user', false) as on_user, turns[1].speaker = 'user' as first_user, kind in ('occurred_evidence', 'upcoming_evidence') as evidence,
    user_at[least(1 + k % 3, len(user_at))] - 1 as deadline_at from s),
m as (select *, unnest([substr(t0, 1, 6), 'qqq9']) as must from c), f as (select *, unnest(['ing', 'zz9']) as term from c),
v as (
select k, 'first_turn_not_user' as code, 1 as n from c where turns[1].speaker <> 'user'
union all select k, 'last_turn_not_assistant', 1 from c where turns[n].speaker <> 'assistant'
union all select k, 'speaker_alternation', 1 from c where len(list_filter(range(2, n + 1), lambda i: turns[i].speaker = turns[i - 1].speaker)) > 0
union all select k, 'fa_code_leakage', 1 from c where regexp_matches(visible, 'FA-[0-9]{2}')
union all select k, 'cue_index_out_of_range', 1 from c where cued and not inside
union all select k, 'cue_not_user_turn', x::int + y::int from (select k, cued and inside and not on_user as x, cued and not first_user as y from c) where x or y
union all select k, 'cue_text_not_in_annotated_turn', x::int + y::int from (select k, cued and on_user and substr(t0, 1, 12) <> '' and not contains(turns[pos + 1].text, substr(t0, 1, 12)) as x, cued and first_user and k % 6 = 0 and not contains(t0, 'zzz9') as y from c) where x or y
union all select k, 'cue_linked_path_not_target', 1 from c where cued and k % 3 = 2
union all select k, 'missing_cue_annotation', 1 from c where not cued
union all select k, 'missing_memory_fact_grounding', 1 from c where k % 2 = 0 or not cued
union all select k, 'stale_old_current_confusion', 1 from c where kind = 'stale_recall_session'
union all select k, 'evidence_dimension_annotation_mismatch', 1 from c where cued and evidence and k % 2 = 1
union all select k, u.code, 1 from c, (values ('required_evidence_not_realized'), ('insufficient_event_evidence'), ('generic_financial_task_only')) u(code) where evidence and not (cued and on_user and k % 2 = 0)
union all select k, 'evidence_revealed_too_late', 1 from c where evidence and cued and on_user and k % 4 <> 0 and pos > deadline_at
union all select k, 'hard_negative_unintended_update', 1 from c where cued and (kind = 'hard_negative' or k % 8 = 0)
union all select k, 'missing_required_cue', count(*) from m where must <> '' and not contains(visible, must) group by 1
union all select k, 'required_cue_not_in_user_turn', count(*) from m where must <> '' and contains(visible, must) and not contains(user_text, must) group by 1
union all select k, 'required_cue_not_annotated', count(*) from m where must <> '' and contains(visible, must) and not (cued and (on_user and contains(turns[pos + 1].text, must) or first_user and contains(t0, must))) group by 1
union all select k, 'forbidden_term', count(*) from f where contains(visible, term) group by 1
union all select k, 'status_inconsistent', 1 from c where kind in ('hard_negative', 'routine_financial') and status <> 'no_event'
union all select k, 'occurred_without_consequence_cue', 1 from c where status = 'occurred' and kind = 'occurred_evidence' and not cued)
select k as session_id, code, n::bigint as n from v"""


@query(_BASE_SQL)
def session_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules that sessions break, how often."""
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("k")).agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    c = c.select("k", F.transform("t", lambda x: F.struct(x["speaker"].alias("speaker"), x["text"].alias("text"))).alias("turns"), F.get("t", F.lit(0))["text"].alias("t0"))
    return rules.session_audit(c.selectExpr("k as session_id", *_columns(_PLAN)))


def _columns(listed: str) -> list[str]:
    """The columns of a select list: split at commas outside of brackets."""
    out, depth, last = [], 0, 0
    for i, ch in enumerate(listed):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(listed[last:i])
            last = i + 1
    return [*out, listed[last:]]
