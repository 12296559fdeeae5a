"""Queries of the scores of cells, pairs and ledgers, on histories made of the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators import align, scoring as S, windows
from tidemark.operators.aggregates import macro
from tidemark.plans._base import query, table


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with double columns (or those named) rounded to six places, as in the SQL."""
    names = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, 6) for c in names})


# -- cells: of a user, a path (key modulo 7) and a third of the month -----------------

_CELLS = """with e as (select user_id, json_extract_string(props, '$.k')::int as k, event_type, event_id, day(ts) // 10 + 1 as cp from events),
c as (select user_id as trajectory, k % 7 as pn, cp as checkpoint, max_by(event_type, event_id) as gold, min_by(event_type, event_id) as predicted, 'view' as initial, count(*) > 1 as is_predicted, list_distinct(list(event_type)) as ge, min(event_type) as pe from e group by 1, 2, 3),
b as (select *, gold <> initial as gold_changed, is_predicted and predicted <> initial as predicted_changed, is_predicted and predicted = gold as cell_correct, pn < 4 as dynamic, 1 + pn % checkpoint as event from c),
o as (select *, case when gold_changed and predicted_changed and cell_correct then 'tp_correct' when gold_changed and predicted_changed then 'tp_wrong_value' when gold_changed then 'fn' when predicted_changed then 'fp' else 'tn' end as classification from b)"""
_COUNTS = ", ".join(f"count_if(classification = '{k}') as {k}" for k in S.CLASSES)
_CHANGE = """case when tp_correct + tp_wrong_value + fp > 0 then (tp_correct + tp_wrong_value) / (tp_correct + tp_wrong_value + fp) else 0.0 end as dp, (tp_correct + tp_wrong_value) / nullif(tp_correct + tp_wrong_value + fn, 0) as dr,
case when tp_correct + tp_wrong_value + fp > 0 then tp_correct / (tp_correct + tp_wrong_value + fp) else 0.0 end as cp, tp_correct / nullif(tp_correct + tp_wrong_value + fn, 0) as cr"""
_F1 = lambda p, r: f"case when {p} is not null and {r} is not null then case when {p} + {r} > 0 then 2 * {p} * {r} / ({p} + {r}) else 0.0 end end"


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type", "event_id", (F.floor(F.dayofmonth("ts") / 10) + 1).cast("int").alias("checkpoint"))
    c = e.groupBy(F.col("user_id").alias("trajectory"), (F.col("k") % 7).alias("pn"), "checkpoint").agg(
        F.max_by("event_type", "event_id").alias("gold"), F.min_by("event_type", "event_id").alias("predicted"), F.lit("view").alias("initial"), (F.count(F.lit(1)) > 1).alias("is_predicted"),
        F.collect_set("event_type").alias("gold_evidence"), F.array(F.min("event_type")).alias("predicted_evidence"),
    )
    c = c.withColumns({"path": F.concat(F.lit("p"), F.col("pn")), "dynamic": F.col("pn") < 4, "gold_events": F.array(F.format_string("D%03d", 1 + F.col("pn") % F.col("checkpoint")))})
    return S.cell_outcomes(c)


@query(f"""{_CELLS}, s as (select trajectory, checkpoint, count(*) as cells, count_if(cell_correct) as right_, count_if(dynamic) as d, count_if(dynamic and cell_correct) as dc, count_if(gold_changed) as changed, count_if(not gold_changed) as unchanged,
count_if(not gold_changed and not predicted_changed and cell_correct) as uc, count_if(gold_changed and list_contains(ge, pe)) as hits, count_if(gold_changed) as cited, {_COUNTS} from o group by 1, 2), m as (select *, {_CHANGE} from s)
select trajectory, checkpoint::int as checkpoint, round(right_ / cells, 6) as final_state_accuracy, round(dc / nullif(d, 0), 6) as dynamic_path_final_state_accuracy, round(tp_correct / nullif(changed, 0), 6) as changed_state_accuracy, round(uc / nullif(unchanged, 0), 6) as unchanged_state_accuracy,
right_ = cells as exact_state_match, round({_F1('dp', 'dr')}, 6) as change_detection_f1, round({_F1('cp', 'cr')}, 6) as correct_change_f1, round(hits / nullif(changed, 0), 6) as evidence_hit_rate, round(hits / nullif(cited, 0), 6) as evidence_citation_precision from m""")
def cell_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores of every state."""
    names = ("final_state_accuracy", "dynamic_path_final_state_accuracy", "changed_state_accuracy", "unchanged_state_accuracy", "exact_state_match", "change_detection_f1", "correct_change_f1", "evidence_hit_rate", "evidence_citation_precision")
    return r6(S.cell_scores(_outcomes(spark, sf_dir), ["trajectory", "checkpoint"]).select("trajectory", "checkpoint", *names))


@query(f"""{_CELLS}, s as (select trajectory, checkpoint, count_if(cell_correct) / count(*) as a, count_if(classification = 'tp_correct') / nullif(count_if(gold_changed), 0) as ch, {_COUNTS} from o group by 1, 2),
t as (select trajectory, avg(a) as a, avg(ch) as ch, sum(tn) as tn, sum(fp) as fp, sum(fn) as fn, sum(tp_correct) as tp_correct, sum(tp_wrong_value) as tp_wrong_value, count(*) as items from s group by 1)
select round(avg(a), 6) as final_state_accuracy, round(avg(ch), 6) as changed_state_accuracy, sum(tn)::bigint as tn, sum(fp)::bigint as fp, sum(fn)::bigint as fn, sum(tp_correct)::bigint as tp_correct, sum(tp_wrong_value)::bigint as tp_wrong_value, sum(items)::bigint as items, count(*) as trajectories from t""")
def state_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro means over trajectories and summed confusion."""
    scores = S.cell_scores(_outcomes(spark, sf_dir), ["trajectory", "checkpoint"])
    return r6(S.summarized(scores, "trajectory", ["final_state_accuracy", "changed_state_accuracy"], S.CLASSES))


@query(f"{_CELLS} select gold as gold_status, case when is_predicted then predicted else 'invalid/missing' end as predicted_status, count(*) as n from o group by 1, 2")
def status_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outcomes(spark, sf_dir).withColumn("predicted", F.when(F.col("is_predicted"), F.col("predicted")))
    return S.status_confusion(rows, "gold", "predicted")


@query(f"""{_CELLS}, s as (select trajectory, pn, avg(cell_correct::int) as fa, {_COUNTS} from o group by 1, 2), m as (select *, {_CHANGE} from s),
ev as (select trajectory, pn, event, arg_min(cell_correct::int, checkpoint) as up, avg(cell_correct::int) as kept from o where gold_changed group by 1, 2, 3), et as (select trajectory, pn, count(*) as n, avg(up) as up, avg(kept) as kept from ev group by 1, 2)
select 'p' || pn as path, count(et.n) as eligible_trajectories, count(*) as reported_trajectories, coalesce(sum(et.n), 0)::bigint as update_events, round(avg(fa), 6) as final_state_accuracy, round(avg(case when et.n is not null then {_F1('cp', 'cr')} end), 6) as correct_change_f1,
round(avg(et.up), 6) as event_macro_update_accuracy, round(avg(et.kept), 6) as retention_after_update, sum(fp)::bigint as fp from m left join et using (trajectory, pn) group by pn""")
def path_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each path over trajectories."""
    names = ("path", "eligible_trajectories", "reported_trajectories", "update_events", "final_state_accuracy", "correct_change_f1", "event_macro_update_accuracy", "retention_after_update", "fp")
    return r6(S.path_macro(_outcomes(spark, sf_dir)).select(*names))


_UPDATES = f"{_CELLS}, u as (select trajectory, event, checkpoint, checkpoint - event as lag, avg(cell_correct::int) as score, bool_and(cell_correct) as exact from o where gold_changed group by 1, 2, 3)"


@query(f"""{_UPDATES}, v as (select trajectory, event, arg_min(score, checkpoint) as f, arg_min(exact::int, checkpoint) as x, min(lag) as lag, avg(score) as kept from u group by 1, 2),
t as (select trajectory, avg(f) as f, avg(x) as x, avg(kept) as kept, count(*) as n, sum(lag) as lags from v group by 1)
select round(avg(f), 6) as update_accuracy, round(avg(x), 6) as exact_update_accuracy, round(avg(kept), 6) as retention, sum(n)::bigint as events, count(*) as trajectories, round(sum(lags) / sum(n), 6) as mean_first_lag from t""")
def event_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update accuracy at the first checkpoint of each event."""
    return r6(S.event_macro(_outcomes(spark, sf_dir)))


_LAGS = ((0, "0"), (15, "1-15"), (30, "16-30"), (60, "31-60"), (120, "61-120"), (180, "121-180"), (240, "181-240"))


@query(f"""{_UPDATES}, v as (select case {" ".join(f"when lag * 70 <= {hi} then '{b}'" for hi, b in _LAGS)} else '241+' end as lags, trajectory, event, avg(score) as score from u group by 1, 2, 3), t as (select lags, trajectory, avg(score) as score, count(*) as events from v group by 1, 2)
select lags, round(avg(score), 6) as score, sum(events)::bigint as events, count(*) as trajectories from t group by 1""")
def retention_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention by bucket of lag; a checkpoint counts as 70 sessions."""
    return r6(S.retention_curve(_outcomes(spark, sf_dir), windows.lag_bucket(F.col("lag") * 70)).withColumnRenamed("at", "lags"))


@query("""with a as (select user_id, coalesce(case when event_id % 3 = 0 then event_type end, json_extract_string(props, '$.k')) as t, event_type = 'purchase' as ok from events), b as (select user_id, t, avg(ok::int) as s from a group by 1, 2)
select user_id, round(avg(s), 6) as score, count(*) as targets from b group by 1""")
def hierarchical_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to targets to trajectories; a target is named by the first name that it has."""
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("a"), F.get_json_object("props", "$.k").alias("b"), (F.col("event_type") == "purchase").alias("ok"))
    return r6(S.hierarchical(e, "user_id", ["a", "b"], "ok"))


@query(f"{_CELLS}, w as (select pn, gold, lag(gold) over (partition by trajectory, pn order by checkpoint) as b from o) select distinct 'p' || pn as path from w where b is not null and b <> gold")
def dynamic_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths whose value changes between two checkpoints of any trajectory."""
    return S.dynamic_paths(_outcomes(spark, sf_dir), ["trajectory"], "path", "checkpoint", "gold")


# -- pairs: purchases as gold, clicks as predictions, of a user and a third of the month ---

_PAIRS = """with e as (select user_id as trajectory, day(ts) // 10 + 1 as checkpoint, 'e' || json_extract_string(props, '$.k')::int % 3 as event, 'D' || lpad(day(ts)::varchar, 3, '0') as session, event_type from events),
c as (select trajectory, checkpoint, event, session, count_if(event_type = 'purchase') as g, count_if(event_type = 'click') as p from e group by all having count_if(event_type in ('purchase', 'click')) > 0),
i as (select trajectory, checkpoint, count_if(event_type = 'error') as n from e group by 1, 2),
s as (select trajectory, checkpoint, n as n_invalid, coalesce(sum(least(g, p)), 0) as tp, coalesce(sum(g), 0) as n_gold, coalesce(sum(p), 0) as n_valid, coalesce(count_if(p > 0), 0) as n_distinct, coalesce(bool_and(g = p), true) as same from i left join c using (trajectory, checkpoint) group by 1, 2, 3),
ev as (select trajectory, checkpoint, sum(least(g, p)) as etp from (select trajectory, checkpoint, event, sum(g) as g, sum(p) as p from c group by 1, 2, 3) group by 1, 2),
x as (select *, n_valid + n_invalid as n_pred, case when n_valid + n_invalid = 0 and n_gold = 0 then 1.0 when n_valid + n_invalid = 0 or n_gold = 0 then 0.0 else 2 * tp / (n_valid + n_invalid + n_gold) end::double as f1,
    case when n_valid = 0 and n_gold = 0 then 1.0 when n_valid = 0 or n_gold = 0 then 0.0 else 2 * coalesce(etp, 0) / (n_valid + n_gold) end::double as event_f1 from s left join ev using (trajectory, checkpoint))"""


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("trajectory"), (F.floor(F.dayofmonth("ts") / 10) + 1).alias("checkpoint"), F.concat(F.lit("e"), F.get_json_object("props", "$.k").cast("int") % 3).alias("event"), F.format_string("D%03d", F.dayofmonth("ts")).alias("session"), "event_type")
    return e.filter("event_type = 'purchase'"), e.filter("event_type = 'click'"), e


_KEYS = ["trajectory", "checkpoint"]


def _pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, predicted, e = _pairs(spark, sf_dir)
    return S.pair_scores(gold, predicted, e.groupBy(*_KEYS).agg(F.count_if(F.col("event_type") == "error").alias("n")), _KEYS)


@query(f"{_PAIRS} select trajectory, checkpoint, tp::bigint as tp, n_pred::bigint as n_pred, n_gold::bigint as n_gold, round(f1, 6) as f1, round(event_f1, 6) as event_f1, (n_valid - n_distinct)::bigint as duplicates, (n_pred - n_gold)::bigint as count_bias, (same and n_invalid = 0)::int::double as exact from x")
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict multiset scores of every item; an invalid record is a false positive."""
    return r6(_pair_scores(spark, sf_dir).select(*_KEYS, "tp", "n_pred", "n_gold", "f1", "event_f1", "duplicates", "count_bias", "exact"))


@query(f"""{_PAIRS}, m as (select checkpoint, avg(f1) as f1, sum(tp) as tp, sum(n_pred) as np, sum(n_gold) as ng from x group by 1)
select count(*) as n_checkpoints, round(avg(f1), 6) as auc_f1, round(avg(2 * tp / (np + ng)), 6) as auc_micro_f1, round(max_by(f1, checkpoint), 6) as final_f1, round(max_by(2 * tp / (np + ng), checkpoint), 6) as final_micro_f1 from m""")
def pair_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro and micro scores of each checkpoint, then their equal-weight mean and the last."""
    per = S.pair_checkpoints(_pair_scores(spark, sf_dir), "checkpoint", ["f1"])
    return r6(S.checkpoint_auc(per, "checkpoint", ["f1", "micro_f1"]))


@query(f"""{_PAIRS}, ty as (select trajectory, checkpoint, session, case max(event_type) when 'view' then 'cancellation_evidence' when 'signup' then 'hard_negative' else 'occurred_evidence' end as type from e group by 1, 2, 3),
ge as (select trajectory, checkpoint, session, min(event) as ge from c where g > 0 group by 1, 2, 3), k as (select distinct trajectory, checkpoint, event, true as known from c where g > 0),
su as (select trajectory, checkpoint, event, session, p - least(g, p) as s, least(p - 1, p - least(g, p)) as dup from c where p > g),
j as (select su.*, case when type = 'cancellation_evidence' then 'prediction_at_cancellation_session' when type = 'hard_negative' then 'prediction_at_hard_negative_session' when ge <> event then 'wrong_event_at_gold_occurred_session' when known and type = 'occurred_evidence' then 'correct_event_at_wrong_occurred_session' else 'other' end as category
    from su left join ty using (trajectory, checkpoint, session) left join ge using (trajectory, checkpoint, session) left join k using (trajectory, checkpoint, event))
select category, sum(n)::bigint as n from (select 'duplicate_pair' as category, dup as n from j union all select category, s - dup from j) where n > 0 group by 1""")
def pair_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong pairs by kind of error."""
    gold, predicted, e = _pairs(spark, sf_dir)
    kind = F.when(F.col("t") == "view", S.CANCELLATION).when(F.col("t") == "signup", S.HARD_NEGATIVE).otherwise(S.OCCURRED)
    sessions = e.groupBy(*_KEYS, "session").agg(F.max("event_type").alias("t")).withColumn("type", kind)
    return S.pair_errors(gold, predicted, sessions, _KEYS).groupBy("category").agg(F.sum("n").alias("n"))


# -- ledgers: even days as gold, odd days as predictions, of a user and a month -----------


def _ledgers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.element_at(F.array(*map(F.lit, S.STATUSES[:4])), k % 4 + 1)
    day = lambda c: F.format_string("D%03d", c)
    rows = e.select(F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM")).alias("item"), F.col("event_id").cast("int").alias("ord"), F.col("event_type").alias("event"), status.alias("status"), F.dayofmonth("ts").alias("anchor"), F.array(day(k % 3), day(k % 5)).alias("core"), F.array(day(k % 2)).alias("supporting"), (k % 101 / F.lit(100.0)).alias("confidence"))
    return rows.filter("anchor % 2 = 0"), rows.filter("anchor % 2 = 1")


@query()
def item_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores of each aligned ledger."""
    return r6(S.item_scores(*_ledgers(spark, sf_dir)))


@query()
def ledger_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over a user's months, then over users."""
    s = S.item_scores(*_ledgers(spark, sf_dir)).withColumn("user", F.split("item", ":")[0])
    return r6(macro(s, [["user"]], ["full_ledger_event_f1", "status_macro_f1", "core_evidence_f1", "brier_score"]))


@query("""select distinct user_id, event_id, row_number() over (partition by user_id order by json_extract_string(props, '$.k')::int, event_id) as ord from events""")
def prediction_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions by the number of their first evidence, then as given."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return align.order_predictions(e, ["user_id"], "k", "event_id").select("user_id", "event_id", F.col("ord").cast("long").alias("ord"))


# -- other summaries --------------------------------------------------------------------


@query("select event_type, round(avg(value), 6) as mean, round(median(value), 6) as median, count(value) as n from events group by 1")
def grouped_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(S.grouped_summary(table(spark, sf_dir, "events"), ["event_type"], "value"))


@query("select o_orderpriority, o_orderstatus, round(avg((o_totalprice > 100000)::int), 6) as accuracy, count(*) as n from orders group by 1, 2")
def arm_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of right answers in each arm."""
    return r6(S.arm_means(table(spark, sf_dir, "orders").withColumn("ok", F.col("o_totalprice") > 100_000), ["o_orderpriority", "o_orderstatus"], "ok"))


_USE = "select event_type, case when json_extract_string(props, '$.k')::int % 3 = 0 then json_extract_string(props, '$.k')::bigint end as a, case when event_type = 'click' then null else event_id end as b from events"


@query(f"select event_type, count(*) as calls, sum(a)::bigint as a, sum(b)::bigint as b, count_if(a is null)::bigint as missing_a, count_if(b is null)::bigint as missing_b from ({_USE}) group by 1")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums that stay null where nothing was reported."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").select("event_type", F.when(k % 3 == 0, k).alias("a"), F.when(F.col("event_type") != "click", F.col("event_id")).alias("b"))
    return S.usage_totals(e, ["event_type"], ["a", "b"])


@query("select l_returnflag, key, sum(v)::bigint as total from (select l_returnflag, unnest(['lines', 'quantity', l_linestatus]) as key, unnest([1, l_quantity::bigint, l_linenumber]) as v from lineitem) group by 1, 2")
def map_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of map values by key."""
    usage = F.create_map(F.lit("lines"), F.lit(1).cast("long"), F.lit("quantity"), F.col("l_quantity").cast("long"), F.col("l_linestatus"), F.col("l_linenumber").cast("long"))
    return S.map_totals(table(spark, sf_dir, "lineitem").select("l_returnflag", usage.alias("u")), ["l_returnflag"], "u")


def _metadata(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    put = lambda kind, name, v: F.when(F.col("event_type") == kind, F.create_map(F.lit(name), v)).otherwise(F.create_map(F.lit("other"), v))
    return e.select("event_id", "event_type", put("click", "input_tokens", k).alias("meta"), put("view", "prompt_tokens", F.col("event_id").cast("string")).alias("usage"))


@query("select event_id, case event_type when 'click' then json_extract_string(props, '$.k') when 'view' then event_id::varchar end as input_tokens, coalesce(json_extract_string(props, '$.k'), event_id::varchar) as any_tokens from events")
def provider_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts under whatever name a provider gives them."""
    names = {"input_tokens": ("input_tokens", "prompt_tokens"), "any_tokens": ("input_tokens", "other", "prompt_tokens")}
    return _metadata(table(spark, sf_dir, "events")).select("event_id", *[c.alias(n) for n, c in S.provider_usage("meta", "usage", names).items()])


@query("""select event_id, concat_ws(',', case when value < 10 then 'low' end, case when event_type = 'error' then 'failed' end, case when k = 0 and event_type <> 'view' then 'no_count' end) as fatal,
case when k = 0 and event_type = 'view' then 'no_count' else '' end as gaps from (select *, json_extract_string(props, '$.k')::int % 5 as k from events)""")
def contract_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken terms of a call, split into fatal ones and gaps in what was reported."""
    no = F.lit(False)
    rules = [("low", F.col("value") < 10, no), ("failed", F.col("event_type") == "error", no), ("no_count", F.get_json_object("props", "$.k").cast("int") % 5 == 0, F.col("event_type") == "view")]
    fatal, gaps = S.contract_reasons(rules)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(fatal, ",").alias("fatal"), F.array_join(gaps, ",").alias("gaps"))


@query("select (p_size // 10 * 10)::int as decade, count(*) as n from part group by 1")
def decades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.decades(table(spark, sf_dir, "part"), "p_size")


@query("select n_regionkey, array_to_string(list_sort(list_distinct(list(n_name))), ',') as names from nation group by 1")
def distinct_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.distinct_sets(table(spark, sf_dir, "nation"), ["n_regionkey"], "n_name").select("n_regionkey", F.array_join("values", ",").alias("names"))


@query("""select o_orderpriority, count(*) as n, round(avg(coalesce(a, false)::int), 6) as a, round(avg(b::int), 6) as b, round(avg((coalesce(a, false) and b)::int), 6) as all_pass
from (select o_orderpriority, case when o_orderstatus <> 'P' then o_totalprice > 50000 end as a, o_orderkey % 7 > 0 as b from orders) group by 1""")
def pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rows that pass each check; no verdict is a failure."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") > 50_000).alias("a"), (F.col("o_orderkey") % 7 > 0).alias("b"))
    return r6(S.pass_rates(o, ["o_orderpriority"], ["a", "b"]))


@query("select user_id, json_extract_string(props, '$.k')::int as instance, max_by(event_type, event_id) as last_status, bool_or(event_type = 'occurred') as recovered from events group by 1, 2")
def last_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last status of each instance."""
    e = table(spark, sf_dir, "events").withColumn("instance", F.get_json_object("props", "$.k").cast("int"))
    return S.last_status(e, ["user_id", "instance"], "event_id", "event_type")


@query("""with t as (select user_id, event_type, min(day(ts)) as first_cp from events group by 1, 2), c as (select distinct user_id, day(ts) as cp from events) select t.user_id, event_type, first_cp::int as first_cp, cp::int as cp from t join c on t.user_id = c.user_id and first_cp <= cp""")
def frozen_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target at all of its user's days from its first one on."""
    e = table(spark, sf_dir, "events").withColumn("cp", F.dayofmonth("ts"))
    first = e.groupBy("user_id", "event_type").agg(F.min("cp").alias("first_cp"))
    return S.frozen_targets(first, e, ["user_id"], "first_cp", "cp").select("user_id", "event_type", "first_cp", "cp")


@query("""with s as (select user_id, json_extract_string(props, '$.k')::int % 9 as instance, event_id, event_type = 'purchase' as strong, value < 20 as low from events), n as (select *, lead(event_id) over (partition by user_id, instance order by event_id) as nx from s),
f as (select user_id, instance, min(event_id) filter (where strong) as f, arg_min(nx, event_id) filter (where strong and nx is not null) as unused, max(event_id) as last from n group by 1, 2)
select f.user_id, f.instance, coalesce(case when n.low then coalesce(n.nx, f.last) else f.f end, f.last) as first_recoverable from f left join n on n.user_id = f.user_id and n.instance = f.instance and n.event_id = f.f""")
def first_recoverable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event from which an instance can be known."""
    e = table(spark, sf_dir, "events").withColumn("instance", F.get_json_object("props", "$.k").cast("int") % 9)
    return S.first_recoverable(e, ["user_id", "instance"], "event_id", F.col("event_type") == "purchase", F.col("value") < 20)
