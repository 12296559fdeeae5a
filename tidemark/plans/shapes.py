"""Queries of projections, predicates, parsers and answers, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import answers as A, dates
from tidemark.operators import masking, memory, parsing, projections as P, scoring as S
from tidemark.plans._base import query, table

_K = "json_extract_string(props, '$.k')::int"


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


# -- state ------------------------------------------------------------------------------

_PROPS = """p as (select o_custkey as c, list(struct_pack(id := o_orderkey::varchar, a := o_orderpriority, o := case when o_orderstatus = 'O' then 'owned' else 'rented' end, m := o_orderstatus, r := case when o_orderkey % 2 = 0 then 'primary_residence' else 'other' end)) as ps, max(o_orderkey)::varchar as pid from orders group by 1),
x as (select c, pid, unnest(ps) as q from p), y as (select c, q.a as a, q.o as o, q.m as m, case when q.id = pid then 'primary_residence' when q.o = 'owned' and q.r = 'primary_residence' then 'secondary_property' else q.r end as r, q.id = pid as mine from x)"""


def _properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    p = F.struct(F.col("o_orderkey").cast("string").alias("property_id"), F.col("o_orderpriority").alias("address"), F.when(F.col("o_orderstatus") == "O", "owned").otherwise("rented").alias("ownership_status"), F.col("o_orderstatus").alias("mortgage_status"), F.when(F.col("o_orderkey") % 2 == 0, P.PRIMARY).otherwise("other").alias("role"))
    return o.groupBy("o_custkey").agg(F.collect_list(p).alias("properties"), F.max("o_orderkey").cast("string").alias("primary_id"))


@query(f"with {_PROPS} select c as o_custkey, string_agg(a || '/' || r || '/' || o || '/' || m, ';' order by a, r, o, m) as shown from y group by 1")
def project_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as properties, in order, the last one as primary residence."""
    shown = F.transform(P.projected_properties(F.col("properties"), F.col("primary_id")), lambda p: F.concat_ws("/", p["address"], p["role"], p["ownership_status"], p["mortgage_status"]))
    # ties of address, role and ownership have no stated order
    same = F.array_join(F.array_sort(shown), ";")
    return _properties(spark, sf_dir).select("o_custkey", same.alias("shown"))


@query(f"with {_PROPS} select c as o_custkey, max(case when mine then a || '/' || o end) as shown, (count_if(o = 'owned' and r = 'primary_residence') <> 1)::boolean as mismatch from y group by 1")
def primary_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The property that the pointer names, and whether the list agrees with it."""
    d = _properties(spark, sf_dir).withColumn("one", P.primary_property(F.col("properties"), F.col("primary_id")))
    errors = P.property_errors(P.projected_properties(F.col("properties"), F.col("primary_id")), F.col("one"))
    return d.select("o_custkey", F.concat_ws("/", "one.address", "one.ownership_status").alias("shown"), F.array_contains(errors, "pointer_collection_mismatch").alias("mismatch"))


@query(f"""with b as (select user_id, event_id, {_K} as k from events) select event_id, case event_id % 5 when 0 then k::varchar when 1 then (k % 4)::varchar when 2 then '["a","b"]' when 3 then (k % 3)::varchar else 'street ' || k end as value from b""")
def target_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five kinds of question ask of a JSON value."""
    k, which = _k(), F.col("event_id") % 5
    owned = F.array_join(F.concat(F.array_repeat(F.lit('{"ownership_status":"owned"}'), k % 3), F.array(F.lit('{"ownership_status":"sold"}'))), ",")
    numbers = F.array_join(F.array_repeat(F.lit("7"), k % 4), ",")
    house = F.concat(F.lit('[{"property_id":"h1","address":"street '), k.cast("string"), F.lit('"},{"property_id":"h2","address":"none"}]'))
    e = table(spark, sf_dir, "events").select("event_id", "props", F.concat(F.lit("["), numbers, F.lit("]")).alias("n"), F.concat(F.lit("["), owned, F.lit("]")).alias("o"), house.alias("h"))
    value = (
        F.when(which == 0, P.target_value(F.col("props"), "dict_key", "k")).when(which == 1, P.target_value(F.col("n"), "list_count")).when(which == 2, P.target_value(F.lit('["a","b"]'), "list_values"))
        .when(which == 3, P.target_value(F.col("o"), "owned_property_count")).otherwise(P.target_value(F.lit('"h1"'), "primary_residence_address", properties=F.col("h")))
    )
    return e.select("event_id", value.alias("value"))


@query(f"""select event_id, case event_id % 4 when 0 then {_K}::varchar when 1 then case when event_type = 'view' then 'no_change' else 'late' end when 2 then case when event_type = 'click' then 'second' else 'third' end else case event_type when 'click' then 'mortgage' else 'none' end end as value from events""")
def masked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What masked questions show: amounts, stages, the last property that an event touches, its loan."""
    which, kind = F.col("event_id") % 4, F.col("event_type")
    op = F.when(kind == "view", "no_change").otherwise("update")
    listed = F.lit('[{"address":"first","acquisition_event_instance_id":"click","mortgage_status":"none"},{"address":"second","disposal_event_instance_id":"click","mortgage_status":"active"},{"address":"third","mortgage_status":"none","event_instance_id":"other"}]')
    other = F.when(kind == "click", "click").otherwise("other")
    value = (
        F.when(which == 0, P.masked_value(F.concat(F.lit('{"amount":'), _k().cast("string"), F.lit("}")), "amount_krw", kind, op)).when(which == 1, P.masked_value(F.lit('"late"'), "stage_transition", kind, op))
        .when(which == 2, P.masked_value(listed, "property_address", kind, op)).otherwise(P.masked_value(listed, "property_loan_type", other, op))
    )
    return table(spark, sf_dir, "events").select("event_id", value.alias("value"))


_STAGES = ("view", "click", "signup", "purchase", "error")


@query("""with t as (select event_id, event_type, coalesce(lag(event_type) over (partition by user_id order by ts), 'view') as b from events), f as (select *, case event_type when 'view' then 'view' when 'click' then 'view' when 'signup' then 'click' when 'purchase' then 'signup' else 'purchase' end as n from t)
select event_id, n as stage_before, event_type as stage_after, b <> n as changed from f""")
def fixed_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions that start at the stage before their new one."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events").withColumn("stage_before", F.coalesce(F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts")), F.lit("view"))).withColumnRenamed("event_type", "stage_after")
    return P.fixed_transitions(e.select("event_id", "stage_before", "stage_after"), "stage_before", "stage_after", _STAGES)


# -- visibility ----------------------------------------------------------------------------


@query("""with s as (select user_id, list('S' || lpad(event_id::varchar, 7, '0') order by event_id) as ids from events group by 1), c as (select *, unnest(['full_prefix', 'last_15', 'oracle_evidence']) as condition from s)
select user_id, condition, len(x)::bigint as n, coalesce(x[1], '') as first_id, coalesce(x[-1], '') as last_id from (select user_id, condition, case condition when 'full_prefix' then ids when 'last_15' then ids[-15:] else list_filter(ids, lambda i: i like '%7') end as x from c)""")
def visible_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's sessions under each condition of visibility."""
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.format_string("S%07d", "event_id"))).alias("ids"))
    s = s.withColumn("condition", F.explode(F.array(*map(F.lit, ("full_prefix", "last_15", "oracle_evidence"))))).withColumn("evidence", F.filter("ids", lambda i: i.endswith("7")))
    x = s.withColumn("x", P.visible_for(F.col("ids"), F.col("condition"), F.col("evidence")))
    edge = lambda i: F.coalesce(F.try_element_at("x", F.lit(i)), F.lit(""))
    return x.select("user_id", "condition", F.size("x").cast("long").alias("n"), edge(1).alias("first_id"), edge(-1).alias("last_id"))


@query("""with s as (select user_id, list(event_id order by event_id) as ids, count(*) as n from events group by 1) select user_id, 0::bigint as none, least(n, 1) as last, case when n > 0 then greatest(1, n // 3) else 0 end as last_third, ids[(n - greatest(1, n // 3) + 1)::int] as third_from from s""")
def visible_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a history each mode shows, and where its last third begins."""
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids")).withColumn("ids", F.transform("ids", lambda i: i.cast("string")))
    modes = {m: P.visible_history(F.col("ids"), m) for m in ("none", "last", "last_third")}
    return s.select("user_id", *[F.size(c).cast("long").alias(m) for m, c in modes.items()], F.element_at(modes["last_third"], 1).cast("long").alias("third_from"))


@query(f"select event_id, day(ts)::int as checkpoint, 'D' || lpad(({_K} % 40)::varchar, 3, '0') as late from events where {_K} % 40 > day(ts)")
def future_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that cite evidence from behind their checkpoint."""
    e = table(spark, sf_dir, "events").select("event_id", F.dayofmonth("ts").alias("checkpoint"), F.array(F.lit("D000"), F.format_string("D%03d", _k() % 40)).alias("evidence"))
    return P.future_evidence(e, "evidence", "checkpoint").select("event_id", "checkpoint", "late")


@query(f"""with h as (select user_id, list(struct_pack(s := event_type, m := day(ts)::int) order by event_id) as hs from events group by 1) select user_id, m::int as month, coalesce(list_filter(hs, lambda h: h.m <= m)[-1].s, 'none') as status from h, (select unnest([1, 10, 20, 31]) as m)""")
def status_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last status of a user's history at four months."""
    h = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("status"), F.dayofmonth("ts").alias("month")))).alias("h"))
    h = h.withColumn("month", F.explode(F.array(*map(F.lit, (1, 10, 20, 31)))))
    return h.select("user_id", "month", F.coalesce(P.status_as_of(F.col("h"), F.col("month")), F.lit("none")).alias("status"))


# -- registry conditions ---------------------------------------------------------------------


@query(f"""select event_id, {_K} % 2 = 0 and event_type in ('click', 'view') as equal, coalesce(case when {_K} % 3 > 0 then event_type end = 'purchase', false) as missing, true as empty from events""")
def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions on the parameters of events: equal, a member, missing, none."""
    params = F.map_filter(F.create_map(F.lit("parity"), (_k() % 2).cast("string"), F.lit("kind"), F.col("event_type"), F.lit("rare"), F.when(_k() % 3 > 0, F.col("event_type"))), lambda k, v: v.isNotNull())
    e = table(spark, sf_dir, "events").select("event_id", params.alias("params"))
    terms = {"equal": {"parity": 0, "kind": ["click", "view"]}, "missing": {"rare": "purchase"}, "empty": {}}
    return e.select("event_id", *[memory.condition(w, "params").alias(n) for n, w in terms.items()])


@query("""select o_orderkey, case o_orderkey % 4 when 0 then o_orderstatus = 'O' when 1 then o_orderpriority like '1%' when 2 then o_orderstatus = 'O' and o_orderpriority like '1%' else false end as taken from orders""")
def selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors by label, path, both or none; one that states nothing takes nothing."""
    w = F.col("o_orderkey") % 4
    label, path = F.when(w.isin(0, 2), "O"), F.when(w.isin(1, 2), "1-URGENT")
    return table(spark, sf_dir, "orders").select("o_orderkey", P.selects(label, path, F.col("o_orderstatus"), F.array("o_orderpriority", F.lit("x"))).alias("taken"))


@query(f"""select event_id, event_type = 'click' and {_K} % 2 = 1 as param, value > 20 and {_K} % 3 = 1 as state, {_K} % 5 in (1, 3) and {_K} % 5 <> 3 as actions from events""")
def plan_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needs of a plan: parameters and statuses, state, actions of all, any and absent."""
    k = _k()
    text = lambda c: c.cast("string")
    e = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("kind"), F.col("event_type")).alias("p"), F.create_map(F.lit("odd"), text(k % 2)).alias("m"), F.create_map(F.lit("big"), F.when(F.col("value") > 20, "yes").otherwise(""), F.lit("third"), text(k % 3)).alias("s"), F.array(F.concat(F.lit("a"), text(k % 5)), F.lit("base")).alias("a"))
    need = {"param": {"param_equals": {"kind": "click"}, "memory_status": {"odd": ["1", "7"]}}, "state": {"state_truthy": ["big"], "state_equals": {"third": 1}}, "actions": {"all": ["base"], "any_of": ["a1", "a3"], "absent": ["a3"]}}
    cols = [F.col(c) for c in "pmsa"]
    return e.select("event_id", *[P.plan_condition(*cols, n).alias(name) for name, n in need.items()])


@query(f"""select event_id, concat_ws(',', case when event_type not in ('click', 'view', 'purchase') then 'invalid:kind:' || event_type end, case when {_K} % 4 = 0 then 'missing:size' when {_K} % 4 = 3 then 'invalid:size:3' end) as errors from events""")
def contract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters that are missing or not in their contract."""
    k = _k() % 4
    params = F.map_filter(F.create_map(F.lit("kind"), F.col("event_type"), F.lit("size"), F.when(k > 0, k.cast("string"))), lambda _, v: v.isNotNull())
    return table(spark, sf_dir, "events").select("event_id", F.array_join(P.contract_errors(params, {"kind": ["click", "view", "purchase"], "size": ["1", "2"]}), ",").alias("errors"))


@query(f"""select event_id, event_type = 'view' and {_K} % 3 = 0 and {_K} % 2 = 0 as neutral from events""")
def neutral_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sessions may stand in for others."""
    k = _k()
    kind = F.when(F.col("event_type") == "view", "routine_financial").otherwise("hard_negative")
    cues = F.when(k % 2 == 0, F.array(F.lit("task_intent"))).otherwise(F.array(F.lit("task_intent"), F.lit("status")))
    task = F.when(k % 3 == 0, "safe").otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", masking.is_neutral(kind, F.lit(None).cast("string"), task, ["safe"], cues, F.lit(8)).alias("neutral"))


# -- arrays and maps ----------------------------------------------------------------------------


@query("""select o_orderkey, 'a=' || o_orderstatus || ',b=' || case when o_orderkey % 2 = 0 then o_orderpriority else '1' end || ',c=' || case when o_orderkey % 2 = 0 then 'right' else '' end as entries from orders""")
def merged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps, the second one's entries on equal keys."""
    a = F.create_map(F.lit("a"), F.col("o_orderstatus"), F.lit("b"), F.lit("1"))
    b = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("b"), F.col("o_orderpriority"), F.lit("c"), F.lit("right")))
    m = table(spark, sf_dir, "orders").select("o_orderkey", P.merged(a, b).alias("m"))
    return m.select("o_orderkey", F.concat(F.lit("a="), F.col("m.a"), F.lit(",b="), F.col("m.b"), F.lit(",c="), F.coalesce("m.c", F.lit(""))).alias("entries"))


@query("""with recursive n as (select event_id, '$' as path, ('{"a":{"b":[' || props || ',{"c":{"d":[[' || event_id || ',null],{"e":{"f":"' || event_type || '","g":[],"h":true}}]}}]}}')::json as v from events
union all select event_id, case when json_type(v) = 'OBJECT' then path || '.' || k else path || '[' || k || ']' end, case when json_type(v) = 'OBJECT' then v -> ('$."' || k || '"') else v -> ('$[' || k || ']') end
from (select *, unnest(case json_type(v) when 'OBJECT' then json_keys(v) when 'ARRAY' then list_transform(range(json_array_length(v)::bigint), lambda x: x::varchar) else [] end) as k from n))
select event_id, path, v ->> '$' as value from n where json_type(v) not in ('OBJECT', 'ARRAY', 'NULL')""")
def flattened_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scalars of nested JSON texts with their paths, seven levels deep."""
    e = table(spark, sf_dir, "events")
    js = F.concat(F.lit('{"a":{"b":['), "props", F.lit(',{"c":{"d":[['), F.col("event_id").cast("string"), F.lit(',null],{"e":{"f":"'), "event_type", F.lit('","g":[],"h":true}}]}}]}}'))
    return P.flattened(e.select("event_id", js.alias("js")), ["event_id"], "js")


@query("select c_nationkey::int as c_nationkey, c_mktsegment as segment, 'n' as what, count(*)::varchar as value from customer group by 1, 2")
def composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a map whose keys are joined parts."""
    each = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).cast("string").alias("n"))
    m = each.groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "c_mktsegment", F.lit("n")), "n"))).alias("m"))
    return P.composite(m, "m", ["c_nationkey"], ["segment", "what"])


@query("select o_custkey, array_to_string(list_sort(list(o_orderkey))[1:4], ',') as first_four, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') as kinds from orders group by 1")
def capped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four of sorted values, and values once each."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("k"), F.collect_list("o_orderpriority").alias("p"))
    return o.select("o_custkey", F.array_join(P.capped(F.col("k"), 4), ",").alias("first_four"), F.array_join(F.array_sort(P.unique(F.col("p"))), ",").alias("kinds"))


# -- parsers -------------------------------------------------------------------------------------

_EVENTS_JSON = ("click", "view", "purchase")


@query(f"""with b as (select event_id, event_type as t, {_K} as k, event_id % 6 as w from events), c as (select *, k % 5 between 1 and 3 as shown from b)
select event_id, case w when 4 then 'invalid_json' when 5 then 'missing_events_list' end as parse_error, (w < 4 and t in ('click', 'view', 'purchase') and shown)::int as n_events, (w < 4 and not (t in ('click', 'view', 'purchase') and shown))::int as n_rejected,
case when w < 4 and t in ('click', 'view', 'purchase') and shown then 'S00' || k % 5 end as first_session, concat_ws('|', case when w = 3 then 'events[0]: invalid_confidence' end, case when w < 4 and t not in ('click', 'view', 'purchase') then 'events[0]: unknown_event_id' end,
    case when w < 4 and k % 5 = 4 then 'events[0]: first_evidence_session_id:not_visible' when w < 4 and k % 5 = 0 then 'events[0]: first_evidence_session_id:malformed' end) as errors from c""")
def parsed_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted ledgers in fences, prose or broken, with reasons for what is rejected."""
    k, w = _k(), F.col("event_id") % 6
    sid = F.when(k % 5 == 0, "nowhere").otherwise(F.concat(F.lit("D00"), (k % 5).cast("string")))
    confidence = F.when(w == 3, "7").otherwise("0.5")
    body = F.format_string('{"events": [{"event_id": "%s", "status": "occurred", "first_evidence_session_id": "%s", "status_anchor_session_id": "D001", "core_evidence_session_ids": ["D001", "D001"], "confidence": %s}]}', F.col("event_type"), sid, confidence)
    raw = F.when(w == 4, "{nothing").when(w == 5, '{"event": 1}').when(w == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(w == 2, F.concat(F.lit("I say "), body, F.lit(" so"))).otherwise(body)
    visible = F.create_map(*[F.lit(x) for i in (1, 2, 3) for x in (f"D00{i}", f"S00{i}")])
    p = table(spark, sf_dir, "events").select("event_id", parsing.ledger(raw, visible, _EVENTS_JSON).alias("p"))
    return p.select("event_id", "p.parse_error", F.coalesce(F.size("p.events"), F.lit(0)).alias("n_events"), F.col("p.n_rejected").alias("n_rejected"), F.try_element_at("p.events", F.lit(1))["first_evidence_session"].alias("first_session"), F.array_join(F.coalesce("p.errors", F.array()), "|").alias("errors")).withColumn("n_events", F.when(F.col("parse_error").isNotNull(), 0).otherwise(F.col("n_events")))


@query(f"""with b as (select event_id, event_type as t, {_K} as k, event_id % 5 as w from events)
select event_id, case when w = 4 then 'missing_pairs_list' end as parse_error, case when w = 4 then 0 else (t in ('click', 'view', 'purchase') and k % 3 = 1)::int + 1 end as n_pairs, case when w = 4 then 0 else (not (t in ('click', 'view', 'purchase') and k % 3 = 1))::int end as n_invalid,
case when w = 4 then '' else concat_ws('|', case when w = 3 then 'pairs[0]: unexpected_field:note' end, case when t not in ('click', 'view', 'purchase') then 'pairs[0]: unknown_event_id' end, case k % 3 when 0 then 'pairs[0]: malformed_evidence_session_id' when 2 then 'pairs[0]: session_id_not_visible' end,
    case when t in ('click', 'view', 'purchase') and k % 3 = 1 and t > 'click' then 'pairs_not_ordered_by_evidence_session' end) end as errors from b""")
def parsed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted pairs: one bad record is one invalid record."""
    k, w = _k(), F.col("event_id") % 5
    sid = F.when(k % 3 == 0, "D1").otherwise(F.concat(F.lit("D00"), (k % 3).cast("string")))
    note = F.when(w == 3, ', "note": 1').otherwise("")
    body = F.format_string('{"pairs": [{"event_id": "%s", "evidence_session_id": "%s"%s}, {"event_id": "click", "evidence_session_id": "D001"}]}', F.col("event_type"), sid, note)
    p = table(spark, sf_dir, "events").select("event_id", parsing.pairs(F.when(w == 4, '{"pairs": 3}').otherwise(body), F.array(F.lit("D001")), _EVENTS_JSON).alias("p"))
    return p.select("event_id", "p.parse_error", F.when(F.col("p.parse_error").isNull(), F.size("p.pairs")).otherwise(0).alias("n_pairs"), F.col("p.n_invalid").alias("n_invalid"), F.array_join(F.coalesce("p.errors", F.array()), "|").alias("errors"))


@query(f"""with b as (select event_id, event_type as t, {_K} as k, event_id % 5 as w from events), r as (select *, case when t = 'error' then 'invalid_status' when k % 40 > 20 then 'invalid_or_future_evidence' when k % 2 = 1 then 'invalid_closed_value' end as reason from b)
select event_id, case w when 4 then 'schema_version_mismatch' when 3 then 'invalid_json_or_missing_state' end as parse_error, (w < 3 and reason is null)::int as n_cells, case when w < 3 then concat_ws('|', case when w = 2 then 'unknown_path:z' end, 'a.' || 'x:' || reason, 'b.y:missing_or_invalid_cell') else '' end as errors from r""")
def parsed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted states: cells with allowed status, evidence that is not from the future, closed values."""
    k, w = _k(), F.col("event_id") % 5
    extra = F.when(w == 2, ', "z": {}').otherwise("")
    cell = F.format_string('{"schema_version": "%s", "state": {"a.x": {"value": %s, "status": "%s", "evidence_session_ids": ["D%03d"]}%s}}', F.when(w == 4, "v0").otherwise("v1"), F.when(k % 2 == 0, '"even"').otherwise('"odd"'), F.col("event_type"), k % 40, extra)
    p = table(spark, sf_dir, "events").select("event_id", parsing.state(F.when(w == 3, "[]").otherwise(cell), F.lit(20), "v1", ["a.x", "b.y"], ["click", "view", "purchase", "signup"], {"a.x": ["even"]}).alias("p"))
    return p.select("event_id", "p.parse_error", F.coalesce(F.when(F.col("p.parse_error").isNull(), F.size("p.cells")), F.lit(0)).alias("n_cells"), F.array_join(F.coalesce("p.errors", F.array()), "|").alias("errors"))


@query("""select event_id, case event_id % 4 when 0 then upper(substr(event_type, 1, 1)) when 1 then 'B' when 2 then 'X' else '' end as letter, case event_id % 4 when 0 then event_type when 1 then 'The answer is B' when 2 then '{"x": C }' else '-' end as free from events""")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters and free answers, in JSON or prose."""
    w = F.col("event_id") % 4
    raw = F.when(w == 0, F.concat(F.lit('ok {"answer": "'), "event_type", F.lit('"}'))).when(w == 1, "The answer is B").when(w == 2, '{"x": C }').otherwise("-")
    letter = A.choice_letter(F.when(w == 3, "none").otherwise(raw))
    return table(spark, sf_dir, "events").select("event_id", letter.alias("letter"), A.free_response(raw)["answer"].alias("free"))


@query(f"""select event_id, case event_id % 3 when 0 then 'x=1,y=' || event_type when 1 then 'x=2,y=null' else '' end as answers from events""")
def batch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by item, as an object or as a list whose later entries count; a null is an answer."""
    w = F.col("event_id") % 3
    raw = F.when(w == 0, F.concat(F.lit('{"answers": {"x": "1", "y": "'), "event_type", F.lit('"}}'))).when(w == 1, '{"answers": [{"item_id": "x", "answer": 1}, {"item_id": "y", "answer": null}, {"answer": 3}, {"item_id": "x", "answer": 2}]}').otherwise('{"answers": 3}')
    m = table(spark, sf_dir, "events").select("event_id", A.batch_answers(raw).alias("m"))
    shown = F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat(k, F.lit("="), F.coalesce(F.try_element_at("m", k), F.lit("null"))))
    return m.select("event_id", F.array_join(shown, ",").alias("answers"))


# -- answers and texts --------------------------------------------------------------------------

#: Written amounts and what they are worth, by hand.
AMOUNTS = (
    ("3억 5천만원", "350000000"), ("약 120만원 정도", "1200000"), ("대략 삼천", "3000"), ("1,500", "1500"), ("없음", None), ("일이삼", "123"), ("-2만", "-20000"), ("백만원쯤", "1000000"), ("이천삼백오십", "2350"), ("１２만 3천", "123000"),
    ("모름 7개", "7"), ("N/A", None), ("2.5억", "250000000"), ("억", "100000000"), ("12천", "12000"), ("약속", None),
)
_AMOUNT_ROWS = ", ".join(f"({i}, '{t}', {'null' if v is None else v})" for i, (t, v) in enumerate(AMOUNTS))


@query(f"select o_orderkey, v::bigint as won, case when v is null then '__none__' else v::varchar end as normal from orders join (values {_AMOUNT_ROWS}) a(i, t, v) on i = o_orderkey % {len(AMOUNTS)}")
def won_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in all the ways that they are written."""
    text = F.element_at(F.array(*[F.lit(t) for t, _ in AMOUNTS]), (F.col("o_orderkey") % len(AMOUNTS) + 1).cast("int"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
    return o.select("o_orderkey", A.won("t").alias("won"), A.normalized_answer(F.col("t"), F.lit("krw")).alias("normal"))


#: Answers, how they are to be normalised, and the form that this gives, by hand.
ANSWERS = (
    ("  Main  Checking ", "text", "mainchecking"), ("３건", "integer", "3"), ("none", "integer", "__none__"), ("7, 5 및 6", "integer_list", "[5,6,7]"), ('["b","A"]', "string_list", '["a","b"]'), ("사과/배 그리고 감", "string_list", '["감","배","사과"]'),
    ("해당 없음", "krw", "__none__"), ("house", "text", "home"), ("-12", "integer", "-12"), ("없다", "integer", "__none__"),
)
_ANSWER_ROWS = ", ".join(f"({i}, '{n}')" for i, (_, _, n) in enumerate(ANSWERS))


@query(f"select p_partkey, n as normal from part join (values {_ANSWER_ROWS}) a(i, n) on i = p_partkey % {len(ANSWERS)}")
def normal_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in the form in which they are compared."""
    at = (F.col("p_partkey") % len(ANSWERS) + 1).cast("int")
    pick = lambda k: F.element_at(F.array(*[F.lit(a[k]) for a in ANSWERS]), at)
    return table(spark, sf_dir, "part").select("p_partkey", A.normalized_answer(pick(0), pick(1), {"House": "home"}).alias("normal"))


@query("select p_partkey, coalesce(nullif(nullif(nullif((p_size % 4)::varchar, '0'), '1'), '2'), case p_size % 4 when 0 then '__none__' when 1 then 'true' else 'no' end) as key from part")
def choice_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of choices: nothing, booleans, aliases."""
    w = F.col("p_size") % 4
    value = F.when(w == 1, F.lit(True).cast("string")).when(w == 2, F.lit(False).cast("string")).when(w == 3, "3")
    return table(spark, sf_dir, "part").select("p_partkey", A.choice_key(value, {"false": "no"}).alias("key"))


#: Texts and the numbers that they state, by hand.
STATED = (
    ("월 3만원씩 2번", "30000|2"), ("장례비로 오백만원 나갔어요", "5000000"), ("몇 천만원 수준은 아니고", ""), ("1,200.50원과 7%", "1200.5|7"), ("A12는 아니고 삼천이백만 원", "32000000"), ("이억삼천만원", ""), ("수백만 원, 천만 원", "10000000"), ("일억 오천 원", "100005000"),
)
_STATED_ROWS = ", ".join(f"({i}, '{n}')" for i, (_, n) in enumerate(STATED))


@query(f"select s_suppkey, n as numbers from supplier join (values {_STATED_ROWS}) a(i, n) on i = s_suppkey % {len(STATED)}")
def stated_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in digits and in Hangul, without vague ones."""
    text = F.element_at(F.array(*[F.lit(t) for t, _ in STATED]), (F.col("s_suppkey") % len(STATED) + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(A.numbers_in(text), "|").alias("numbers"))


@query(f"select event_id, case when {_K} % 3 = 0 then '' else ({_K} * 10000)::varchar end as ungrounded from events where {_K} >= 0")
def ungrounded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a text states and its plan does not."""
    k = _k()
    said = F.concat(k.cast("string"), F.lit("만원을 9일에"))
    plan = F.array(F.lit("9일"), F.when(k % 3 == 0, (k * 10_000).cast("string")).otherwise("5"))
    rows = table(spark, sf_dir, "events").select("event_id", A.ungrounded_numbers(said, plan).alias("u"), k.alias("k"))
    return rows.select("event_id", F.array_join(F.filter("u", lambda x: ~x.isin("5", "9") | (F.col("k") * 10_000 == x.cast("long"))), ",").alias("ungrounded"))


@query("""select s_suppkey, w in (0, 1) as labelled, w = 2 as emoji, w = 3 as jamo, case w when 4 then 'joint_account:supported' when 5 then 'joint_account:supported,joint_account:unsupported' else '' end as claims, case w when 6 then 'FA-07,FA-12' else '' end as codes from (select s_suppkey, s_suppkey % 7 as w from supplier)""")
def text_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as words, emoji, bare jamo, policy claims and codes."""
    texts = ("올해 결혼했어요", "결혼 예정", "결혼식장은 멀다 \U0001f600", "신혼결혼 ㅋㅋ", "공동명의 등록할 수 있어요", "공동 명의는 불가능해요", "FA-07과 FA-12")
    t = F.element_at(F.array(*map(F.lit, texts)), (F.col("s_suppkey") % 7 + 1).cast("int"))
    d = table(spark, sf_dir, "supplier").select("s_suppkey", t.alias("t"))
    c = F.col("t")
    return d.select("s_suppkey", A.names_label(c, "결혼").alias("labelled"), A.has_emoji(c).alias("emoji"), A.has_jamo(c).alias("jamo"), F.array_join(A.policy_claims(c), ",").alias("claims"), F.array_join(A.failure_codes(c), ",").alias("codes"))


@query("""with t as (select conv_id, list(role || ': ' || coalesce(text, '') order by turn) as ls, list(turn order by turn) filter (where role = 'assistant' and contains(text, 'e') and not contains(text, 'q')) as d from conversations group by 1)
select conv_id, array_to_string(ls, chr(10)) as block, contains(array_to_string(ls, chr(10)), 'user: ') as leaks from t""")
def rendered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as one block each, and whether a forbidden token shows in it."""
    turn = F.struct("turn", F.col("role").alias("speaker"), "text")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    c = c.select("conv_id", A.rendered(F.col("turns")).alias("block"))
    return c.select("conv_id", "block", (F.size(A.leaks(F.col("block"), ["user: ", "\u0000"])) > 0).alias("leaks"))


@query("""with n as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as i, role, text from conversations) select conv_id, array_to_string(coalesce(list(i order by i) filter (where role = 'assistant' and contains(text, 'e') and not contains(text, 'qu')), []), ',') as done from n group by 1""")
def completion_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns that complete something and are not excluded."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("speaker"), "text"))).alias("turns"))
    return c.select("conv_id", F.array_join(A.completion_turns(F.col("turns"), "e", ["qu"]), ",").alias("done"))


@query("select o_custkey, (min(o_orderdate)::date - 1)::varchar as initial_date, min(o_orderdate)::date::varchar as first_date, max(o_orderdate)::date::varchar as last_date, ((year(max(o_orderdate)) - year(min(o_orderdate))) * 12 + month(max(o_orderdate)) - month(min(o_orderdate)))::bigint as months from orders group by 1")
def date_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last day of each customer, the day before, and the months between."""
    d = F.to_date("o_orderdate")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(d).alias("a"), F.max(d).alias("b"))
    text = lambda c: c.cast("string")
    return o.select("o_custkey", text(F.date_sub("a", 1)).alias("initial_date"), text(F.col("a")).alias("first_date"), text(F.col("b")).alias("last_date"), (dates.month_ordinal(F.col("b")) - dates.month_ordinal(F.col("a"))).alias("months"))


@query("""with a as (select conv_id as item, case when conv_id % 3 = 0 then 'near' else 'far' end as near_miss, 'D' || conv_id % 4 as target, role from conversations where turn = 1), u as (select conv_id as item, case role when 'user' then 'near' else 'x' end as event, case when turn % 2 = 0 then 'occurred' else 'upcoming' end as status, 'D' || turn % 4 as s from conversations)
select a.item, coalesce(bool_or(event = near_miss), false) as near_miss_hallucinated, coalesce(bool_or(s = target), false) as hard_negative_cited, count_if(status = 'occurred')::bigint as false_occurred_count from a left join u using (item) group by 1""")
def distractor_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a distractor did to each case."""
    c = table(spark, sf_dir, "conversations")
    sid = lambda x: F.concat(F.lit("D"), (x % 4).cast("string"))
    cases = c.filter("turn = 1").select(F.col("conv_id").alias("item"), F.when(F.col("conv_id") % 3 == 0, "near").otherwise("far").alias("near_miss"), sid(F.col("conv_id")).alias("target")).distinct()
    u = c.select(F.col("conv_id").alias("item"), F.when(F.col("role") == "user", "near").otherwise("x").alias("event"), F.when(F.col("turn") % 2 == 0, "occurred").otherwise("upcoming").alias("status"), F.array(sid(F.col("turn"))).alias("core"), F.array().cast("array<string>").alias("supporting"))
    return S.distractor_flags(u, u, cases)
