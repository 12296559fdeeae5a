"""Queries over runs that share prefixes, counterfactual runs, and folds that go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemark.operators import branching, cases, joins, masking, memory, replay, scoring, windows
from tidemark.operators._stage import tasks_for
from tidemark.plans._base import query, table
from tidemark.plans.histories import _FOLD_SQL, _changes
from tidemark.sources import files
from tidemark.streaming import events as streams, versions

_AT = _FOLD_SQL.index("f as (select distinct")
#: SQL of the events as changes, and of the fold of a table ch (entity, path, op, value, month, source, i).
_E_SQL, _BODY = _FOLD_SQL[:_AT].rstrip().removesuffix(","), _FOLD_SQL[_AT:]
_CELL_SQL = "seq, c.value as value, c.status as status, c.confidence as confidence, c.valid_from as valid_from, c.valid_until as valid_until, c.source as source"
#: Which kinds of an event's sessions each level masks.
LEVELS = {"full": [], "mask_terminal": ["purchase", "error"], "mask_upcoming": ["purchase", "error", "click"], "mask_all": ["purchase", "error", "click", "view", "signup"]}
TERMINAL = ["purchase", "error"]

_CH = _E_SQL.replace("ch as (select", "c0 as (select event_id, event_type, ", 1)
_RUNS_SQL = f"""{_CH}, r as (select entity as user, 'v' || v as run, path, op, month, source, event_id, case when v > 0 and n > 5 * v then value || 'v' || v else value end as value
    from (select *, row_number() over (partition by entity order by month, event_id) as n from c0), (select unnest([0, 1, 2]) as v))"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's changes in three variants, which say something else after 5 and after 10 changes."""
    n = F.row_number().over(W.partitionBy("entity").orderBy("month", "seq"))
    changes = _changes(spark, sf_dir).drop("event_type")
    rows = changes.repartition(tasks_for(changes, 100_000), "entity").withColumn("n", n).withColumn("v", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    value = F.when((F.col("v") > 0) & (F.col("n") > 5 * F.col("v")), F.concat("value", F.lit("v"), F.col("v").cast("string"))).otherwise(F.col("value"))
    return rows.withColumn("value", value).withColumn("run", F.concat(F.lit("v"), F.col("v").cast("string"))).drop("n", "v")


@query(f"""{_RUNS_SQL}, ch as (select user || ':' || run as entity, path, op, value, month, source, row_number() over (partition by user, run, path order by month, event_id) as i from r), {_BODY}
select split_part(entity, ':', 1) as entity, split_part(entity, ':', 2) as run, path, {_CELL_SQL} from cell""")
def forked_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every variant, each node of the prefix tree folded once."""
    return branching.forked_fold(_runs(spark, sf_dir)).drop("last_confirmed_at", "evidence", "provenance")


@query(f"""{_RUNS_SQL}, p as (select user, run, depth, md5(string_agg(md5(concat_ws('|', path, op, value, month, source)), '' order by depth) over (partition by user, run order by depth rows between unbounded preceding and current row)) as node
    from (select *, row_number() over (partition by user, run order by month, event_id) as depth from r)),
q as (select *, lag(node, 1, '') over (partition by user, run order by depth) as up from p), k as (select user, up, count(*) as n, count(distinct node) as kids from q group by 1, 2)
select user as entity, sum(n)::bigint as n_changes, sum(kids)::bigint as n_nodes, coalesce(sum(kids) filter (kids > 1), 0)::bigint as n_clones from k group by 1""")
def shared_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many changes the variants have, how many nodes these are, and how many states are handed to several children."""
    nodes = branching.prefix_nodes(_runs(spark, sf_dir), ["entity", "run"], ["month", "seq"], ["path", "op", "value", "month", "source"])
    return branching.shared_work(nodes, ["entity"], ["entity", "run"])


@query(f"{_FOLD_SQL} select entity, path, {_CELL_SQL} from cell")
def resumed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold of the first half of each month, stored, and gone on from there."""
    changes = _changes(spark, sf_dir)
    half = memory.fold(changes.filter("month <= 15"))
    return branching.resumed_fold(half, changes.filter("month > 15")).drop("last_confirmed_at", "evidence", "provenance")


_LEVELS_SQL = ", ".join(f"('{k}', {v or '[]::varchar[]'})" for k, v in LEVELS.items())
_MASKED_SQL = f"""{_CH}, cases as (select entity, source as event, max((month, event_id)) as until from c0 group by 1, 2 having count(*) filter (event_type in ('purchase', 'error')) > 0),
touched as (select distinct entity, source as event, path from c0), lv(level, masked) as (values {_LEVELS_SQL}),
r as (select c0.*, event, level from c0 join touched using (entity, path) join cases using (entity, event), lv where (month, event_id) <= until and not (source = event and list_contains(masked, event_type))),
ch as (select entity || ':' || event || ':' || level as entity, path, op, value, month, source, row_number() over (partition by entity, event, level, path order by month, event_id) as i from r), {_BODY},
states as (select split_part(entity, ':', 1) as entity, split_part(entity, ':', 2) as event, split_part(entity, ':', 3) as level, path, {_CELL_SQL} from cell)"""


def _states(spark: SparkSession, sf_dir: str, *levels: str) -> DataFrame:
    return branching.counterfactual_states(_changes(spark, sf_dir).withColumnRenamed("event_type", "kind"), {k: LEVELS[k] for k in levels or LEVELS}, TERMINAL, ["month", "seq"])


@query(f"{_MASKED_SQL} select * from states")
def masked_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event's paths hold at four mask levels, folded again from the first masked change."""
    return _states(spark, sf_dir).drop("last_confirmed_at", "evidence", "provenance")


@query(f"""{_MASKED_SQL}, ends as (select *, source is not distinct from event as mine, struct_pack(path, value, status, confidence, valid_from, valid_until, source) as x from states where level in ('full', 'mask_all')),
own as (select entity, event, count(*) filter (mine and level = 'full') as n_own, count(*) filter (mine and level = 'mask_all') as n_left from ends group by 1, 2),
moved as (select entity, event, sum(abs(d)) as n_moved from (select entity, event, x, sum(case when level = 'full' then 1 else -1 end) as d from ends where not mine group by 1, 2, 3) group by 1, 2)
select entity, event, n_own, n_left = 0 as target_gone, coalesce(n_moved, 0)::bigint as n_moved from own left join moved using (entity, event)""")
def masked_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an event's own cells are gone at the last level, and how many cells of others are not as they were."""
    return branching.counterfactual_verdicts(_states(spark, sf_dir, "full", "mask_all"), "full", "mask_all")


_SNAP_SQL = f"""{_FOLD_SQL}, tm(t) as (values (10), (20), (31)), upto as (select ch.entity, ch.path, t, max(i) as i from ch, tm where month <= t group by 1, 2, 3),
st as (select u.entity, u.path, t, coalesce(f.cells[list_max(list_filter(range(1, len(f.cells) + 1), lambda k: f.cells[k].status not in ('pending', 'cancelled', 'historical')))],
        f.cells[list_max(list_filter(range(1, len(f.cells) + 1), lambda k: f.cells[k].status not in ('pending', 'cancelled')))]) as c from upto u join f on f.entity = u.entity and f.path = u.path and f.i = u.i),
h as (select *, ('0x' || substr(sha256(entity || ':' || path || ':' || t), 1, 8))::bigint % 40 as h from st where c is not null)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each user's paths after days 10, 20 and 31, with planted faults."""
    changes, out = _changes(spark, sf_dir), None
    for t in (10, 20, 31):
        state = memory.effective(memory.fold(changes.filter(F.col("month") <= t))).filter("status is not null").select("entity", "path", F.lit(t).alias("month"), "value", "status")
        out = state if out is None else out.unionByName(state)
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", "entity", "path", "month"), 256), 1, 8), 16, 10).cast("long") % 40
    out = out.withColumn("h", h).filter("h <> 1")
    out = out.withColumns({"value": F.when(F.col("h") == 0, F.concat(F.coalesce("value", F.lit("")), F.lit("!"))).otherwise(F.col("value")), "status": F.when(F.col("h") == 2, F.lit("planted")).otherwise(F.col("status"))}).drop("h")
    unknown = changes.select("entity").distinct().filter("entity % 25 = 0").select("entity", F.lit("p9").alias("path"), F.lit(31).alias("month"), F.lit("x").alias("value"), F.lit("current").alias("status"))
    return out.unionByName(unknown)


@query(f"""{_SNAP_SQL} select entity, path, t::int as month, case h when 0 then 'value_differs' when 1 then 'missing_in_snapshot' else 'status_differs' end as code from h where h < 3
union all select distinct entity, 'p9', 31, 'unknown_path' from ch where entity::bigint % 25 = 0
union all select entity, path, month, 'orphan_update' from ch where entity::bigint % 10 = 7 and source = '2'""")
def replay_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planted faults of stored snapshots and changes, found by replaying all changes, and nothing else."""
    changes = _changes(spark, sf_dir)
    instances = changes.select("entity", "source").distinct().filter("not (entity % 10 = 7 and source = '2')")
    taken = changes.select("entity").distinct().withColumn("month", F.explode(F.array(*map(F.lit, (10, 20, 31)))))
    return replay.replay_audit(changes, _snapshots(spark, sf_dir), instances, taken=taken)


def _greedy_sql(slots: str, donors: str, by: str, seed: str) -> str:
    """SQL of greedy donors: a step for each slot of a key, all keys at once."""
    return f"""with recursive s as (select *, row_number() over (partition by {by} order by month, slot) as i from ({slots})), d as ({donors}),
r as (select {by}, 0::bigint as i, 0::bigint as slot, 0::bigint as donor, []::bigint[] as used from (select distinct {by} from s)
    union all select {by}, i, slot, donor, list_append(used, donor) from (
        select {by}, s.i, s.slot, r.used, arg_min(d.donor, row(d.month is null, case when d.month is null then 0 else abs(d.month - s.month) end, case when d.month is null then sha256('{seed}:' || s.slot || ':' || d.donor) else '' end, d.donor)) as donor
        from r join s using ({by}) join d using ({by}) where s.i = r.i + 1 and not list_contains(r.used, d.donor) group by all))
select {by}, slot, donor from r where i > 0"""


@query(_greedy_sql("select user_id, event_id as slot, day(ts) as month from events where event_type = 'purchase'", "select user_id, event_id as donor, day(ts) as month from events where event_type in ('error', 'signup') union all select user_id, -event_id, null from events where event_type = 'purchase'", "user_id", "m"))
def assign_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy donors without reuse: a user's purchases take errors and signups of the nearest day, then timeless ones."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.dayofmonth("ts").alias("month"))
    slots = e.filter("event_type = 'purchase'").withColumnRenamed("event_id", "slot")
    donors = e.filter("event_type in ('error', 'signup')").select("user_id", F.col("event_id").alias("donor"), "month")
    reserve = slots.select("user_id", (-F.col("slot")).alias("donor"), F.lit(None).cast("int").alias("month"))
    return masking.assign_donors(slots, donors.unionByName(reserve), ["user_id"], ["month", "slot"], "m")


_PLACES = "(select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as place from events)"


@query(_greedy_sql(f"select user_id, event_id as slot, place as month from {_PLACES} where event_type = 'purchase' and place % 3 = 0", f"select user_id, event_id as donor, place as month from {_PLACES} where event_type <> 'purchase'", "user_id", ""))
def placebo_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every third place's purchase the nearest other event of the user's history, none twice."""
    e = _placed(spark, sf_dir)
    return masking.placebo_slots(e.filter("event_type = 'purchase' and place % 3 = 0"), e.filter("event_type <> 'purchase'"), ["user_id"], "place", "event_id")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", place.alias("place"), F.floor(F.col("value") % 3).cast("int").alias("instance"))


_CASES = "(select user_id, floor(value % 3)::int as instance, max(place) as until from (select *, row_number() over (partition by user_id order by ts, event_id) as place from events) where event_type = 'error' group by 1, 2)"
_ALL = "(select user_id, event_id, event_type, floor(value % 3)::int as instance, row_number() over (partition by user_id order by ts, event_id) as place from events)"


@query(_greedy_sql(f"select user_id, instance, event_id as slot, place as month from {_ALL} where event_type = 'error'", f"select c.user_id, c.instance, e.event_id as donor, e.place as month from {_CASES} c join {_ALL} e using (user_id) where e.event_type = 'view' and e.place > c.until union all select user_id, instance, -event_id, null from {_ALL} where event_type = 'error'", "user_id, instance", "u"))
def case_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donors fixed once for each case: only what stands behind the case's last session, the nearest first, then timeless ones."""
    e = _placed(spark, sf_dir)
    slots = e.filter("event_type = 'error'").select("user_id", "instance", F.col("event_id").alias("slot"), F.col("place").alias("month"))
    cases = slots.groupBy("user_id", "instance").agg(F.max("month").alias("until"))
    seen = masking.unseen_donors(cases, e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("donor"), F.col("place").alias("month")), ["user_id"], "until", "month")
    reserve = slots.select("user_id", "instance", (-F.col("slot")).alias("donor"), F.lit(None).cast("long").alias("month"))
    return masking.assign_donors(slots, seen.unionByName(reserve), ["user_id", "instance"], ["month", "slot"], "u")


_K_SQL = "json_extract_string(props, '$.k')::int"


@query(f"""with t as (select user_id, event_id, event_type as event, case when {_K_SQL} % 3 = 0 then 'on_upcoming' else 'on_occurred' end as hook, ({_K_SQL} % 5)::varchar as size from events),
sp(event, hook, spec_no, label, path, decision, sizes, impact_type, risk) as (values ('click', 'on_occurred', 1, null, 'p1', 'execute', ['0', '1'], 'stale_address', 'high'), ('click', 'on_upcoming', 2, 'k0', null, 'review', null, 'limit', 'low'), ('purchase', 'on_occurred', 1, 'k1', 'p1', 'execute', null, 'stale_amount', 'high'), ('view', 'on_occurred', 1, null, null, 'review', null, 'none', 'low')),
a as (select user_id, event_id as action_id, 'k' || {_K_SQL} % 2 as kind, ['p' || {_K_SQL} % 3, 'q'] as paths, event_type = 'error' as gone, {_K_SQL} % 5 = 0 as moves_funds from events where event_type in ('signup', 'error')),
h as (select a.user_id, action_id, t.event_id, sp.*, moves_funds, row_number() over (partition by a.user_id, action_id order by t.event_id, spec_no) as r from a join t using (user_id) join sp on sp.event = t.event and sp.hook = t.hook
    where not gone and (sizes is null or list_contains(sizes, size)) and (label is not null or path is not null) and (label is null or label = kind) and (path is null or list_contains(paths, path)))
select user_id, action_id, event_id, spec_no::int as spec_no, case when moves_funds and decision = 'execute' then 'ask_confirmation' else decision end as decision, moves_funds as must_not_execute, impact_type, risk from h where r = 1""")
def impacts_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impacts by specs with hooks, conditions on parameters, impact type and risk."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").withColumn("k", k)
    specs = spark.createDataFrame(
        [("click", "on_occurred", 1, None, "p1", "execute", {"size": ["0", "1"]}, "stale_address", "high"), ("click", "on_upcoming", 2, "k0", None, "review", {}, "limit", "low"), ("purchase", "on_occurred", 1, "k1", "p1", "execute", {}, "stale_amount", "high"), ("view", "on_occurred", 1, None, None, "review", {}, "none", "low")],
        "event string, hook string, spec_no int, label string, path string, decision string, wanted map<string,array<string>>, impact_type string, risk string",
    )
    hook = F.when(F.col("k") % 3 == 0, "on_upcoming").otherwise("on_occurred")
    steps = e.select("user_id", "event_id", F.col("event_type").alias("event"), hook.alias("hook"), F.create_map(F.lit("size"), (F.col("k") % 5).cast("string")).alias("params"))
    name = lambda p, m: F.concat(F.lit(p), (F.col("k") % m).cast("string"))
    actions = e.filter("event_type in ('signup', 'error')").select("user_id", F.col("event_id").alias("action_id"), name("k", 2).alias("kind"), F.array(name("p", 3), F.lit("q")).alias("paths"), F.when(F.col("event_type") == "error", "cancelled").otherwise("live").alias("status"), (F.col("k") % 5 == 0).alias("moves_funds"))
    return joins.impacts(steps, specs, actions, "user_id", ["event_id"])


@query("""with n as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as no, count(*) over (partition by user_id) as c from events), w as (select *, (no - 1) // 15 as w, (no - 1) % 15 + 1 as p from n where no <= c // 15 * 15)
select user_id, w::bigint as win, max(event_id) filter (p = 15) as target, max(event_id) filter (p = 15) as last from w group by 1, 2""")
def exact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole windows of 15 events with their target, the last one; a gap or a second target would raise."""
    own = W.partitionBy("user_id")
    e = table(spark, sf_dir, "events").withColumns({"no": F.row_number().over(own.orderBy("ts", "event_id")), "c": F.count(F.lit(1)).over(own)})
    e = e.filter("no <= c div 15 * 15").select("user_id", "event_id", F.expr("(no - 1) div 15").alias("win"), ((F.col("no") - 1) % 15 + 1).alias("p"))
    return windows.exact_windows(e, ["user_id"], "win", "p", 15, F.col("p") == 15, "event_id")


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'P' and o_orderkey in (select l_orderkey from lineitem))")
def rows_for_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a table of orders; an order without a line would raise."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    keys = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return files.rows_for(lines, keys.join(lines, "l_orderkey", "left_semi"), "l_orderkey")


@query(f"""{_FOLD_SQL}, upto as (select ch.entity, ch.path, t, max(i) as i from ch, (values (15), (31)) tm(t) where month <= t group by 1, 2, 3),
st as (select t, f.entity, f.path, unnest(range(1, len(f.cells) + 1)) as k, f.cells from upto u join f on f.entity = u.entity and f.path = u.path and f.i = u.i)
select t::int as day, entity, path, (k - 1)::int as seq, cells[k].value as value, cells[k].status as status, cells[k].valid_from as valid_from, cells[k].valid_until as valid_until, cells[k].source as source from st""")
def checkpoint_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that takes in half a month, answers from its stored state, and goes on: the cells after either half."""
    changes, at = _changes(spark, sf_dir).drop("event_type"), streams.scratch(spark)
    for half in ("month <= 15", "month > 15"):
        changes.filter(half).write.mode("append").parquet(f"{at}/in")
        versions.take_in(spark, f"{at}/in", changes.schema, f"{at}/state", f"{at}/out")
    first, last = versions.cells_at(spark, f"{at}/state", 0), versions.cells_at(spark, f"{at}/state")
    both = first.withColumn("day", F.lit(15)).unionByName(last.withColumn("day", F.lit(31)))
    return both.select("day", "entity", "path", "seq", "value", "status", "valid_from", "valid_until", "source")


@query("""select p_partkey, round(((p_size * 1000 - least(p_partkey % 60 * 1000, p_size * 1000)) * 2.5::double + least(p_partkey % 60 * 1000, p_size * 1000) * 0.25::double + floor(p_retailprice) * 10) / 1000000, 9) as cost from part""")
def priced_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by the price of fresh and cached input and of output."""
    p = table(spark, sf_dir, "part")
    cost = scoring.call_cost(F.col("p_size") * 1000, F.col("p_partkey") % 60 * 1000, F.floor("p_retailprice"), {"input": 2.5, "cached": 0.25, "output": 10.0})
    return p.select("p_partkey", F.round(cost, 9).alias("cost"))


@query(f"""with s as (select distinct event_type || ':' || {_K_SQL} % 40 || ':' || event_id % 3 as selector, case when event_id % 3 <> 1 then event_type end as label, case when event_id % 3 <> 0 then 'p' || {_K_SQL} % 40 end as path from events where event_id < 400),
h as (select distinct selector, user_id from s join events e on (label is null or e.event_type = label) and (path is null or path in ('p' || {_K_SQL} % 37, 'q'))),
r as (select *, row_number() over (partition by selector order by sha256('c:' || user_id::varchar), user_id) as place from h)
select selector, place::int as place, user_id from (select selector from s) left join (select * from r where place <= 2) using (selector)""")
def selected_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two users for each selector of a kind, a path, or both, and the selectors that nobody matches."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    third = F.col("event_id") % 3
    selectors = e.filter("event_id < 400").select(F.concat_ws(":", "event_type", F.col("k") % 40, third).alias("selector"), F.when(third != 1, F.col("event_type")).alias("label"), F.when(third != 0, F.concat(F.lit("p"), (F.col("k") % 40).cast("string"))).alias("path")).distinct()
    actions = e.select("user_id", F.col("event_type").alias("label"), F.array(F.concat(F.lit("p"), (F.col("k") % 37).cast("string")), F.lit("q")).alias("paths"))
    return cases.selected_holders(selectors, actions, "user_id", "c", 2)


@query(f"""{_FOLD_SQL}, g as (select entity, path, coalesce(max_by(c, seq) filter (where c.status not in ('pending', 'cancelled', 'historical')), max_by(c, seq) filter (where c.status not in ('pending', 'cancelled'))) as c from cell group by 1, 2),
every as (select distinct user_id::varchar as entity from events)
select entity, path, case when c.status not in ('not_applicable', 'unknown') then c.value end as value, coalesce(c.status, 'unknown') as status from (select * from every, (select unnest(['p0', 'p2', 'p4', 'p8', 'p9']) as path)) left join g using (entity, path)""")
def all_paths_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five stated paths of every user, those without a value as unknown."""
    changes = _changes(spark, sf_dir)
    states = memory.effective(memory.fold(changes))
    return memory.with_all_paths(states, ["p0", "p2", "p4", "p8", "p9"], changes).select("entity", "path", "value", "status")


_SHAM = "select user_id, case when event_id % 50 = 0 then 'changed' else event_type end as event_type, ts::date as d from events where event_id % 70 <> 0"


@query(f"""with b as (select user_id, event_type, ts::date as d from events), a as ({_SHAM})
select *, 'before' as side from (select * from b except all select * from a) union all select *, 'after' from (select * from a except all select * from b)""")
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sham must not do: rows that only one of two tables has, as often as it has more of them."""
    e = table(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    after = e.filter("event_id % 70 <> 0").withColumn("event_type", F.when(F.col("event_id") % 50 == 0, "changed").otherwise(F.col("event_type")))
    return masking.changed_rows(e.select("user_id", "event_type", "d"), after.select("user_id", "event_type", "d"))
