"""Queries of cases, audits, resuming, and of sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemark.operators import aggregates as A, audit, cases as C, joins, masking, memory, projections, reports as R, scoring as S, simulate
from tidemark.plans._base import query, table
from tidemark.sources import files
from tidemark.streaming.events import scratch

_K = "json_extract_string(props, '$.k')::int"


def _k():
    return F.get_json_object("props", "$.k").cast("int")


@query(f"select user_id, {_K} as instance, arg_min(event_id, event_id) as event_id, min(event_id) as no from events where event_type <> 'view' group by 1, 2")
def occurred_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first visible event of each instance; views are not visible."""
    e = table(spark, sf_dir, "events").withColumn("instance", _k()).withColumn("no", F.col("event_id"))
    return C.occurred_anchors(e, e.filter("event_type <> 'view'"), ["user_id"], "instance", "event_id", "no")


@query("select l_orderkey, l_linenumber, o_custkey from lineitem join orders on o_orderkey = l_orderkey")
def anchored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with its order; a line without one would raise."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return C.anchored_pairs(lines, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), ["l_orderkey"])


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders)")
def exactly_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer of every order, each exactly one row."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return C.exactly_one(c, ["c_custkey"], table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")))


@query("select c_custkey, coalesce(string_agg(o_orderkey::varchar, ',' order by o_orderkey), '') as orders from customer left join orders on o_custkey = c_custkey group by 1")
def with_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders, an empty list without any."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    out = C.with_lists(table(spark, sf_dir, "customer").select("c_custkey"), o, ["c_custkey"], "o_orderkey", "o_orderkey", "orders")
    return out.select("c_custkey", F.array_join("orders", ",").alias("orders"))


_KINDS = ("click", "view", "purchase")


@query(f"""select user_id || ':' || k as "case", max(n) filter (where event_type = 'click') as click, max(n) filter (where event_type = 'view') as view, max(n) filter (where event_type = 'purchase') as purchase
from (select user_id, {_K} as k, event_type, count(*) as n from events group by 1, 2, 3) group by 1 having count(distinct case when event_type in {_KINDS} then event_type end) = 3""")
def paired_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that have all three conditions, side by side."""
    e = table(spark, sf_dir, "events").groupBy(F.concat_ws(":", F.col("user_id").cast("string"), _k().cast("string")).alias("case"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return C.paired_conditions(e, "case", "event_type", _KINDS, "n")


@query("""with a as (select o_custkey, max(o_totalprice) as v from orders where o_orderstatus = 'O' group by 1), b as (select o_custkey, max(o_totalprice) as v from orders where o_orderstatus = 'F' group by 1)
select o_custkey, round(a.v - b.v, 4) as difference from a join b using (o_custkey)""")
def paired_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    side = lambda s: o.filter(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.max("o_totalprice").alias("v"))
    return C.paired_differences(side("O"), side("F"), ["o_custkey"], "v").select("o_custkey", F.round("difference", 4).alias("difference"))


@query("select n_name, r_name, row_number() over (order by n_name, r_name)::int as ordinal from nation, region")
def product_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation with every region, numbered."""
    return C.product_plans(table(spark, sf_dir, "nation").select("n_name"), table(spark, sf_dir, "region").select("r_name"), ["n_name", "r_name"])


_SEL = f"select distinct event_type as label, {_K} % 120 as path from events"


@query(f"""with s as ({_SEL}), h as (select distinct event_type as label, {_K} as path, user_id from events), r as (select label, path, user_id, row_number() over (partition by label, path order by sha256('c:' || user_id::varchar), user_id) as place from s join h using (label, path))
select label, path, user_id, place::int as place from r where place <= 2 union all select label, path, null, null from s where not exists (select 1 from h where h.label = s.label and h.path = s.path)""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two users for each kind and key, and those that nobody has."""
    e = table(spark, sf_dir, "events")
    selectors = e.select(F.col("event_type").alias("label"), (_k() % 120).alias("path")).distinct()
    took, none = C.covered(selectors, e.select(F.col("event_type").alias("label"), _k().alias("path"), "user_id"), ["label", "path"], "user_id", "c", 2)
    return took.select("label", "path", "user_id", "place").unionByName(none, allowMissingColumns=True)


@query("select o_orderkey, case when o_orderstatus = 'P' then 'swapped' else o_orderpriority end as o_orderpriority, o_orderstatus from orders")
def patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch of one column; a difference in any other would raise."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    patch = o.filter("o_orderstatus = 'P'").withColumn("o_orderpriority", F.lit("swapped"))
    return C.patched(o, patch, ["o_orderkey"], ["o_orderpriority"])


@query(f"""with e as (select event_type as method, user_id || ':' || {_K} % 10 as item, count(*) as n from events group by 1, 2), m as (select distinct method from e), s as (select item, count(*) as have from e group by 1)
select method, item, 'duplicate' as code from e where n > 1 union all select m.method, s.item, 'missing' from s, m where have * 2 > (select count(*) from m) and not exists (select 1 from e where e.method = m.method and e.item = s.item)
union all select e.method, e.item, 'extra' from e join s using (item) where have * 2 <= (select count(*) from m)""")
def paired_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that a method repeats, lacks, or has alone."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), F.concat_ws(":", F.col("user_id").cast("string"), (_k() % 10).cast("string")).alias("item"))
    return C.paired_inputs(e, "method", "item")


@query("""with s as (select user_id, day(ts)::int as level, list_sort(list_distinct(list(event_type))) as items from events group by 1, 2), l as (select *, lag(items) over (partition by user_id order by level) as b from s)
select user_id, level, array_to_string(list_sort(list_filter(b, lambda x: not list_contains(items, x))), ',') as lost from l where len(list_filter(b, lambda x: not list_contains(items, x))) > 0""")
def not_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that lack a kind of event which the user's day before had."""
    s = table(spark, sf_dir, "events").groupBy("user_id", F.dayofmonth("ts").alias("level")).agg(F.collect_set("event_type").alias("items"))
    return C.not_nested(s, ["user_id"], "level", "items").withColumn("lost", F.array_join("lost", ","))


@query("select event_id, row_number() over (partition by user_id order by event_id % 1000, event_type, event_id) as place from events")
def atom_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by number of their session, not by its text."""
    e = table(spark, sf_dir, "events").withColumn("session", F.concat(F.lit("S"), (F.col("event_id") % 1000).cast("string")))
    w = W.partitionBy("user_id").orderBy(*C.atom_order(F.col("session"), F.col("event_type")), "event_id")
    return e.select("event_id", F.row_number().over(w).cast("long").alias("place"))


@query("select p_brand, p_partkey from (select *, row_number() over (partition by p_brand order by p_size desc, sha256('t:' || p_brand || ':' || p_partkey::varchar), p_partkey) as r from part) where r = 1")
def best_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.best_templates(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size", "p_partkey", "t").select("p_brand", "p_partkey")


@query("select n_name from nation where n_regionkey <> 3 and n_name not in (select min(n_name) from nation) order by n_name limit 7")
def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that are included and not excluded, the first seven."""
    n = table(spark, sf_dir, "nation")
    first = n.agg(F.min("n_name")).first()[0]
    return C.chosen(n.filter("n_regionkey <> 3").select("n_name"), "n_name", exclude=[first], most=7)


@query("""select o_custkey, o_orderkey, place::int as place, row_number() over (partition by o_custkey order by age, o_totalprice desc, o_orderkey, place) as no from (select o_custkey, o_orderkey, o_totalprice, unnest([0, 1]) as place, unnest([month(o_orderdate), month(o_orderdate) + 2]) as age from orders)""")
def episode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps of every order in one timeline for each customer."""
    steps = F.array(F.struct(F.month("o_orderdate").alias("age")), F.struct((F.month("o_orderdate") + 2).alias("age")))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", steps.alias("steps"))
    return C.episode_events(o, ["o_custkey"], "steps", "age", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "place", F.col("no").cast("long").alias("no"))


@query("""with n as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as i from events), o as (select *, unnest(['a', 'b', 'c']) as o from n), r as (select *, row_number() over (partition by event_id order by sha256('q:' || user_id::varchar || ':' || (i // 3)::varchar || ':' || o), o) - 1 as k from o)
select event_id, o as choice from r where k = i % 3""")
def least_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A balanced, seeded choice of three for each event of a user."""
    return C.least_used(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], ["a", "b", "c"], "q").select("event_id", "choice")


@query("""with t as (select c_custkey, unnest(list_distinct([c_mktsegment, 'BUILDING', 'MACHINERY', 'OTHER'])) as t, c_mktsegment as good from customer), r as (select *, row_number() over (partition by c_custkey order by sha256('o:' || c_custkey::varchar || ':' || t), t) as i from t)
select c_custkey, string_agg(chr((64 + i)::int) || '=' || t, ',' order by i) as options, max(case when t = good then chr((64 + i)::int) end) as answer from r group by 1""")
def shuffled_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options in seeded order with exactly one right one."""
    wrong = F.array(*map(F.lit, ("BUILDING", "MACHINERY", "OTHER", "OTHER")))
    c = table(spark, sf_dir, "customer").select("c_custkey", C.shuffled_options(F.col("c_mktsegment"), wrong, "o", F.col("c_custkey")).alias("o"))
    shown = F.array_join(F.transform("o", lambda x: F.concat_ws("=", x["option_id"], x["text"])), ",")
    return c.select("c_custkey", shown.alias("options"), F.get(F.filter("o", lambda x: x["correct"]), F.lit(0))["option_id"].alias("answer"))


@query("""with r as (select o_orderkey, row_number() over (partition by o_orderpriority order by sha256('d:o_orderpriority:' || o_orderkey::varchar), o_orderkey) as a, row_number() over (partition by o_orderstatus order by sha256('d:o_orderstatus:' || o_orderkey::varchar), o_orderkey) as b from orders)
select o_orderkey from r where a <= 5 or b <= 5""")
def diverse_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that cover every priority and status five times."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return C.diverse_sample(o, ["o_orderpriority", "o_orderstatus"], 5, "d", "o_orderkey").select("o_orderkey")


_QUOTA_TARGETS = {"view": 20, "click": 12, "purchase": 8, "error": 6, "signup": 2}


@query()
def diverse_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """48 events by quotas of their types, chosen for diversity of users and sizes."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 7).alias("user_k"), (F.col("value") > 90).alias("big"), (F.col("value") > 99).alias("req"))
    return C.diverse_quota(e, "event_id", "event_id", "event_type", ["user_k", "big"], _QUOTA_TARGETS, 48, {"large": F.col("req")})


_IMPACTS = f"""with t as (select user_id, event_id, event_type as event from events), sp as (select * from (values ('click', 1, null, 'p1', 'execute'), ('click', 2, 'k0', null, 'review'), ('purchase', 1, 'k1', 'p1', 'execute'), ('view', 1, null, null, 'review')) s(event, spec_no, label, path, decision)),
a as (select user_id, event_id as action_id, 'k' || {_K} % 2 as kind, 'p' || {_K} % 3 as path_of, case when event_type = 'error' then 'cancelled' else 'live' end as status, {_K} % 5 = 0 as moves_funds from events where event_type in ('signup', 'error')),
h as (select t.user_id, a.action_id, t.event_id, spec_no, case when moves_funds and decision = 'execute' then 'ask_confirmation' else decision end as decision, moves_funds as must_not_execute, row_number() over (partition by t.user_id, action_id order by t.event_id, spec_no) as r
    from t join sp using (event) join a on a.user_id = t.user_id where status = 'live' and (label is not null or path is not null) and (label is null or label = kind) and (path is null or path = path_of))"""


@query(f"{_IMPACTS} select user_id, action_id, event_id, spec_no::int as spec_no, decision, must_not_execute from h where r = 1")
def impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event that impacts each signup, by selectors of label and path."""
    e, k = table(spark, sf_dir, "events"), _k()
    specs = spark.createDataFrame([("click", 1, None, "p1", "execute"), ("click", 2, "k0", None, "review"), ("purchase", 1, "k1", "p1", "execute"), ("view", 1, None, None, "review")], "event string, spec_no int, label string, path string, decision string")
    name = lambda p, m: F.concat(F.lit(p), (k % m).cast("string"))
    actions = e.filter("event_type in ('signup', 'error')").select("user_id", F.col("event_id").alias("action_id"), name("k", 2).alias("kind"), F.array(name("p", 3)).alias("paths"), F.when(F.col("event_type") == "error", "cancelled").otherwise("live").alias("status"), (k % 5 == 0).alias("moves_funds"))
    return joins.impacts(e.select("user_id", "event_id", F.col("event_type").alias("event")), specs, actions, "user_id", ["event_id"])


@query("select n_nationkey::int as n_nationkey, n_name, n_regionkey::int as n_regionkey from nation")
def identity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sides whose common columns agree; a difference would raise."""
    n = table(spark, sf_dir, "nation")
    return joins.identity_join(n.select("n_nationkey", "n_regionkey"), n.select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"]).select("n_nationkey", "n_name", "n_regionkey")


@query("""with f as (select user_id, event_type, min(event_id) as event_id from events group by 1, 2) select user_id, event_type, event_id, array_to_string(list(event_type) over (partition by user_id order by event_id rows between unbounded preceding and current row), ',') as so_far from f""")
def running_firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each kind with all kinds so far."""
    out = joins.running_firsts(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], ["event_type"], ["event_id"], "event_type")
    return out.withColumn("so_far", F.array_join("so_far", ","))


@query("select user_id, event_type, n, row_number() over (partition by user_id order by n desc, f)::int as place from (select user_id, event_type, count(*) as n, min(event_id) as f from events group by 1, 2)")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's kinds of event by number, ties to the one seen first."""
    return A.most_common(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


_WHICH = f"case when {_K} % 4 = 0 then 'no_retraction_opportunity' when {_K} % 4 = 1 then 'evidence_dependent' else 'inconsistent_persistence' end"


@query(f"select event_type, count(*) as cases, count_if(v = 'no_retraction_opportunity')::bigint as no_retraction_opportunity, count_if(v = 'evidence_dependent')::bigint as evidence_dependent, count_if(v = 'structural_or_unsupported_persistence')::bigint as structural_or_unsupported_persistence from (select event_type, {_WHICH} as v from events) group by 1")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by verdict, zeros kept."""
    v = F.when(_k() % 4 == 0, "no_retraction_opportunity").when(_k() % 4 == 1, "evidence_dependent").otherwise("inconsistent_persistence")
    return A.verdict_counts(table(spark, sf_dir, "events").withColumn("v", v), ["event_type"], "v", ("no_retraction_opportunity", "evidence_dependent", "structural_or_unsupported_persistence"))


@query("""with f as (select user_id, event_id, event_type from events), m as (select user_id, event_id, case when event_type = 'error' then 'view' else event_type end as event_type from events where event_type <> 'click' or event_id % 2 = 0)
select user_id, event_id, event_type, 'target_remains' as code from m where event_type = 'click' union all select user_id, event_id, event_type, 'drift' from (select * from f where event_type <> 'click' except all select * from m where event_type <> 'click')
union all select user_id, event_id, event_type, 'drift' from (select * from m where event_type <> 'click' except all select * from f where event_type <> 'click')""")
def counterfactual_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a counterfactual must not show: target rows that stay, other rows that change."""
    f = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    m = f.filter("event_type <> 'click' or event_id % 2 = 0").withColumn("event_type", F.when(F.col("event_type") == "error", "view").otherwise(F.col("event_type")))
    return masking.target_retracted(f, m, F.col("event_type") == "click")


@query(f"""with a as (select event_id, 0.9::double * (value / 50) * (case when event_type = 'click' then 1.5 when event_type = 'error' then -1 else 1 end) * ({_K} / 10.0) + 0.0::double as annual from events)
select event_id, round(annual, 9) as annual, round(case when annual / 12 < 0 then 0 when annual / 12 > 0.5 then 0.5 else annual / 12 end, 9) as monthly from a""")
def propensities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual propensities by their factors, many above 1 and some below 0, and monthly hazards, which are kept in [0, 0.5]."""
    annual = simulate.annual_propensity(F.lit(0.9), F.col("value") / 50, F.when(F.col("event_type") == "click", 1.5).when(F.col("event_type") == "error", -1.0), _k() / 10.0) + F.lit(0.0)  # no negative zero
    return table(spark, sf_dir, "events").select("event_id", F.round(annual, 9).alias("annual"), F.round(simulate.monthly_hazard(annual), 9).alias("monthly"))


@query(f"""with s as (select user_id, list_distinct(list({_K} % 20) filter (where event_type = 'click')) as f, list_distinct(list({_K} % 20) filter (where event_type = 'purchase')) as w from events group by 1), x as (select user_id, coalesce(f, []) as f, coalesce(w, []) as w from s), h as (select *, len(list_intersect(f, w)) as m from x)
select user_id, round(case when len(f) = 0 and len(w) = 0 then 1.0 when len(f) = 0 or len(w) = 0 then 0.0 else 2 * m / (len(f) + len(w)) end::double, 6) as f1 from h""")
def set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of two sets for each user."""
    keys = lambda kind: F.collect_set(F.when(F.col("event_type") == kind, (_k() % 20).cast("string")))
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(keys("click").alias("f"), keys("purchase").alias("w"))
    return s.select("user_id", F.round(S.set_prf(F.col("f"), F.col("w"))[2], 6).alias("f1"))


# -- resuming and sharing ------------------------------------------------------------------


@query("select distinct o_custkey from orders where o_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that have no successful order yet, failed ones among them."""
    o = table(spark, sf_dir, "orders")
    return C.to_do(o.select("o_custkey").distinct(), o, ["o_custkey"], F.col("o_orderstatus") == "F")


@query("select o_custkey, o_orderkey, ok from (select o_custkey, o_orderkey, o_orderstatus = 'F' as ok, row_number() over (partition by o_custkey order by o_orderstatus = 'F' desc, o_orderkey desc) as r from orders) where r = 1")
def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result for each customer, a success before a failure."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("ok"))
    return C.merged_results(o.filter("ok"), o.filter("not ok"), ["o_custkey"], "ok", "o_orderkey")


@query("""with recursive n as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn) as d from conversations), p as (select conv_id, d, sha256(concat_ws(':', '', role)) as digest from n where d = 1
    union all select n.conv_id, n.d, sha256(concat_ws(':', p.digest, n.role)) from p join n on n.conv_id = p.conv_id and n.d = p.d + 1)
select digest, d::int as depth, count(*) as shared_by from p group by 1, 2""")
def shared_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many conversations share each prefix of roles."""
    p = C.prefix_digests(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role")
    return C.shared_prefixes(p, ["conv_id"]).select("digest", "depth", "shared_by")


@query("""with e as (select user_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}') as h from events) select user_id, sha256(string_agg(h, ',' order by h)) as fingerprint from e group by 1""")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each user's events that does not depend on their order."""
    return C.fingerprints(table(spark, sf_dir, "events"), ["user_id"], ["event_id", "event_type"])


# -- audits ------------------------------------------------------------------------------------


_TURN_RULES = {
    "empty_text": "coalesce(trim(text), '') = ''", "not_first": "turn = 1 and role = 'assistant'", "long": "length(text) > 400", "digits": "regexp_like(text, '[0-9]')", "repeated_mark": "regexp_like(text, '[.]{2,}|[!]{2,}')",
    "no_end": "not regexp_like(trim(text), '[.!?]$')", "unknown_role": "role not in ('user', 'assistant', 'system')", "bad_number": "turn is null or turn < 0",
}


@query(" union all ".join(f"select conv_id, turn, '{k}' as code from conversations where {v.replace('regexp_like', 'regexp_matches')}" for k, v in _TURN_RULES.items())
    + " union all select conv_id, turn, 'same_speaker' from (select *, lag(role) over (partition by conv_id order by turn) as b from conversations) where role = b"
    + " union all select conv_id, turn, 'number_gap' from (select *, lag(turn) over (partition by conv_id order by turn) as b from conversations) where turn <> b + 1"
    + " union all select conv_id, turn, 'repeated_text' from (select *, count(*) over (partition by conv_id, text) as n from conversations) where n > 1 and text is not null")
def turn_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every broken rule of every turn: its own, against the turn before, against its conversation."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumns({"b": F.lag("role").over(w), "t": F.lag("turn").over(w), "n": F.count(F.lit(1)).over(W.partitionBy("conv_id", "text"))})
    rules = {k: F.expr(v) for k, v in _TURN_RULES.items()} | {"same_speaker": F.expr("role = b"), "number_gap": F.expr("turn <> t + 1"), "repeated_text": F.expr("n > 1 and text is not null")}
    return audit.violations(c, ["conv_id", "turn"], rules)


@query("""with s as (select conv_id, count(*) as n, count_if(role = 'user') as u, count_if(role = 'assistant') as a, min(turn) as lo, max(turn) as hi, count(distinct turn) as d from conversations group by 1)
select conv_id, 'few_turns' as code from s where n < 4 union all select conv_id, 'no_user' from s where u = 0 union all select conv_id, 'unbalanced' from s where abs(u - a) > 1 union all select conv_id, 'not_contiguous' from s where hi - lo + 1 <> n or d <> n""")
def plan_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure of whole conversations: number, speakers, balance, contiguous turns."""
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role") == "assistant").alias("a"), F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.countDistinct("turn").alias("d"))
    return audit.violations(s, ["conv_id"], {"few_turns": F.expr("n < 4"), "no_user": F.expr("u = 0"), "unbalanced": F.expr("abs(u - a) > 1"), "not_contiguous": F.expr("hi - lo + 1 <> n or d <> n")})


@query("""with f as (select conv_id, arg_min(text, turn) as t from conversations where role = 'user' group by 1), k as (select conv_id, t, count(*) over (partition by t) as n from f)
select conv_id, 'duplicate' as code from k where n > 1 union all select conv_id, 'leak' from k where contains(lower(t), 'doc') union all select conv_id, 'too_short' from k where length(t) < 30""")
def filler_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening turns that are exact duplicates, leak a token, or are too short."""
    f = table(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    f = f.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("t")))
    return audit.violations(f, ["conv_id"], {"duplicate": F.expr("n > 1"), "leak": F.expr("contains(lower(t), 'doc')"), "too_short": F.expr("length(t) < 30")})


@query(f"""with s as (select user_id, event_id, event_type, {_K} as k, lag({_K}) over (partition by user_id order by event_id) as b, lag(event_type) over (partition by user_id order by event_id) as t from events)
select user_id, event_id, 'status_fell' as code from s where k < b and event_type = t union all select user_id, event_id, 'jump' from s where abs(k - b) > 60 union all select user_id, event_id, 'orphan' from s where b is null and event_type = 'purchase'""")
def snapshot_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event against the one before it: falling values, jumps, orphans."""
    w = W.partitionBy("user_id").orderBy("event_id")
    s = table(spark, sf_dir, "events").withColumn("k", _k()).withColumns({"b": F.lag("k").over(w), "t": F.lag("event_type").over(w)})
    return audit.violations(s, ["user_id", "event_id"], {"status_fell": F.expr("k < b and event_type = t"), "jump": F.expr("abs(k - b) > 60"), "orphan": F.expr("b is null and event_type = 'purchase'")})


@query("""with l as (select l_orderkey, sum((l_extendedprice * 100)::decimal(18,0))::bigint as cents, count(*) as n from lineitem group by 1) select o_orderkey, coalesce(n, 0) as n, case when n is null then 'no_lines' when cents > o_totalprice * 100 then 'over' else 'under' end as code from orders left join l on l_orderkey = o_orderkey""")
def replay_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored totals against those replayed from the lines."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum((F.col("l_extendedprice") * 100).cast("decimal(18,0)").cast("long")).alias("cents"), F.count(F.lit(1)).alias("n"))
    o = table(spark, sf_dir, "orders").join(l, "o_orderkey", "left")
    code = F.when(F.col("n").isNull(), "no_lines").when(F.col("cents") > F.col("o_totalprice") * 100, "over").otherwise("under")
    return o.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), code.alias("code"))


@query("""with t as (select conv_id, list_distinct(string_split(lower(regexp_replace(trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' +', ' ', 'g')), ' ')) as w from (select conv_id, arg_min(text, turn) as text from conversations where role = 'user' group by 1)), u as (select conv_id, list_sort(w) as w from t where len(w) > 0),
c as (select w, min(conv_id) as k from u group by 1), p as (select a.k as a, b.k as b, len(list_intersect(a.w, b.w)) as s, len(a.w) as na, len(b.w) as nb from c a join c b on a.k < b.k)
select a, b, round(s / (na + nb - s), 4) as similarity from p where 100 * s >= 12 * (na + nb - s)""")
def opening_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose first user turns share words, with their similarity."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    words = F.array_distinct(F.split(F.lower(F.trim(F.regexp_replace("text", "[^A-Za-z]+", " "))), " "))
    p = joins.similar_sets(c.select("conv_id", words.alias("w")), "conv_id", "w", 12)
    return p.select("a", "b", F.round(F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared")), 4).alias("similarity"))


# -- sources and sinks ----------------------------------------------------------------------------


@query("select c_custkey, c_mktsegment from customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV over an older one, and read back."""
    path, c = f"{scratch(spark)}/customers", table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    files.write_csv(c.limit(1), path)
    files.write_csv(c, path)
    return spark.read.schema(c.schema).option("header", True).csv(path)


@query("select o_orderkey, o_orderstatus from orders")
def keyed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in one folder of compressed JSON for each status."""
    path, o = f"{scratch(spark)}/orders", table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    files.write_by_key(o, path, ["o_orderstatus"])
    return spark.read.schema(o.schema).json(path)


@query("select 'nations' as part, count(*) as rows from nation union all select 'regions', count(*) from region")
def report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a report as tables of their own."""
    path = f"{scratch(spark)}/report"
    files.write_tables({"nations": table(spark, sf_dir, "nation"), "regions": table(spark, sf_dir, "region")}, path)
    back = lambda n: spark.read.option("header", True).csv(f"{path}/{n}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("part"), "rows")
    return back("nations").unionAll(back("regions"))


@query("select c_custkey, c_nationkey::int as c_nationkey from customer where c_nationkey between 5 and 17")
def unique_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an age range whose keys are unique and hold all wanted ones."""
    c = files.age_between(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 5, 17)
    return files.unique_by_key(c, ["c_custkey"], c.select("c_custkey"))


@query("select n_nationkey::int as n_nationkey, n_name from nation")
def registry_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry that is one JSON array over several lines."""
    path = f"{scratch(spark)}/registry"
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    text = F.concat(F.lit("[\n"), F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct("n_nationkey", "n_name")))), ",\n"), F.lit("\n]"))
    n.agg(text.alias("value")).coalesce(1).write.text(path)
    return files.registry(spark, f"{path}/*.txt", "n_nationkey int, n_name string")


@query("select text_hash, n from (select sha256(lower(trim(text))) as text_hash, count(*) as n from conversations where role = 'user' group by 1) where n > 1 union all select 'all', count(*) from conversations where role = 'user'")
def utterance_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact repeats among user turns, and how many turns there are."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    rep = c.groupBy(F.sha2(F.lower(F.trim("text")), 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rep.unionAll(c.agg(F.lit("all").alias("text_hash"), F.count(F.lit(1)).alias("n")))


@query("select p_partkey, round(p_size * 0.002 + p_retailprice * 0.00001, 6) as cost from part")
def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by their price, cached and fresh apart."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_size") * 0.002 + F.col("p_retailprice") * 0.00001, 6).alias("cost"))


# -- reports ---------------------------------------------------------------------------------------


@query("""with n as (select l_returnflag, l_linenumber, count(*) as n from lineitem group by 1, 2) select l_returnflag, sum(n)::bigint as rows, count(*) as distinct_values, arg_max(l_linenumber, n * 1000 - l_linenumber)::int as top_value, round(max(n) / sum(n), 6) as top_share from n group by 1""")
def concentrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent value of each group and its share."""
    out = R.concentrations(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linenumber")
    return out.withColumn("top_share", F.round("top_share", 6))


@query("select role, count(*) as rows, count_if(length(text) >= 100)::bigint as long_turns, count_if(text like '%?%')::bigint as questions, coalesce(sum(ceil(length(text) / 2.5)), 0)::bigint as tokens from conversations group by 1")
def corpus_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and token sums of each speaker in one pass."""
    out = R.counters(table(spark, sf_dir, "conversations"), ["role"], {"long_turns": F.length("text") >= 100, "questions": F.col("text").contains("?")}, {"tokens": F.ceil(F.length("text") / F.lit(2.5)).cast("long")})
    return out


_FAMILY = ("tion", "ing", "th", "e")


@query("select phrase, count(case when x is not null then 1 end) as n from (values ('tion'), ('ing'), ('th'), ('e')) p(phrase) left join (select case when contains(text, 'tion') then 'tion' when contains(text, 'ing') then 'ing' when contains(text, 'th') then 'th' when contains(text, 'e') then 'e' end as x from conversations) c on x = phrase group by 1")
def phrase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by the longest phrase that they hold."""
    return R.phrase_counts(table(spark, sf_dir, "conversations"), "text", _FAMILY)


@query("""with f as (select o_orderkey, 'price' as code from orders where o_totalprice > 200000 union all select o_orderkey, 'status' from orders where o_orderstatus = 'P')
select code, count(o_orderkey) as n, count(distinct o_orderkey) as hit, round(count(distinct o_orderkey) / (select count(distinct o_orderkey) from orders), 6) as share from (values ('price'), ('status'), ('never')) c(code) left join f using (code) group by 1""")
def violation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of each code, and the share of orders with one."""
    o = table(spark, sf_dir, "orders")
    found = audit.violations(o, ["o_orderkey"], {"price": F.col("o_totalprice") > 200_000, "status": F.col("o_orderstatus") == "P"})
    return R.violation_rates(found, o, ["o_orderkey"], ["price", "status", "never"]).withColumn("share", F.round("share", 6))


@query("""with h as (select distinct user_id, day(ts)::bigint as checkpoint from events), u as (select distinct user_id from events), w as (select user_id, unnest(range(5, 31, 5)) as checkpoint from u)
select user_id, checkpoint, 'missing' as code from (select * from w except select * from h) union all select user_id, checkpoint, 'off_grid' from h where checkpoint % 5 <> 0 or checkpoint not between 5 and 30""")
def grid_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a user that are missing on the grid of fives, or beside it."""
    return R.grid_errors(table(spark, sf_dir, "events").withColumn("day", F.dayofmonth("ts")), ["user_id"], "day", 5, 30)


@query(f"""select event_id, case when {_K} % 3 = 0 then 'kind=' || event_type else 'kind=' || event_type end as slots, case when {_K} % 3 = 0 then 'dropped:extra,set:kind' else 'dropped:extra' end as repairs from events""")
def repaired_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots reconciled with what is true, and what that took."""
    e = table(spark, sf_dir, "events")
    said = F.create_map(F.lit("kind"), F.when(_k() % 3 == 0, "wrong").otherwise(F.col("event_type")), F.lit("extra"), F.lit("x"))
    out = R.repaired(e.select("event_id", said.alias("slots")), e.select("event_id", F.create_map(F.lit("kind"), "event_type", F.lit("more"), F.lit("y")).alias("slots")), ["event_id"], "slots")
    return out.select("event_id", F.concat(F.lit("kind="), F.col("slots.kind")).alias("slots"), F.array_join("repairs", ",").alias("repairs"))


# -- further sources and engine inputs -----------------------------------------------------------


@query("select c_custkey from customer where c_nationkey between 5 and 17 order by sha256('p:' || c_custkey::varchar), c_custkey limit 40")
def sampled_personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty customers of an age range, by seeded order after the range."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return files.sampled_personas(c, "c_nationkey", "c_custkey", 40, "p", 5, 17).select("c_custkey")


@query("select p_partkey, p_name from part where p_partkey in (3, 5, 8, 13)")
def pushed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four parts by key: the keys and the columns reach the scan."""
    return files.pushed_keys(spark, f"{sf_dir}/part.parquet", "p_partkey", [3, 5, 8, 13], ["p_name"])


@query("select item_id, length(text)::int as size from benchmark")
def checked_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank of passages of which none is empty; an empty one would raise."""
    return files.checked_bank(table(spark, sf_dir, "benchmark"), F.length("text") > 0, "an empty passage").select("item_id", F.length("text").alias("size"))


@query(f"""select user_id::varchar as entity, 'home.city' as path, 'update' as op, {_K}::varchar as value, event_id::varchar as source, 1 as spec_no from events where event_type = 'purchase'
union all select user_id::varchar, 'home.lease', 'create', 'yes', event_id::varchar, 2 from events where event_type = 'purchase' and {_K} % 3 in (0, 1)
union all select user_id::varchar, 'job.title', 'set_pending', 'plain', event_id::varchar, 1 from events where event_type = 'click'""")
def template_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that events cause by their templates, where the conditions hold."""
    e, k = table(spark, sf_dir, "events"), _k()
    params = F.create_map(F.lit("k"), k.cast("string"), F.lit("third"), (k % 3).cast("string"))
    status = F.when(F.col("event_type") == "purchase", "occurred").otherwise("upcoming")
    t = e.select(F.col("user_id").cast("string").alias("entity"), F.col("event_type").alias("event"), status.alias("hook"), status.alias("status"), params.alias("params"), F.dayofmonth("ts").alias("month"), F.col("event_id").cast("string").alias("instance"), F.col("event_id").alias("order"))
    kinds = "event string, hook string, spec_no int, path string, op string, value_from string, wanted map<string,array<string>>"
    specs = [("purchase", "occurred", 1, "home.city", "update", "param:k", {}), ("purchase", "occurred", 2, "home.lease", "create", "literal:yes", {"third": ["0", "1"]}), ("purchase", "occurred", 3, "home.pet", "create", "x", {"pet": ["dog"]}), ("click", "upcoming", 1, "job.title", "set_pending", "plain", {})]
    return memory.template_changes(t, spark.createDataFrame(specs, kinds)).select("entity", "path", "op", "value", "source", "spec_no")


@query("select o_custkey, array_to_string(list_sort(list_distinct(list(trim(regexp_replace(' ' || o_orderpriority || '  x ', '\\s+', ' ', 'g'))))), ',') as kinds, case when bool_and(o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM')) then 0 else count_if(o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM')) end::int as bad from orders group by 1")
def canonical_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists as they are compared, and how many elements are not allowed."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("p"))
    wide = F.transform("p", lambda x: F.concat(F.lit(" "), x, F.lit("  x ")))
    return o.select("o_custkey", F.array_join(projections.canonical_list(wide), ",").alias("kinds"), F.size(projections.closed_value_errors(F.col("p"), ["1-URGENT", "2-HIGH", "3-MEDIUM"])).alias("bad"))
