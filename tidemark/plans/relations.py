"""Queries of joins, sets, samples, audits and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import text as T
from tidemark.operators import audit, joins, masking, sets
from tidemark.plans._base import query, table
from tidemark.sources import files

_CLICKS = "select user_id, ts, event_id from events where event_type = 'click'"
_BUYS = "select user_id, ts, event_id from events where event_type = 'purchase'"


def _of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(F.col("event_type") == kind)


@query(f"select p.user_id, p.event_id, c.event_id as click_id from ({_BUYS}) p asof left join ({_CLICKS}) c on p.user_id = c.user_id and p.ts >= c.ts")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every purchase the latest click of the user at or before it."""
    out = joins.asof(_of(spark, sf_dir, "purchase"), _of(spark, sf_dir, "click"), ["user_id"], ["ts"], ["event_id"])
    return out.select("user_id", "event_id", F.col("asof_event_id").alias("click_id"))


@query("""select o.o_orderkey, o.o_custkey, coalesce(b.total, 0.0) as before_total from orders o
asof left join (select o_custkey, o_orderdate, max(o_totalprice) as total from orders group by all) b on b.o_custkey = o.o_custkey and b.o_orderdate < o.o_orderdate""")
def asof_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price of the customer's last order on an earlier day (the largest of that day), 0 before the first."""
    o = table(spark, sf_dir, "orders")
    out = joins.asof(o.select("o_orderkey", "o_custkey", "o_orderdate"), o, ["o_custkey"], ["o_orderdate"], ["o_totalprice"], strict=True)
    return out.select("o_orderkey", "o_custkey", F.coalesce("asof_o_totalprice", F.lit(0.0)).alias("before_total"))


@query("""select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey""")
def validated_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 1:1 join that raises on repeated or one-sided keys: nations with themselves, then their region."""
    n = table(spark, sf_dir, "nation")
    one = joins.validated_one_to_one(n.select("n_nationkey", "n_regionkey"), n.select("n_nationkey", "n_name"), ["n_nationkey"])
    return one.join(F.broadcast(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")), "n_regionkey").select("n_nationkey", "n_name", "r_name")  # nations of a fixed number


@query("""select d.doc_id, case when l.doc_id is not null then l.lang else d.lang end as lang, l.quality from documents d
left join (select doc_id, quality, case when toxic = 1 then null else 'en' end as lang from labels) l using (doc_id)""")
def left_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join whose right side overwrites, with nulls too."""
    right = table(spark, sf_dir, "labels").select("doc_id", "quality", F.when(F.col("toxic") != 1, "en").alias("lang"))
    return joins.left_overwrite(table(spark, sf_dir, "documents").select("doc_id", "lang"), right, ["doc_id"])


@query("""select c_custkey, case when s.k is not null then s.v else c_acctbal end as c_acctbal, c_name from customer
left join (select c_custkey as k, round(c_acctbal + 1, 2) as v from customer where c_custkey % 3 = 0) s on s.k = c_custkey""")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert that leaves the protected column c_name alone."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    source = c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("x").alias("c_name"), F.round(F.col("c_acctbal") + 1, 2).alias("c_acctbal"))
    return joins.merge_upsert(c, source, ["c_custkey"], protected=["c_name"])


_PERIODS = "select n_regionkey, p, make_date(1992 + 2 * p, 1, 1) as d0, case when p < 3 then make_date(1994 + 2 * p, 12, 31) end as d1 from (select distinct n_regionkey from nation), (select unnest([0, 1, 2, 3]) as p)"


@query(f"""select o_orderkey, p::int as p from (select o.o_orderkey, r.p, row_number() over (partition by o.o_orderkey order by r.p) as rn from orders o
join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join ({_PERIODS}) r using (n_regionkey)
where o.o_orderdate >= r.d0 and (r.d1 is null or o.o_orderdate <= r.d1)) where rn = 1""")
def interval_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the first of the overlapping price periods of their region that holds the day; the last one is open."""
    n = table(spark, sf_dir, "nation")
    periods = n.select("n_regionkey").distinct().withColumn("p", F.explode(F.array(*map(F.lit, range(4)))))
    periods = periods.withColumn("d0", F.make_date(1992 + 2 * F.col("p"), F.lit(1), F.lit(1))).withColumn("d1", F.when(F.col("p") < 3, F.make_date(1994 + 2 * F.col("p"), F.lit(12), F.lit(31))))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_regionkey")
    facts = table(spark, sf_dir, "orders").join(c, "o_custkey").select("o_orderkey", "n_regionkey", F.to_date("o_orderdate").alias("d"))
    return joins.interval(facts, periods, ["n_regionkey"], "d", "d0", "d1", ["p"], ["o_orderkey"]).select("o_orderkey", "p")


@query("""select event_id, near from (select e.event_id, c.event_id as near, row_number() over (partition by e.event_id order by abs(e.event_id - c.event_id), c.event_id) as rn
from (select * from events where event_type = 'signup') e join (select * from events where event_type = 'error') c using (user_id)) where rn = 1""")
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each signup the user's error with the nearest number; ties go to the smaller one."""
    left = _of(spark, sf_dir, "signup").select("user_id", "event_id")
    out = joins.nearest(left, _of(spark, sf_dir, "error").select("user_id", F.col("event_id").alias("near")), ["user_id"], "event_id", "near", ["event_id"])
    return out.filter("near is not null").select("event_id", "near")


@query("""with s(event, kind, spec_order) as (values ('click', 'a', 1), ('purchase', 'a', 2), ('purchase', 'b', 3), ('error', 'c', 4)),
a as (select distinct user_id, kind, kind || user_id::varchar as action_id from events, (values ('a'), ('b'), ('c')) k(kind))
select user_id, action_id, event_id, event from (select e.user_id, a.action_id, e.event_id, s.event, row_number() over (partition by e.user_id, a.action_id order by e.event_id, s.spec_order) as rn
from events e join s on s.event = e.event_type join a on a.user_id = e.user_id and a.kind = s.kind) where rn = 1""")
def first_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each standing action of a user is hit by the first event that a spec connects to it."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("event"))
    specs = spark.createDataFrame([("click", "a", 1), ("purchase", "a", 2), ("purchase", "b", 3), ("error", "c", 4)], "event string, kind string, spec_order int")
    actions = e.select("user_id").distinct().withColumn("kind", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c")))).withColumn("action_id", F.concat("kind", F.col("user_id").cast("string")))
    return joins.first_impacts(e, actions, specs, "user_id", ["event_id"]).select("user_id", "action_id", "event_id", "event")


@query("""with u as (select user_id, list(distinct json_extract_string(props, '$.k')) as s from events where event_type = 'click' group by 1),
i as (select u.user_id, unnest(s) as x, len(s) as n from u), p as (select a.user_id as a, b.user_id as b, count(*) as shared, any_value(a.n) as na, any_value(b.n) as nb from i a join i b on a.x = b.x and a.user_id < b.user_id group by 1, 2)
select a, b, shared, na::bigint as size_a, nb::bigint as size_b from p where 100 * shared >= 15 * (na + nb - shared)""")
def similar_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose sets of clicked keys have a Jaccard similarity of 0.15 or more, equal sets too, by pairs of blocks; a click without a key counts in its user's set."""
    clicks = _of(spark, sf_dir, "click").select("user_id", F.get_json_object("props", "$.k").alias("k"))
    # collect_set leaves nulls out; a set has one at most
    null = F.array_repeat(F.lit(None).cast("string"), F.max(F.col("k").isNull().cast("int")))
    return joins.similar_sets(clicks.groupBy("user_id").agg(F.concat(F.collect_set("k"), null).alias("s")), "user_id", "s", 15, copies=True)


@query("""with c as (select d.doc_id, d.lang, d.source from documents d), e as (select distinct d.lang, d.source from documents d join labels l using (doc_id) where quality = 1)
select doc_id, e.lang is not null as grounded from c left join e on c.lang is not distinct from e.lang and c.source is not distinct from e.source""")
def grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a good labelled document agrees with each document in language and source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    good = d.join(table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return joins.grounded(d, good, [("lang", F.col("lang")), ("source", F.col("source"))]).select("doc_id", "grounded")


@query("select a.r_name as left_name, b.r_name as right_name from region a join region b on a.r_name < b.r_name")
def ordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.ordered_pairs(table(spark, sf_dir, "region"), "r_name").toDF("left_name", "right_name")


@query("select l_suppkey, l_partkey, l_orderkey from (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) as r from lineitem) where r = 1")
def first_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier: its first line."""
    return joins.first_mapping(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"]).select("l_suppkey", "l_partkey", "l_orderkey")


@query("select o_custkey, count(*) as n from orders group by 1 having count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.duplicates(table(spark, sf_dir, "orders"), ["o_custkey"])


_KEYED = "select distinct user_id, json_extract_string(props, '$.k') as k from events where event_type = "


@query(f"""with c as ({_KEYED} 'click'), p as ({_KEYED} 'purchase')
select *, 'left' as side from (select * from c except select * from p) union all select *, 'right' from (select * from p except select * from c)""")
def key_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and keys that were only clicked or only bought."""
    c, p = (_of(spark, sf_dir, kind).select("user_id", F.get_json_object("props", "$.k").alias("k")) for kind in ("click", "purchase"))
    return joins.key_mismatch(c, p, ["user_id", "k"])


_A = "select l_returnflag as f, l_linenumber as n from lineitem where l_quantity < 25"
_B = "select l_returnflag as f, l_linenumber as n from lineitem where l_quantity >= 25"


@query(f"""with d as (select f, n, sum(w)::bigint as d from (select *, 1 as w from ({_A}) union all select *, -1 from ({_B})) group by 1, 2)
select f, n, case when d > 0 then 'left' else 'right' end as side, abs(d)::bigint as times from d where d <> 0""")
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", F.col("l_returnflag").alias("f"), F.col("l_linenumber").alias("n"))
    return sets.multiset_diff(rows.filter("l_quantity < 25").drop("l_quantity"), rows.filter("l_quantity >= 25").drop("l_quantity"))


@query(f"""with a as ({_KEYED} 'click'), b as ({_KEYED} 'error')
select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.k, b.k) as k, case when a.user_id is null then 'new' when b.user_id is null then 'lost' else 'retained' end as fate from a full join b on a.user_id = b.user_id and a.k = b.k""")
def set_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which keys of a user's clicks the errors retain, lose or add."""
    click, error = (_of(spark, sf_dir, kind).select("user_id", F.get_json_object("props", "$.k").alias("k")) for kind in ("click", "error"))
    return sets.changes(click, error)


@query("""select c_custkey, c_mktsegment from (select *, row_number() over (partition by c_mktsegment order by sha256('9:' || c_custkey::varchar), c_custkey) as r from customer)
where r <= case c_mktsegment when 'BUILDING' then 20 when 'MACHINERY' then 7 else 0 end""")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly so many customers of each segment, in seeded order."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return sets.quota_sample(c, "c_mktsegment", {"BUILDING": 20, "MACHINERY": 7}, "9", "c_custkey")


@query("select p_partkey from part order by sha256('s:' || p_partkey::varchar), p_partkey limit 100")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.hash_sample(table(spark, sf_dir, "part").select("p_partkey"), 100, "s", "p_partkey")


@query("""with n as (select user_id, event_id, row_number() over (partition by user_id order by ts) - 1 as i, count(*) over (partition by user_id) as c from events),
b as (select *, least(i // greatest(c // 4, 1), 3)::bigint as bin from n)
select user_id, bin, event_id from (select *, row_number() over (partition by user_id, bin order by sha256('b:' || event_id::varchar), event_id) as r from b) where r = 1""")
def bin_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event for each quarter of a user's history."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return sets.bin_representatives(e, ["user_id"], ["ts"], 4, "b", "event_id").select("user_id", "bin", "event_id")


@query("select o_custkey, o_orderkey, rank::bigint as rank from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3")
def top_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sets.top_per(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3)
    return out.select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("""with a as (select doc_id from labels where toxic = 1 order by sha256('r:toxic:' || doc_id::varchar), doc_id limit 10),
b as (select doc_id from labels where quality = 0 and doc_id not in (select doc_id from a) order by sha256('r:poor:' || doc_id::varchar), doc_id limit 15),
c as (select doc_id from labels where doc_id not in (select doc_id from a union all select doc_id from b) order by sha256('r:rest:' || doc_id::varchar), doc_id limit 20)
select doc_id, 'toxic' as stratum from a union all select doc_id, 'poor' from b union all select doc_id, 'rest' from c""")
def strata_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review packet: ordered strata, the first that takes a row keeps it."""
    strata = [("toxic", "toxic = 1", 10), ("poor", "quality = 0", 15), ("rest", "true", 20)]
    return sets.strata_claims(table(spark, sf_dir, "labels"), "doc_id", strata, "r").select("doc_id", "stratum")


_RULES = {"price": "o_totalprice < 1000", "status": "o_orderstatus = 'P'", "priority": "o_orderpriority like '5%' and o_totalprice > 400000"}


@query(" union all ".join(f"select o_orderkey, '{k}' as code from orders where {v}" for k, v in _RULES.items()))
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every broken rule of every order, in one pass."""
    return audit.violations(table(spark, sf_dir, "orders"), ["o_orderkey"], {k: F.expr(v) for k, v in _RULES.items()})


@query("select code, coalesce(n, 0) as n from (values ('price'), ('status'), ('priority'), ('none')) c(code) left join (" + "select code, count(*) as n from (" + " union all ".join(f"select '{k}' as code from orders where {v}" for k, v in _RULES.items()) + ") group by 1) using (code)")
def violation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.code_counts(violations(spark, sf_dir), [*_RULES, "none"])


@query("select user_id, event_id, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) as b from events) where event_type = b")
def not_alternating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the same kind as the user's event before."""
    return audit.not_alternating(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


@query("""select l_orderkey, count(*) as n, min(l_linenumber) as lowest, max(l_linenumber) as highest, count(distinct l_linenumber) as n_distinct from lineitem group by 1
having not (min(l_linenumber) = 1 and max(l_linenumber) = count(*) and count(distinct l_linenumber) = count(*))""")
def numbering_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines are not numbered 1, 2, ..."""
    return audit.gaps(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", 1)


@query("select s_suppkey, s_name, r.r_name from supplier join nation on s_nationkey = n_nationkey join region r on n_regionkey = r_regionkey where try_cast(s_acctbal as int) between 100 and 5000")
def filtered_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range filter and an export that raises if a column outside of the allowed ones would leave."""
    s = files.age_between(table(spark, sf_dir, "supplier"), "round(s_acctbal)", 100, 5000).join(table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    s = s.join(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select("s_suppkey", "s_name", "r_name")
    return files.export(s, ["s_suppkey", "s_name", "r_name"], ["s_acctbal"])


_MASKED = {"full": "()", "mask_terminal": "('purchase', 'error', 'signup')", "mask_upcoming": "('purchase', 'error', 'signup', 'click')", "mask_all": "('purchase', 'error', 'signup', 'click', 'view')"}
_TYPE = {"purchase": "occurred_evidence", "error": "consequence_session", "signup": "stale_recall_session", "click": "upcoming_evidence", "view": "weak_signal_evidence"}


@query(" union all ".join(f"select event_id, '{k}' as level, {'false' if v == '()' else f'event_type in {v}'} as masked, {'value' if v == '()' else f'case when event_type not in {v} then value end'} as value from events" for k, v in _MASKED.items()))
def mask_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event at four nested mask levels."""
    e = table(spark, sf_dir, "events")
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _TYPE.items()], F.lit("routine_financial"))
    return masking.ladder(e.select("event_id", "value", kind.alias("kind")), "kind", ["value"]).select("event_id", "level", "masked", "value")


@query("""select c.conv_id, c.turn, case when d.conv_id is not null then d.text else c.text end as text, d.conv_id is not null as replaced from conversations c
left join (select a.conv_id, a.turn, b.text from conversations a join conversations b on b.conv_id = a.conv_id - 1 and b.turn = a.turn where a.role = 'user') d on d.conv_id = c.conv_id and d.turn = c.turn""")
def replace_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns replaced by the turn at the same place of the conversation before."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    slots = c.filter("role = 'user'").select("conv_id", "turn")
    donors = slots.join(c.select((F.col("conv_id") + 1).alias("conv_id"), "turn", "text"), ["conv_id", "turn"])
    return masking.replace_slots(c.drop("role"), donors, ["conv_id", "turn"], ["text"]).select("conv_id", "turn", "text", "replaced")


@query("""select 'D' || lpad((doc_id % 1000)::varchar, 3, '0') as public_id, doc_id, (doc_id % 1000)::int as number from documents""")
def public_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.format_string("S%03d", F.col("doc_id") % 1000)
    return table(spark, sf_dir, "documents").select(T.public_id(s).alias("public_id"), "doc_id", T.session_number(s).alias("number"))
