"""Queries of scores, summaries and resampling statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import aggregates as A, masking, resample
from tidemark.plans._base import query, table

#: An event's outcome and the confidence in it, for the calibration queries.
_CONF = "select user_id, event_id, event_type, (json_extract_string(props, '$.k')::int % 101) / 100.0::double as conf, event_type = 'purchase' as hit from events"


def _conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.get_json_object("props", "$.k").cast("int") % 101 / F.lit(100.0)).alias("conf"), (F.col("event_type") == "purchase").alias("hit"))


_ITEMS = """select user_id, day(ts)::int as day, count_if(event_type = 'click' and value < 30) as m, count_if(event_type = 'click') as p, count_if(value < 30 and event_type <> 'view') as g from events group by 1, 2"""


@query(f"""with i as ({_ITEMS}), r as (select user_id, day, case when p = 0 and g = 0 then 1.0 when p = 0 then 0.0 else m / p end as pr, case when p = 0 and g = 0 then 1.0 when g = 0 then 0.0 else m / g end as re from i)
select user_id, day, round(pr, 9)::double as precision, round(re, 9)::double as recall, round(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end, 9)::double as f1 from r""")
def prf_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 with their rules for empty sides."""
    e = table(spark, sf_dir, "events")
    i = e.groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.count_if(F.expr("event_type = 'click' and value < 30")).alias("m"), F.count_if(F.expr("event_type = 'click'")).alias("p"), F.count_if(F.expr("value < 30 and event_type <> 'view'")).alias("g"))
    p, r, f = A.prf(F.col("m"), F.col("p"), F.col("g"))
    return i.select("user_id", "day", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(f, 9).alias("f1"))


@query("""select user_id, round(hits / nullif(sales, 0), 9)::double as ratio from (select user_id, count_if(event_type = 'click') as hits, count_if(event_id % 7 = 0 and event_type = 'purchase') as sales from events group by 1)""")
def safe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.expr("event_type = 'click'")).alias("a"), F.count_if(F.expr("event_id % 7 = 0 and event_type = 'purchase'")).alias("b"))
    return out.select("user_id", F.round(A.ratio(F.col("a"), F.col("b")), 9).alias("ratio"))


@query("""with a as (select c_nationkey, o_custkey, avg(o_totalprice) as v from orders join customer on o_custkey = c_custkey group by 1, 2), b as (select c_nationkey, avg(v) as v from a group by 1)
select round(avg(v), 4) as price from b""")
def macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over nations of means over customers of mean prices."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    return A.macro(o.withColumnRenamed("o_totalprice", "price"), [["c_nationkey", "o_custkey"], ["c_nationkey"]], ["price"]).select(F.round("price", 4).alias("price"))


_BINS = f"select case when conf = 1.0 then 9 else floor(conf * 10 + 1e-9) end::int as bin, count(*) as n, avg(conf) as confidence, avg(hit::int::double) as accuracy from ({_CONF}) group by 1"


@query(f"select bin, n, round(confidence, 9) as confidence, round(accuracy, 9) as accuracy from ({_BINS})")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.calibration_bins(_conf(spark, sf_dir), "conf", "hit").select("bin", "n", F.round("confidence", 9).alias("confidence"), F.round("accuracy", 9).alias("accuracy"))


@query(f"select sum(n)::bigint as n, round(sum(n * abs(confidence - accuracy)) / sum(n), 9) as ece from ({_BINS})")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.calibration_error(_conf(spark, sf_dir), "conf", "hit").select("n", F.round("ece", 9).alias("ece"))


@query(f"select event_type, round(avg((conf - hit::int) ** 2), 9) as brier, round(avg(conf), 9) as mean_confidence, count(conf) as n from ({_CONF}) group by 1")
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.brier(_conf(spark, sf_dir), ["event_type"], "conf", "hit").select("event_type", F.round("brier", 9).alias("brier"), F.round("mean_confidence", 9).alias("mean_confidence"), "n")


@query("""with g as (select user_id, event_type, json_extract_string(props, '$.k') as k, count(*) as g from events where event_id % 2 = 0 group by all), p as (select user_id, event_type, json_extract_string(props, '$.k') as k, count(*) as p from events where event_id % 2 = 1 group by all)
select user_id, sum(least(coalesce(g, 0), coalesce(p, 0)))::bigint as tp, sum(coalesce(p, 0))::bigint as n_pred, sum(coalesce(g, 0))::bigint as n_gold from g full join p using (user_id, event_type, k) group by 1""")
def multiset_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even against odd events of each user as multisets of (kind, key)."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return A.multiset_scores(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "user_id", ["event_type", "k"])


@query("""with r as (select o_orderstatus as g, case when o_orderkey % 4 = 0 then 'P' when o_orderkey % 9 = 0 then 'X' else o_orderstatus end as p from orders), c as (select g as label, count(*) as n_gold, count_if(g = p) as tp from r group by 1), d as (select p as label, count(*) as n_pred from r group by 1)
select label, tp, coalesce(n_pred, 0) as n_pred, n_gold, round(2.0 * tp / (coalesce(n_pred, 0) + n_gold), 9)::double as f1 from c left join d using (label)""")
def class_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("p", F.expr("case when o_orderkey % 4 = 0 then 'P' when o_orderkey % 9 = 0 then 'X' else o_orderstatus end"))
    return A.class_f1(o, "o_orderstatus", "p").withColumn("f1", F.round("f1", 9))


@query("""with c as (select l_shipmode, i, case when l_linenumber % 5 = 0 then null else i end as g, case when l_linenumber % 3 = 0 then 'z' when l_linenumber % 4 = 0 then i else case when l_linenumber % 5 = 0 then null else i end end as p, l_linenumber % 7 <> 0 as said
    from (select l_returnflag as l_shipmode, l_linestatus as i, l_linenumber from lineitem)),
k as (select *, g is distinct from i as ch, said and p is distinct from i as sa, said and p is not distinct from g as ok from c)
select l_shipmode as flag, count_if(ch and sa and ok) as tp_correct, count_if(ch and sa and not ok) as tp_wrong_value, count_if(ch and not sa) as fn, count_if(not ch and sa) as fp, count_if(not ch and not sa) as tn, count_if(ok) as n_right, count(*) as n_cells from k group by 1""")
def cell_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State cells by what changed and what was said to change."""
    gold = F.expr("case when l_linenumber % 5 <> 0 then l_linestatus end")
    c = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("initial"), gold.alias("gold"), F.when(F.col("l_linenumber") % 3 == 0, "z").when(F.col("l_linenumber") % 4 == 0, F.col("l_linestatus")).otherwise(gold).alias("predicted"), (F.col("l_linenumber") % 7 != 0).alias("is_predicted"))
    return A.cell_confusion(c, ["flag"])


@query("""with e as (select event_type, case when event_id % 3 = 0 then null else event_id % 5 end as d, conf from (select * from (""" + _CONF + """)))
select 'event_type' as dimension, event_type as value, count(*) as n, round(avg(conf), 9) as mean from e group by event_type
union all select 'd', case when d is null or d = 0 then 'unknown' else d::varchar end as v, count(*), round(avg(conf), 9) from e group by v""")
def by_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary for each dimension in one pass; empty values are unknown."""
    e = _conf(spark, sf_dir).withColumn("d", F.expr("case when event_id % 3 <> 0 then event_id % 5 end"))
    return A.by_dimensions(e, ["event_type", "d"], F.col("conf")).withColumn("mean", F.round("mean", 9))


@query("select l_returnflag, quantile_disc(l_extendedprice, 0.5) as p50, quantile_disc(l_extendedprice, 0.9) as p90, quantile_disc(l_extendedprice, 0.99) as p99 from lineitem group by 1")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.nearest_rank(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.5, 0.9, 0.99])


@query("""with a as (select l_returnflag, avg(l_quantity) filter (where l_linenumber = 1) as a, avg(l_quantity) filter (where l_linenumber = 2) as b, avg(l_quantity) filter (where l_linenumber = 3) as c from lineitem group by 1)
select l_returnflag, round(a, 6) as "1", round(b, 6) as "2", round(c, 6) as "3", round((a + b + c) / 3, 6) as mean from a""")
def pivot_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.pivot_ladder(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linenumber", "l_quantity", [1, 2, 3])
    return out.select("l_returnflag", *[F.round(f"`{c}`", 6).alias(c) for c in ("1", "2", "3", "mean")])


@query("select l_orderkey, count_if(l_quantity > 25) as yes, count(*) as n, count_if(l_quantity > 25) * 2 > count(*) as majority from lineitem group by 1")
def majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.majority(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_quantity") > 25)


@query("""with m as (select 'rows' as name, count(*)::double as value from orders union all select 'max', max(o_totalprice) from orders union all select 'none', null)
select name, verdict from (values ('rows', 'PASS'), ('none', 'FAIL'), ('max', 'REVIEW')) v(name, verdict) join m using (name)""")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics against limits; a metric that is missing fails."""
    o = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).cast("double").alias("rows"), F.max("o_totalprice").alias("max"))
    m = o.unpivot([], ["rows", "max"], "name", "value")
    limits = spark.createDataFrame([("rows", 1.0, 1e15, "FAIL"), ("none", 0.0, 1.0, "FAIL"), ("max", 0.0, 1.0, "REVIEW")], "name string, low double, high double, severity string")
    return A.gates(m, limits).select("name", "verdict")


@query("select doc_id, case when text is null or text = '' then 'empty' when n_chars < 100 then 'short' when lang <> 'en' then 'language' end as reason from documents")
def first_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that a document fails."""
    r = A.first_reason((F.coalesce(F.col("text"), F.lit("")) == "", "empty"), (F.col("n_chars") < 100, "short"), (F.col("lang") != "en", "language"))
    return table(spark, sf_dir, "documents").select("doc_id", r.alias("reason"))


@query("""with e as (select user_id, list(distinct json_extract_string(props, '$.k')) filter (where event_type = 'error') as w, list(distinct json_extract_string(props, '$.k')) filter (where event_type = 'click') as f from events group by 1), x as (select user_id, coalesce(w, []) as w, coalesce(f, []) as f from e), h as (select *, len(list_intersect(w, f)) as hit from x)
select user_id, hit > 0 as any_hit, len(w) > 0 and hit = len(w) as all_found, case when len(w) > 0 then round(hit / len(w), 9) end as recall from h""")
def retrieval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_type") == "error", F.get_json_object("props", "$.k"))).alias("w"), F.collect_set(F.when(F.col("event_type") == "click", F.get_json_object("props", "$.k"))).alias("f"))
    return A.retrieval_recall(e, "w", "f").select("user_id", "any_hit", "all_found", F.round("recall", 9).alias("recall"))


@query("select coalesce(value, 'unknown') as value, count(*) as n, row_number() over (order by count(*) desc, coalesce(value, 'unknown')) as place from (select case when doc_id % 10 > 0 then source end as value from documents) group by 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.histogram(table(spark, sf_dir, "documents").withColumn("v", F.expr("case when doc_id % 10 > 0 then source end")), "v")
    return out.select("value", "n", F.col("place").cast("long").alias("place"))


@query("""select event_id, case when event_id % 2 = 0 then 'no_retraction_opportunity' when event_id % 3 > 0 and event_id % 5 > 0 then 'evidence_dependent' when event_id % 3 = 0 and event_id % 5 > 0 then 'commits_from_pre_occurrence_evidence'
when event_id % 3 = 0 then 'structural_or_unsupported_persistence' else 'inconsistent_persistence' end as verdict from events""")
def mask_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", masking.verdict(n % 2 != 0, n % 3 == 0, n % 5 == 0).alias("verdict"))


_CLUSTERS = "select row_number() over (order by user_id) - 1 as i, sum((value * 100)::decimal(18,0))::bigint as s, count(*) as n from events group by user_id"
_DRAWS = 200
_MEANS = f"""select rep, (sum(s) / sum(n)) as mean from (select rep, ('0x' || substr(sha256('7:' || rep::varchar || ':' || slot::varchar), 1, 8))::bigint % (select count(*) from ({_CLUSTERS})) as i
from (select unnest(range({_DRAWS})) as rep), (select unnest(range((select count(*) from ({_CLUSTERS})))) as slot)) join ({_CLUSTERS}) using (i) group by 1"""


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", (F.col("value") * 100).cast("decimal(18,0)").cast("long").alias("cents"))
    return resample.cluster_sums(e, "user_id", "cents")


@query(f"select rep, round(mean, 6) as mean from ({_MEANS})")
def bootstrap_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustered bootstrap replicates of the mean value of an event."""
    return resample.bootstrap_means(spark, _clusters(spark, sf_dir), _DRAWS, "7").select("rep", F.round("mean", 6).alias("mean"))


@query(f"""with m as (select list_sort(list(mean)) as m from ({_MEANS})) select round(m[{int(0.025 * _DRAWS) + 1}], 6) as low, round(m[{min(_DRAWS - 1, int(0.975 * _DRAWS)) + 1}], 6) as high,
round(m[{int(0.025 * (_DRAWS - 1)) + 1}], 6) as inner_low, round(m[{int(0.975 * (_DRAWS - 1)) + 1}], 6) as inner_high from m""")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the replicates by both index rules."""
    means = resample.bootstrap_means(spark, _clusters(spark, sf_dir), _DRAWS, "7")
    both = resample.interval(means).join(resample.interval(means, inner=True).toDF("inner_low", "inner_high"))  # one row each
    return both.select(*[F.round(c, 6).alias(c) for c in both.columns])


@query(f"""with c as (select i, s - 11000 * n as s, n from ({_CLUSTERS})), o as (select sum(s) / sum(n) as observed from c),
f as (select rep, sum(s * case when ('0x' || substr(sha256('3:' || rep::varchar || ':' || i::varchar), 1, 8))::bigint % 2 = 0 then 1 else -1 end) / sum(n) as m from (select unnest(range({_DRAWS})) as rep), c group by 1)
select round(any_value(observed), 6) as observed, round((count_if(abs(m) >= abs(observed) - 1e-12) + 1) / (count(*) + 1), 9) as p_value from f, o""")
def sign_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _clusters(spark, sf_dir).withColumn("s", F.col("s") - 11000 * F.col("n"))
    return resample.sign_flip(spark, c, _DRAWS, "3").select(F.round("observed", 6).alias("observed"), F.round("p_value", 9).alias("p_value"))
