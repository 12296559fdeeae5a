"""Queries of ordered histories: windows, versioned state, ledgers, simulation, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemark.functions import dates, text as T
from tidemark.operators import align, memory, simulate, windows
from tidemark.plans._base import query, table
from tidemark.streaming import events as streams, state

_N = "select *, row_number() over (partition by user_id order by ts) as no from events"
_HIST = "cast(user_id as string) as entity"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.numbered(table(spark, sf_dir, "events"), ["user_id"], ["ts"])


@query(f"select user_id, event_id, no from ({_N})")
def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).select("user_id", "event_id", "no")


@query(f"""with b as (select user_id, ceil(no / 15)::bigint as block, count(*) as c, count_if(event_type = 'purchase') as purchases, sum((value * 100)::decimal(18,0))::bigint as cents from ({_N}) group by all)
select user_id, block * 15 as checkpoint, (sum(purchases) over w)::bigint as purchases, (sum(cents) over w)::bigint as cents from b window w as (partition by user_id order by block) qualify c = 15""")
def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every prefix of 15, 30, ... events."""
    aggs = [F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.sum((F.col("value") * 100).cast("decimal(18,0)").cast("long")).alias("cents")]
    return windows.checkpoints(_numbered(spark, sf_dir), ["user_id"], "no", 15, aggs).select("user_id", "checkpoint", "purchases", "cents")


@query(f"select user_id, ceil(no / 15)::bigint as block, count(*) as n, min(no) as first_no, max(no) as last_no, count(*) = 15 and max(no) - min(no) = 14 as whole from ({_N}) group by 1, 2")
def tumbling_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling_blocks(_numbered(spark, sf_dir), ["user_id"], "no", 15)


@query("""with r as (select *, coalesce(event_type = lag(event_type) over (partition by user_id order by ts), false) as repeats from events)
select event_id, repeats, last_value(case when not repeats then value end ignore nulls) over (partition by user_id order by ts) as value from r""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads blanked where the event repeats the one before, and filled again from the last that does not."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    flagged = windows.flag_repeats(e, ["user_id"], ["ts"], ["event_type"]).withColumn("value", F.when(~F.col("repeats"), F.col("value")))
    return windows.carry_forward(flagged, ["user_id"], ["ts"], ["value"], "repeats").select("event_id", "repeats", "value")


@query(f"""with n as ({_N}), c as (select distinct user_id, c.cp as checkpoint from n, (select unnest(range(20, 2000, 20)) as cp) c where c.cp <= (select max(m.no) // 20 * 20 from n m where m.user_id = n.user_id))
select c.user_id, n.event_type, c.checkpoint, max_by(n.value, n.no) as value from c join n on n.user_id = c.user_id and n.no <= c.checkpoint group by 1, 2, 3""")
def latest_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each kind of event of a user at every 20th event: intervals, without a replay of prefixes."""
    out = windows.latest_at(_numbered(spark, sf_dir), ["user_id", "event_type"], ["user_id"], "no", 20, "value")
    return out.select("user_id", "event_type", "checkpoint", "value")


@query("""with s as (select conv_id, turn, list_distinct(string_split(lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' ')) as w from conversations), b as (select *, coalesce(lag(w) over (partition by conv_id order by turn), []) as p from s)
select conv_id, turn, len(list_filter(w, lambda x: not list_contains(p, x)))::bigint as came, len(list_filter(p, lambda x: not list_contains(w, x)))::bigint as went from b""")
def newly_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words each turn adds to those of the turn before, and how many go."""
    c = table(spark, sf_dir, "conversations").withColumn("w", F.array_distinct(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z]+", " ")), " ")))
    out = windows.newly_seen(c, ["conv_id"], "turn", "w")
    return out.select("conv_id", "turn", F.size("came").cast("long").alias("came"), F.size("went").cast("long").alias("went"))


_RANK = {"view": 1, "click": 2, "purchase": 3}


@query("""with r as (select user_id, event_id, ts, case event_type when 'view' then 1 when 'click' then 2 when 'purchase' then 3 end as rank from events), l as (select *, lag(rank) over (partition by user_id order by ts) as rank_before from r where rank is not null)
select event_id, rank, rank_before from l where rank < rank_before""")
def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose stage is below that of the user's event before."""
    rank = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _RANK.items()])
    return windows.regressions(table(spark, sf_dir, "events"), ["user_id"], ["ts"], rank).select("event_id", "rank", "rank_before")


@query("""with n as (select *, row_number() over (partition by user_id order by ts) - 1 as i, event_type = 'purchase' as hit from events),
g as (select user_id, min(case when hit then i end) as lag, min_by(value, ts) filter (where hit) as first_value, max_by(value, ts) filter (where hit) as last_value, count_if(hit) as hits, count(*) as n from n group by 1)
select user_id, lag, hits, round(last_value - first_value, 4) as drift, round(hits / (n - lag), 6) as retention from g""")
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of a user's first purchase, change from the first to the last one, and their share from there on."""
    out = windows.drift(table(spark, sf_dir, "events"), ["user_id"], ["ts"], "value", F.col("event_type") == "purchase")
    return out.select("user_id", "lag", "hits", F.round("drift", 4).alias("drift"), F.round("retention", 6).alias("retention"))


_EDGES = ((0, "0"), (15, "1-15"), (30, "16-30"), (60, "31-60"), (120, "61-120"), (180, "121-180"), (240, "181-240"))


@query(f"select bucket, count(*) as n from (select case {' '.join(f"when no <= {hi} then '{b}'" for hi, b in _EDGES)} else '241+' end as bucket from ({_N})) group by 1")
def lag_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).groupBy(windows.lag_bucket(F.col("no")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""with recursive d as (select user_id, event_id, ts::date as m, ts, ('0x' || substr(sha256('d:' || event_id::varchar), 1, 8))::bigint as h from events),
n as (select *, row_number() over (partition by user_id, m order by ts, event_id) as i, count(*) over (partition by user_id, m) as c from d),
w as (select *, ((i - 1) * 12) // c + 1 + h % ((i * 12) // c - ((i - 1) * 12) // c) as wish, case when h % 5 = 0 then 4 + h % 9 end as earliest from n),
f as (select *, greatest(wish, coalesce(earliest, 1)) as fl, 12 - (c - i) as cap from w),
s as (select user_id, m, 0::bigint as i, 0::bigint as event_id, 0::bigint as slot, false as shifted, false as tied from (select distinct user_id, m from d)
    union all select f.user_id, f.m, f.i, f.event_id, case when greatest(fl, slot + 1) <= cap then greatest(fl, slot + 1) else least(greatest(fl, slot), 12) end,
        case when greatest(fl, slot + 1) <= cap then greatest(fl, slot + 1) else least(greatest(fl, slot), 12) end <> wish,
        greatest(fl, slot + 1) > cap and least(greatest(fl, slot), 12) = slot from s join f on f.user_id = s.user_id and f.m = s.m and f.i = s.i + 1)
select event_id, slot, shifted, tied from s where i > 0""")
def increasing_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of a user's events of a day in 1..12: spread over the day, some not before a stated hour, in order, with ties where there is no room."""
    w = W.partitionBy("user_id", "m")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.to_date("ts").alias("m"))
    h = F.conv(F.substring(T.hash_pick("d", F.col("event_id")), 1, 8), 16, 10).cast("long")
    e = e.withColumns({"h": h, "n": F.row_number().over(w.orderBy("ts", "event_id")) - 1, "c": F.count(F.lit(1)).over(w)})
    e = e.withColumns({"wish": windows.spread_slot(F.col("n"), F.col("c"), 12, F.col("h")), "earliest": F.when(F.col("h") % 5 == 0, 4 + F.col("h") % 9)})
    out = windows.increasing_slots(e, ["user_id", "m"], ["ts", "event_id"], "wish", 12, "earliest", crowded=True)
    return out.select("event_id", F.col("slot").cast("long").alias("slot"), "shifted", "tied")


@query("select o_orderkey from (select o_orderkey, o_orderdate, o_custkey, lag(o_orderdate) over (partition by o_custkey order by o_orderkey) as b from orders) where datediff('day', b, o_orderdate) < 30")
def not_increasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that do not come 30 days after the customer's order before."""
    o = table(spark, sf_dir, "orders").withColumn("d", F.unix_date(F.to_date("o_orderdate")))
    return windows.not_increasing(o, ["o_custkey"], ["o_orderkey"], "d", 30).select("o_orderkey")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of a state: the path is their key modulo 7, the operation follows from kind and key."""
    k = F.get_json_object("props", "$.k").cast("int")
    kinds = {"signup": "create", "purchase": "update", "view": "set_pending", "error": "clear_pending"}
    op = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in kinds.items()], F.element_at(F.array(*map(F.lit, ("mark_stale", "archive", "needs_verification", "reactivate", "set_not_applicable"))), k % 5 + 1))
    return table(spark, sf_dir, "events").select(F.expr(_HIST), F.concat(F.lit("p"), (k % 7).cast("string")).alias("path"), op.alias("op"), F.col("value").cast("string").alias("value"), F.dayofmonth("ts").alias("month"), F.col("event_id").cast("int").alias("seq"), (k % 3).cast("string").alias("source"), "event_type")


_CELL = "struct_pack(value := {0}, status := {1}, confidence := {2}::double, valid_from := {3}::int, valid_until := {4}::int, last_confirmed_at := {5}::int, source := {6})"
_CELL_TYPE = "struct(value varchar, status varchar, confidence double, valid_from int, valid_until int, last_confirmed_at int, source varchar)[]"


def _cell(**new: str) -> str:
    """SQL of a cell: that of c with some fields new."""
    fields = ("value", "status", "confidence", "valid_from", "valid_until", "last_confirmed_at", "source")
    return _CELL.format(*(new.get(f, f"c.{f}") for f in fields))


_GONE, _PAST = _cell(status="'cancelled'", valid_until="month"), _cell(status="'historical'", valid_until="month")
_OWN, _OPEN = "c.status = 'pending' and c.source is not distinct from source", "c.status in ('current', 'needs_verification', 'stale', 'not_applicable', 'unknown')"
_NEW = lambda value, status, confidence: f"[{_CELL.format(value, status, confidence, 'month', 'null', 'null', 'source')}]"
_LAST = lambda cond: f"list_max(list_filter(range(1, len(cells) + 1), lambda k: {cond}))"
_FOLD_SQL = f"""with recursive e as (select user_id::varchar as entity, json_extract_string(props, '$.k')::int as k, event_type, value::varchar as value, day(ts)::int as month, event_id from events),
ch as (select entity, 'p' || (k % 7)::varchar as path, value, month, (k % 3)::varchar as source,
        case event_type when 'signup' then 'create' when 'purchase' then 'update' when 'view' then 'set_pending' when 'error' then 'clear_pending' else ['mark_stale', 'archive', 'needs_verification', 'reactivate', 'set_not_applicable'][k % 5 + 1] end as op,
        row_number() over (partition by entity, k % 7 order by month, event_id) as i from e),
f as (select distinct entity, path, 0::bigint as i, []::{_CELL_TYPE} as cells from ch
    union all
    select entity, path, i, list_transform(cells, lambda c, k: case
            when op in ('create', 'update') then case when k = own then {_cell(value="value", status="'current'", confidence="1", valid_from="month", valid_until="null", source="source")} when {_OWN} then {_GONE} when {_OPEN} then {_PAST} else c end
            when op = 'mark_stale' and k = at_ then {_cell(status="'stale'", confidence="least(c.confidence, 0.4)")}
            when op = 'archive' and k = at_ then {_PAST}
            when op = 'needs_verification' and k = at_ then {_cell(status="'needs_verification'", confidence="least(c.confidence, 0.6)")}
            when op = 'set_pending' then case when k = own then {_cell(value="value", valid_from="month")} when c.status = 'pending' and c.source is distinct from source then {_GONE} else c end
            when op = 'clear_pending' then case when {_OWN} then {_GONE} when c.status = 'needs_verification' and c.source is not distinct from source then {_cell(status="'current'", confidence="1")} else c end
            when op = 'reactivate' and past is not null then case when k = past then {_cell(status="'current'", valid_from="month", valid_until="null")} when {_OPEN} then {_PAST} else c end
            when op = 'set_not_applicable' then case when {_OWN} then {_GONE} when {_OPEN} then {_PAST} else c end
            else c end) || case when op in ('create', 'update') and own is null then {_NEW('value', "'current'", 1)} when op = 'needs_verification' and at_ is null then {_NEW('null::varchar', "'needs_verification'", 0.3)}
            when op = 'set_pending' and own is null then {_NEW('value', "'pending'", 0.5)} when op = 'set_not_applicable' then {_NEW('null::varchar', "'not_applicable'", 1)} else []::{_CELL_TYPE} end as cells
    from (select ch.*, f.cells, {_LAST("f.cells[k].status = 'pending' and f.cells[k].source is not distinct from ch.source")} as own,
            {_LAST("f.cells[k].status not in ('pending', 'cancelled', 'historical')")} as at_, {_LAST("f.cells[k].status = 'historical'")} as past
        from f join ch on f.entity = ch.entity and f.path = ch.path and ch.i = f.i + 1)),
done as (select entity, path, max_by(cells, i) as cells from f group by 1, 2),
cell as (select entity, path, (k - 1)::int as seq, cells[k] as c from (select *, unnest(range(1, len(cells) + 1)) as k from done))"""


@query(f"{_FOLD_SQL} select entity, path, seq, c.value as value, c.status as status, c.confidence as confidence, c.valid_from as valid_from, c.valid_until as valid_until, c.last_confirmed_at as last_confirmed_at, c.source as source from cell")
def memory_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions of all cells after folding every change."""
    return memory.fold(_changes(spark, sf_dir)).drop("evidence", "provenance")


@query(f"""{_FOLD_SQL}, g as (select entity, path, max_by(c, seq) filter (where c.status not in ('pending', 'cancelled', 'historical')) as a, max_by(c, seq) filter (where c.status not in ('pending', 'cancelled')) as b,
list_sort(coalesce(list(c.value) filter (where c.status = 'pending' and c.value is not null), [])) as p, list(c.value order by seq) filter (where c.status = 'historical' and c.value is not null) as h, count_if(c.status = 'historical')::bigint as n_historical from cell group by 1, 2)
select entity, path, case when coalesce(a, b).status not in ('not_applicable', 'unknown') then coalesce(a, b).value end as value, coalesce(a, b).status as status, coalesce(a, b).source as source, array_to_string(p, ',') as pending, n_historical, coalesce(array_to_string(h, ','), '') as historical_values from g""")
def memory_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counts of every path, with what counted before and live proposals."""
    out = memory.serialized(memory.fold(_changes(spark, sf_dir)))
    return out.select("entity", "path", "value", "status", "source", F.array_join("pending", ",").alias("pending"), "n_historical", F.array_join("historical_values", ",").alias("historical_values"))


@query()
def memory_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change with the value it replaces and whether it changes anything."""
    return memory.applied(_changes(spark, sf_dir))


@query("""select user_id, event_id, row_number() over w as version, lead(event_id) over w as until from events where event_type = 'purchase' window w as (partition by user_id order by event_id)""")
def update_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain updates as intervals of validity."""
    return memory.update_intervals(table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", "event_id"), ["user_id"], ["event_id"])


_OK = " or ".join(f"(status = '{s}' and op in ({', '.join(repr(o) for o in ops)}))" for s, ops in memory.ALLOWED.items())
_OPS = """select event_id, case event_type when 'purchase' then 'occurred' when 'view' then 'weak_signal' when 'error' then 'cancelled' else event_type end as status,
case event_id % 3 when 0 then 'update' when 1 then 'set_pending' else 'no_update' end as op from events"""


@query(f"select event_id, status, op from ({_OPS}) where not ({_OK})")
def forbidden_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in {"purchase": "occurred", "view": "weak_signal", "error": "cancelled"}.items()], F.col("event_type"))
    op = F.element_at(F.array(F.lit("update"), F.lit("set_pending"), F.lit("no_update")), (F.col("event_id") % 3 + 1).cast("int"))
    return memory.forbidden_operations(e.select("event_id", status.alias("status"), op.alias("op")))


@query("select user_id, event_type, min(event_id) as event_id, len(list_distinct(list(day(ts))))::bigint as n_evidence from events group by 1, 2")
def dedupe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the replays of each change, with the evidence of all."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.array(F.dayofmonth("ts")).alias("evidence"))
    out = memory.dedupe_replay(e, ["user_id", "event_type"], ["event_id"], "evidence")
    return out.select("user_id", "event_type", "event_id", F.size("evidence").cast("long").alias("n_evidence"))


@query()
def ledger_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's ledger of even days against that of odd days, month by month."""
    e = table(spark, sf_dir, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM")).alias("item"), F.when(F.dayofmonth("ts") % 2 == 0, "gold").otherwise("pred").alias("side"), F.col("event_id").cast("int").alias("ord"), F.col("event_type").alias("event"), F.dayofmonth("ts").alias("anchor"), F.array("props").alias("evidence"))
    return align.align_ledgers(e)


@query()
def hallucination_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and errors as unmatched predictions at the days of a user's events."""
    e = table(spark, sf_dir, "events").select(F.expr(_HIST), F.col("event_type").alias("event"), F.dayofmonth("ts").alias("checkpoint"), F.col("event_id").alias("ord"), F.get_json_object("props", "$.k").cast("int").alias("anchor"))
    return align.hallucination_chains(e.filter("event in ('click', 'error')"), e.select("entity", "checkpoint"))


@query("""with m as (select o_custkey, o_orderkey, (year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 as month from orders), s as (select *, max(month) over (partition by o_custkey) as span from m),
t as (select *, case when span >= 60 then floor(month * 58 / span) else month end::bigint as month_scaled from s) select o_custkey, o_orderkey, month_scaled from t where month_scaled between 0 and 59""")
def compress_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (dates.month_ordinal(F.col("o_orderdate")) - 1992 * 12).alias("month"))
    return simulate.compress_timeline(o, "o_custkey", "month", 60).select("o_custkey", "o_orderkey", F.col("month_scaled").cast("long").alias("month_scaled"))


@query("select p_partkey, round(least(greatest(p_retailprice / 200 / 12, 0.0), 0.5), 9) as hazard from part")
def monthly_hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(simulate.monthly_hazard(F.col("p_retailprice") / 200), 9).alias("hazard"))


@query("""select o_orderkey, year(o_orderdate) * 12 + month(o_orderdate) - 1 as ordinal, make_date(year(o_orderdate), month(o_orderdate), 1)::varchar as first_day,
(year(o_orderdate)::varchar || '년 ' || month(o_orderdate)::varchar || '월 ' || day(o_orderdate)::varchar || '일') as shown, (30 + floor((o_orderkey % 40) / 12))::bigint as age from orders""")
def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month ordinals and back, dates in Korean, ages after some months."""
    d = F.col("o_orderdate")
    m = dates.month_ordinal(d)
    return table(spark, sf_dir, "orders").select("o_orderkey", m.alias("ordinal"), dates.month_start(m).cast("string").alias("first_day"), dates.korean_date(d).alias("shown"), dates.age_at(F.lit(30), F.col("o_orderkey") % 40).cast("long").alias("age"))


@query("select date_diff('second', timestamp '1970-01-01', time_bucket(interval 1 day, ts, timestamp '1970-01-01'))::bigint as start, event_type, count(*) as n, sum((value * 100)::decimal(18,0))::bigint as cents from events group by 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals by kind of event, read and kept up to date as a stream."""
    source = streams.source(sf_dir, "events.parquet")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum((F.col("value") * 100).cast("decimal(18,0)").cast("long")).alias("cents")]
    make = lambda s: streams.tumbling(streams.with_event_time(s), "1 day", ["event_type"], aggs)
    at = streams.scratch(spark)
    out = streams.totals_available(spark, make, source, spark.read.parquet(source).schema, f"{at}/out", f"{at}/state")
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "n", "cents")


@query("""with l as (select *, lag(ts) over (partition by user_id order by ts) as b from events), s as (select *, sum(case when b is null or ts >= b + interval 6 hour then 1 else 0 end) over (partition by user_id order by ts) as k from l)
select user_id, count(*) as n, min(event_id) as first_id from s group by user_id, k""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user's events that end after six hours without one."""
    aggs = [F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id")]
    return streams.sessions(table(spark, sf_dir, "events"), "6 hours", ["user_id"], aggs).select("user_id", "n", "first_id")


@query("select event_id, user_id from events")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a stream, a replayed id within the watermark once."""
    source, at = streams.source(sf_dir, "events.parquet"), streams.scratch(spark)
    make = lambda s: streams.deduplicated(streams.with_event_time(s), ["event_id"]).select("event_id", "user_id")
    streams.write_available(spark, make, source, spark.read.parquet(source).schema, f"{at}/out", f"{at}/state")
    return spark.read.schema("event_id long, user_id long").parquet(f"{at}/out")


@query(f"{_FOLD_SQL} select entity, path, seq, c.value as value, c.status as status, c.valid_from as valid_from, c.valid_until as valid_until from cell")
def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of all changes as a stream with its state, in two runs: the second goes on from the state of the first."""
    changes, at = _changes(spark, sf_dir).drop("event_type"), streams.scratch(spark)
    for half in ("month <= 15", "month > 15"):
        changes.filter(half).write.mode("append").parquet(f"{at}/in")
        out = state.fold_available(spark, f"{at}/in", changes.schema, f"{at}/out", f"{at}/state")
    return out.select("entity", "path", "seq", "value", "status", "valid_from", "valid_until")
