"""Queries of text expressions and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import dates, text as T
from tidemark.operators import joins, retrieval
from tidemark.plans._base import query, table
from tidemark.sources import files
from tidemark.streaming.events import scratch

_NORMAL = "trim(regexp_replace(regexp_replace(lower(text), '[^0-9a-zA-Z가-힣 ]', ' ', 'g'), ' +', ' ', 'g'))"
_TOKENS = "regexp_extract_all(lower(text), '[가-힣]+|[a-z]+|[0-9]+(?:[.,][0-9]+)*')"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role = 'user'")


@query(f"select conv_id, turn, {_NORMAL} as clean, len({_TOKENS})::bigint as n_tokens, ceil(length(text) / 2.5)::bigint as estimate from conversations where role = 'user'")
def normal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form, token count and size estimate of user turns."""
    return _texts(spark, sf_dir).select("conv_id", "turn", T.normalized(F.col("text")).alias("clean"), F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"), T.token_estimate(F.col("text")).cast("long").alias("estimate"))


@query(f"""with w as (select conv_id, turn, string_split({_NORMAL}, ' ') as w from conversations where role = 'user')
select conv_id, turn, case when len(w) < 3 then 0 else len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) end::bigint as n_shingles from w""")
def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("conv_id", "turn", F.size(T.shingles(T.words(F.col("text")))).cast("long").alias("n_shingles"))


@query("""select conv_id, turn, (length(regexp_replace(text, '\\s+', '', 'g')) >= 12 or len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) >= 5) as substantive,
trim(regexp_replace(lower(text), '[^0-9a-z]+', '_', 'g'), '_') as slug from conversations""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_substantive(F.col("text")).alias("substantive"), T.slug(F.col("text")).alias("slug"))


_PHRASES = ("the", "there", "ent", "lement", "tion", "qui")


@query("select conv_id, turn, case " + " ".join(f"when contains(text, '{p}') then '{p}'" for p in sorted(_PHRASES, key=len, reverse=True)) + " end as phrase from conversations")
def longest_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.longest_phrase(F.col("text"), _PHRASES).alias("phrase"))


@query("""select event_id, case event_id % 3 when 0 then json_extract_string(props, '$.k') when 1 then json_extract_string(props, '$.k') end as k, case when event_id % 2 = 0 then event_type end as answer from events""")
def tolerant_parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects inside fences or prose, and the last answer tag."""
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("It is "), "props", F.lit(" I think"))).otherwise(F.lit("none"))
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("<answer>no</answer> or <answer> "), "event_type", F.lit(" </answer>"))).otherwise(F.lit("no tag"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(T.json_object(raw), "$.k").alias("k"), T.answer_tag(said).alias("answer"))


@query("select o_orderkey, (o_orderkey % 9000 + 1) * 10000 as amount, greatest(o_orderkey % 28 + 1, 3)::int as day from orders")
def amounts_and_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts and days named in Korean text."""
    n, day = F.col("o_orderkey") % 9000 + 1, F.col("o_orderkey") % 28 + 1
    return table(spark, sf_dir, "orders").select("o_orderkey", T.won(F.concat(F.lit("약 "), n.cast("string"), F.lit("만원 정도"))).alias("amount"), dates.referenced_day(F.concat(F.lit("3일과 "), day.cast("string"), F.lit("일에"))).alias("day"))


@query("select doc_id, array_to_string(list_filter(regexp_split_to_array(nfc_normalize(text), '\\s+'), lambda w: w <> ''), ' ') as clean from documents")
def nfkc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unicode normal form with white space squeezed; these texts have no compatibility characters."""
    return table(spark, sf_dir, "documents").select("doc_id", T.nfkc(F.col("text")).alias("clean"))


_SEQUENCES = """with recursive s as (select user_id, strftime(ts, '%Y-%m') as month, list(event_type order by ts, event_id) as s from events group by 1, 2),
h as (select user_id, month, s[1:((len(s) + 1) // 2)::int] as a, s[((len(s) + 1) // 2 + 1)::int:] as b from s),
r as (select user_id, month, 0 as i, list_transform(b, lambda x: 0) as row from h
    union all select user_id, month, i + 1, list_transform(range(1, len(b) + 1), lambda k: list_max(cand[1:k])) from (
        select r.user_id, r.month, r.i, h.b, list_transform(range(1, len(h.b) + 1), lambda j: case when h.b[j] = h.a[r.i + 1] then coalesce(r.row[j - 1], 0) + 1 else r.row[j] end) as cand
        from r join h on h.user_id = r.user_id and h.month = r.month where r.i < len(h.a)))"""


@query(f"""{_SEQUENCES}, e as (select user_id, month, coalesce(list_max(max_by(row, i)), 0)::int as lcs from r group by 1, 2)
select user_id, month, lcs, levenshtein(array_to_string(list_transform(a, lambda x: x[1]), ''), array_to_string(list_transform(b, lambda x: x[1]), ''))::int as distance from h join e using (user_id, month)""")
def sequence_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest common subsequence and edit distance of the first and second half of a user's kinds of event, month by month."""
    month = F.date_format("ts", "yyyy-MM").alias("month")
    e = table(spark, sf_dir, "events").groupBy("user_id", month).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("s"))
    half = F.ceil(F.size("s") / 2).cast("int")
    a, b = F.slice("s", F.lit(1), half), F.slice("s", half + 1, F.size("s") - half)
    return e.select("user_id", "month", T.sequence_lcs(a, b).alias("lcs"), T.sequence_distance(a, b).alias("distance"))


_BM = """d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[가-힣]+|[a-z]+|[0-9]+(?:[.,][0-9]+)*') as t from documents), st as (select count(*) as nd, avg(len(t)) as al from d),
q as (select item_id, tok, count(*) as qtf from (select item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[가-힣]+|[a-z]+|[0-9]+(?:[.,][0-9]+)*')) as tok from benchmark) group by all),
p as (select doc_id, len(t) as dl, tok, count(*) as tf from (select doc_id, t, unnest(t) as tok from d) group by all), f as (select tok, count(*) as df from p group by 1),
s as (select item_id, doc_id, sum(qtf * ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / al)))::double as score from q join p using (tok) join f using (tok), st group by 1, 2)"""


@query(f"with {_BM} select item_id, doc_id, rank::bigint as rank from (select *, row_number() over (partition by item_id order by round(score, 6) desc, doc_id) as rank from s) where rank <= 5")
def bm25_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents with the best BM25 score for each benchmark passage."""
    scores = retrieval.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text", most=5)
    return retrieval.ranked(scores, "item_id", "doc_id", 5).select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(f"""with {_BM}, g as (select item_id % 10 as g, doc_id, max(round(score, 6)) as score from s group by 1, 2), t as (select *, row_number() over (partition by g order by score desc, doc_id) as r from g)
select g, doc_id, row_number() over (partition by g order by doc_id) as place from t where r <= 20""")
def fused_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages in ten groups: the best score of a document in its group, twenty documents each, in document order."""
    scores = retrieval.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text")
    out = retrieval.fuse(scores.select((F.col("item_id") % 10).alias("g"), "doc_id", F.round("score", 6).alias("score")), ["g"], "doc_id", 20)
    return out.select("g", "doc_id", F.col("place").cast("long").alias("place"))


@query("""with q as (select vec_id, embedding as e from embeddings where vec_id % 100 = 0) select q.vec_id as query_id, x.vec_id, round(list_dot_product(q.e::double[], x.embedding::double[]) / (sqrt(list_dot_product(q.e::double[], q.e::double[])) * sqrt(list_dot_product(x.embedding::double[], x.embedding::double[]))), 6) as cosine from q, embeddings x""")
def cosine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cosine with each query vector, those whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = retrieval.cosine_search(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding")
    return out.withColumn("cosine", F.round("cosine", 6))


@query(f"select item_id, ('0x' || substr(sha256(tok), 1, 8))::bigint % 64 as bucket, count(*) as n from (select item_id, unnest({_TOKENS}) as tok from benchmark) group by 1, 2")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hash_embedding(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(f"""with c as (select doc_id, nullif({_NORMAL}, '') as t from documents) select doc_id, coalesce(min(doc_id) over (partition by t), doc_id) as class_id from c where t is not null union all select doc_id, doc_id from c where t is null""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by equal normalised text: each with the smallest id of its class."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.normalized(F.col("text")).alias("t"))
    return joins.set_classes(d.withColumn("s", F.when(F.length("t") > 0, F.array("t")).otherwise(F.expr("cast(array() as array<string>)"))), "doc_id", "s")


@query("select r_regionkey, r_name from region")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON Lines written and read back strictly."""
    path = f"{scratch(spark)}/regions.jsonl"
    files.write_jsonl(table(spark, sf_dir, "region"), path)
    return files.read_jsonl(spark, path, "r_regionkey int, r_name string")


@query("select n_nationkey, n_name, n_regionkey from nation")
def four_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written in several formats and read as one table."""
    root, n = scratch(spark), table(spark, sf_dir, "nation")
    n.filter("n_nationkey < 8").write.parquet(f"{root}/a")
    n.filter("n_nationkey between 8 and 15").write.option("header", True).csv(f"{root}/b")
    n.filter("n_nationkey > 15").withColumn("k", F.col("n_nationkey")).write.partitionBy("k").json(f"{root}/c")  # one object a file
    return files.read_any(spark, root, n.schema)


@query("""with h as (select sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey::varchar || ',"n_regionkey":' || n_regionkey::varchar || '}') as h from nation)
select count(*) as rows, sum(('0x' || substr(h, 1, 15))::bigint)::varchar || ':' || sum(('0x' || substr(h, 16, 15))::bigint)::varchar as digest from h""")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written with a manifest of row count and digest."""
    return files.write_with_manifest(table(spark, sf_dir, "nation"), f"{scratch(spark)}/nation", {"made_by": "plan"}).select("rows", "digest")
