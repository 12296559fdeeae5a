"""The registered queries of the numbered operators, with their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm import importance, minhash, mixing, ngrams, pieces, pii, prefixes, quality, sstable, substring, suffix, topk, warc
from tidemark.llm._common import lean_batches

#: The mixture: integer weights by name at each level; a name that is not listed weighs 1.
MIX_WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 6, "de": 2, "fr": 2}, "source": {"src0": 4}}
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 80, 4, 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain_of(source: Column) -> Column:
    """The domain of a source by its number modulo 3: web, books, code."""
    n = F.pmod(F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)', 1) as int)"), F.lit(0)), F.lit(3))
    return F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("code")), n + 1)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, domain_of(F.col("source")), MIX_WEIGHTS, F.expr(f"total * {MIX_PERCENT} div 100"), MIX_EPOCHS, MIX_SEED)


def _water(level: int) -> str:
    """SQL of one level: the children n{level} share what their parents p have."""
    keys = ["domain", "lang", "source"]
    up, name = keys[: level - 1], keys[level - 1]
    part = f"partition by {', '.join(up)}" if up else ""
    order = f"{part} order by w <= 0, cap / nullif(w, 0)::double, {name}"
    join = f"join a{level - 1} using ({', '.join(up)})" if up else "cross join a0"
    return f"""
    c{level} as (select {', '.join(keys[:level])}, cap, n{level}.tokens, w, share from n{level} {join}),
    f{level} as (select *, w > 0 and cap * (sum(w) over ({part}) - coalesce(sum(w) over ({order} rows between unbounded preceding and 1 preceding), 0))
        <= w * (share - coalesce(sum(cap) over ({order} rows between unbounded preceding and 1 preceding), 0)) as is_full from c{level}),
    o{level} as (select *, sum(case when is_full then 0 else w end) over ({part}) as w_open,
        share - sum(case when is_full then cap else 0 end) over ({part}) as rest,
        sum(case when is_full then 0 else w end) over ({order} rows between unbounded preceding and current row) as w_to from f{level}),
    a{level} as (select {', '.join(keys[:level])}, tokens, (case when is_full then cap when w > 0 then (w_to * rest) // w_open - ((w_to - w) * rest) // w_open else 0 end)::bigint as share from o{level})"""


def _case(level: str) -> str:
    return f"case {level} " + " ".join(f"when '{k}' then {v}" for k, v in MIX_WEIGHTS[level].items()) + " else 1 end"


OP1_SQL = f"""
with t as (select doc_id, ['web', 'books', 'code'][(coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)', 1) as int), 0) % 3) + 1] as domain,
        coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as tokens from documents),
    l as (select domain, lang, source, sum(tokens)::bigint as tokens from t group by all),
    n3 as (select domain, lang, source, tokens, {_case('source')} as w, tokens * {MIX_EPOCHS} as cap from l),
    n2 as (select domain, lang, sum(tokens)::bigint as tokens, {_case('lang')} as w, sum(cap)::bigint as cap from n3 group by domain, lang),
    n1 as (select domain, sum(tokens)::bigint as tokens, {_case('domain')} as w, sum(cap)::bigint as cap from n2 group by domain),
    a0 as (select least((sum(tokens) * {MIX_PERCENT}) // 100, sum(cap))::bigint as share from n1),
    {_water(1)}, {_water(2)}, {_water(3)},
    p as (select domain, lang, source, coalesce(share // nullif(tokens, 0), 0) as "full", coalesce(share % nullif(tokens, 0), 0) as rest from a3),
    d as (select t.*, p."full", p.rest, md5(concat_ws(':', '{MIX_SEED}', p."full"::varchar, doc_id::varchar)) as hx from t join p using (domain, lang, source))
select doc_id, domain, lang, source, tokens, "full", greatest(0, least(tokens, rest - coalesce(sum(tokens) over (partition by domain, lang, source order by hx, doc_id, tokens rows between unbounded preceding and 1 preceding), 0)))::bigint as part from d
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_earlier(table(spark, sf_dir, "documents")).drop("kept")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_best_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the vocabulary as a unigram model: the Viterbi fold instead of merges."""
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), best_path=True)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


#: Base32 of a SHA-1 in hex: five hex digits are four letters.
OP7_SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
    d as (select page_id, strlen(body)::bigint as payload_bytes, sha1(body) as h, max(page_id) over (partition by sha1(body)) as last from p)
select page_id, payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::bigint >> (15 - 5 * (i % 4))::bigint) % 32 + 1)::bigint, 1)), '') as payload_digest,
    case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id <> last then last end as refers_to from d
"""


def op8_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return topk.top_k(rows, rows.filter("id % 20 = 0"), 20)


OP10_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
        where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::bigint as score
        from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20
"""


def op11_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(table(spark, sf_dir, "conversations"))


#: crc32 of a list of bytes, a step for each bit in the table of 256 and one for each byte.
CRC_TABLE = "select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, x: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc"
CRC = "xor(list_reduce(list_prepend(4294967295, {bytes}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"

OP11_SQL = f"""
with k as ({CRC_TABLE}),
    t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
            row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) as p from conversations where conv_id is not null),
    n as (select conv_id, count(*) as n, conv_id - conv_id % 20 as head from t group by conv_id),
    c as (select n.*, least(h, coalesce(m.n, 0)) as got, h from (select n.*, {CRC.format(bytes="list_transform(string_split(conv_id::varchar, ''), lambda x: unicode(x)::bigint)")} % 4 as h from n, k) n
            left join (select conv_id, n from n) m on m.conv_id = n.head),
    r as (select c.conv_id, p as d, role, text from c join t on t.conv_id = c.head and p <= h
        union all select c.conv_id, p - h + got, role, text from c join t on t.conv_id = c.conv_id and p > h),
    s as (select conv_id, d, text, md5(string_agg(md5(strlen(role)::varchar || ':' || role || text), '' order by d) over w) as node, d = max(d) over (partition by conv_id) as ends
        from r window w as (partition by conv_id order by d rows between unbounded preceding and current row)),
    x as (select conv_id, d, text, node, lag(node, 1, '') over (partition by conv_id order by d) as up, ends from s
        union all select conv_id, 0, '', '', null, conv_id not in (select conv_id from r) from c),
    v as (select node, d, up, min(conv_id) as conv_id, count(*) as n_convs, coalesce(len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')), 0) as words,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256 from x group by node, d, up),
    kids as (select up as node, count(*) as n_children from v where d > 0 group by up),
    a as (select x.node, count(*) filter (kids.node is null) as n_leaves, sum((n_convs - 1) * words) as saved
        from v left join kids using (node) join x on x.conv_id = v.conv_id and x.d <= v.d group by x.node)
select v.conv_id, v.d::bigint as depth, p.conv_id as parent_conv_id, v.n_convs::bigint as n_convs, coalesce(n_children, 0)::bigint as n_children,
    n_leaves::bigint as n_leaves, saved::bigint as saved_tokens, v.ends_sha256 from v left join kids using (node) join a using (node) left join v p on p.node = v.up
"""


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, seed=42)


def op12_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score_documents(table(spark, sf_dir, "documents"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_UTF8 = """flatten(list_transform(string_split(f, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint]
    when unicode(x) < 2048 then [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)]
    when unicode(x) < 65536 then [224 + (unicode(x) >> 12), 128 + ((unicode(x) >> 6) & 63), 128 + (unicode(x) & 63)]
    else [240 + (unicode(x) >> 18), 128 + ((unicode(x) >> 12) & 63), 128 + ((unicode(x) >> 6) & 63), 128 + (unicode(x) & 63)] end))"""

OP13_SQL = f"""
with k as ({CRC_TABLE}),
    w as materialized (select row_number() over () as r, src, doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
        from (select 's' as src, doc_id, text from documents union all select 't', null, text from benchmark)),
    f as materialized (select r, src, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as f from w),
    n as materialized (select r, src, f, count(*) as n from f group by all),
    b as materialized (select f, {CRC.format(bytes=_UTF8)} % 10000 as bucket from (select distinct f from n), k),
    g as (select bucket, floor(1000 * ln(((coalesce(sum(n) filter (src = 't'), 0) + 1)::double * ((select coalesce(sum(n), 0) from n where src = 's') + 10000)::double)
        / ((coalesce(sum(n) filter (src = 's'), 0) + 1)::double * ((select coalesce(sum(n), 0) from n where src = 't') + 10000)::double)))::bigint as gain from n join b using (f) group by bucket),
    d as (select r, sum(n * gain) as weight from n join b using (f) join g using (bucket) where src = 's' group by r),
    s as (select doc_id, len(w) as n_words, (len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0))::bigint as n_features, coalesce(weight, 0)::bigint as weight,
        coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score from w left join d using (r) where src = 's'),
    q as (select *, row_number() over (order by n_words < 20, score desc, doc_id nulls last, n_features) as place, (5 * count(*) filter (n_words >= 20) over ()) // 100 as draw from s)
select doc_id, n_features, weight, score, case when place <= draw then place end::bigint as rank from q
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mixing": op1_mixing, "op2_quality": op2_quality, "op3_substring": op3_substring, "op4_suffix": op4_suffix, "op5_pieces": op5_pieces, "op5_best_paths": op5_best_paths, "op6_minhash": op6_minhash, "op7_warc": op7_warc, "op8_sstable": op8_sstable, "op9_pii": op9_pii, "op10_topk": op10_topk, "op11_prefixes": op11_prefixes, "op12_ngrams": op12_ngrams, "op13_importance": op13_importance}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op7_warc": OP7_SQL, "op10_topk": OP10_SQL, "op11_prefixes": OP11_SQL, "op13_importance": OP13_SQL}
