"""Every registered query of the engine against its SQL, and plain checks of those without."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import align, joins, memory, retrieval
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 5) if isinstance(v, float) else v if isinstance(v, (int, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    out = duck.execute(SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    assert sorted(repr([plain(v) for v in r]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in out.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_fold_against_replay(spark):
    """The SQL of the query is an independent fold; here the same rows go through the operations one by one, without Spark."""
    changes = QUERIES["memory_fold"].__globals__["_changes"](spark, SF)
    got = {}
    for r in memory.fold(changes).collect():
        got.setdefault((r["entity"], r["path"]), []).append((r["seq"], r["value"], r["status"], r["valid_until"]))
    want = {}
    for r in sorted(changes.collect(), key=lambda r: (r["month"], r["seq"])):
        key = (r["entity"], r["path"])
        want[key] = memory.apply_change(want.get(key, []), r["op"], r["value"], r["month"], r["source"])
    assert {k: sorted(v) for k, v in got.items()} == {k: [(i, c.value, c.status, c.valid_until) for i, c in enumerate(v)] for k, v in want.items() if v}


def test_operations():
    cells = memory.apply_change([], "create", "a", 1, "s1")
    cells = memory.apply_change(cells, "set_pending", "b", 2, "s2")
    assert [c.status for c in cells] == ["current", "pending"]
    assert [c.status for c in memory.apply_change(cells, "clear_pending", None, 3, "s2")] == ["current", "cancelled"]
    done = memory.apply_change(cells, "update", "b", 3, "s2")
    assert [(c.value, c.status) for c in done] == [("a", "historical"), ("b", "current")]
    assert memory.apply_change(done, "reactivate", None, 4, "s3")[0].status == "current"
    with pytest.raises(ValueError):
        memory.apply_change([], "erase", None, 1, None)


def test_alignment_is_best():
    rnd = random.Random(8)
    for _ in range(60):
        make = lambda: [(rnd.choice("ab"), rnd.randint(0, 5), frozenset(rnd.sample("xyz", 2))) for _ in range(rnd.randint(0, 4))]
        gold, pred = make(), make()

        def best(i, j):
            if i == len(gold) or j == len(pred):
                return (0, 0, 0)
            out = max(best(i + 1, j), best(i, j + 1))
            if gold[i][0] == pred[j][0]:
                a, b, c = best(i + 1, j + 1)
                out = max(out, (a + 1, b - abs(gold[i][1] - pred[j][1]), c + len(gold[i][2] & pred[j][2])))
            return out

        pairs = align.align_lists(gold, pred)
        score = (len(pairs), -sum(abs(gold[a][1] - pred[b][1]) for a, b in pairs), sum(len(gold[a][2] & pred[b][2]) for a, b in pairs))
        assert score == best(0, 0) and pairs == sorted(pairs)


def test_ledgers_have_all_events(spark):
    """Every event is in the alignment once, and a user's month has as many pairs as the plain longest common subsequence."""
    got = QUERIES["ledger_alignment"](spark, SF).collect()
    sides, pairs = {}, {}
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id", "event_type", "concat(user_id, ':', date_format(ts, 'yyyy-MM')) as item", "day(ts) % 2 as odd")
    for r in events.orderBy("event_id").collect():
        sides.setdefault(r["item"], ([], []))[r["odd"]].append((r["event_id"], r["event_type"]))
    for k, part in ((0, "gold_ord"), (1, "pred_ord")):
        assert sorted((r["item"], r[part]) for r in got if r[part] is not None) == sorted((item, i) for item, s in sides.items() for i, _ in s[k])
    for r in got:
        pairs[r["item"]] = pairs.get(r["item"], 0) + (r["distance"] is not None)
    assert pairs == {item: T.lcs_length([x for _, x in a], [x for _, x in b]) for item, (a, b) in sides.items()}


def test_sequences_are_whole(spark):
    """All of a user's month is compared, and no event with itself."""
    kinds = {}
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id", "date_format(ts, 'yyyy-MM') as month", "event_type", "ts", "event_id")
    for r in events.orderBy("ts", "event_id").collect():
        kinds.setdefault((r["user_id"], r["month"]), []).append(r["event_type"])
    want = {k: (s[: (len(s) + 1) // 2], s[(len(s) + 1) // 2 :]) for k, s in kinds.items()}
    got = {(r["user_id"], r["month"]): (r["lcs"], r["distance"]) for r in QUERIES["sequence_distances"](spark, SF).collect()}
    assert got == {k: (T.lcs_length(a, b), T.edit_distance(a, b)) for k, (a, b) in want.items()}


def test_join_errors(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    twice = a.union(a)
    with pytest.raises(joins.JoinError):
        joins.validated_one_to_one(a, twice, ["k"])
    with pytest.raises(joins.JoinError):
        joins.validated_one_to_one(a, a.filter("k = 1"), ["k"])
    with pytest.raises(joins.JoinError):
        joins.merge_upsert(a.filter("k = 1"), a, ["k"])


def test_quota_shortage(spark):
    from tidemark.operators import sets

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, band string")
    assert sets.quota_sample(df, "band", {"a": 2, "b": 1}, "s", "k", strict=True).count() == 3
    with pytest.raises(ValueError, match="too few"):
        sets.quota_sample(df, "band", {"a": 2, "b": 2}, "s", "k", strict=True)


def test_pinned_documents(spark):
    from tidemark.operators import retrieval

    g = spark.createDataFrame([(1, d, float(d)) for d in range(9)], "q int, d int, score double")
    got = retrieval.fuse(g, ["q"], "d", 3, spark.createDataFrame([(1, 0)], "q int, d int")).orderBy("place").collect()
    assert [r["d"] for r in got] == [0, 7, 8]


def test_canonical_json(spark):
    """Fields and map keys come in name order at all depths."""
    from tidemark.sources import files

    df = spark.sql("select named_struct('z', 1, 'a', array(named_struct('y', null, 'b', 2))) as s, map('q', 1, 'c', 2) as m, 5 as k")
    assert df.select(files.canonical_json(df)).first()[0] == '{"k":5,"m":{"c":2,"q":1},"s":{"a":[{"b":2,"y":null}],"z":1}}'


def test_bad_records_raise(spark, tmp_path):
    from tidemark.sources import files

    (tmp_path / "a.jsonl").write_text('{"k": 1}\n{"k": \n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "k int").collect()
    (tmp_path / "r.json").write_text('[{"k": 1, "other": 2}]')
    with pytest.raises(ValueError, match="not a registry"):
        files.registry(spark, str(tmp_path / "r.json"), "k int, v string")
    with pytest.raises(FileNotFoundError):
        files.read_any(spark, str(tmp_path / "a.jsonl"), spark.createDataFrame([], "k int").schema, formats=("parquet",))


def test_failed_manifest(spark, tmp_path):
    """A table that cannot be written leaves a manifest that says so, and the old table."""
    from pyspark.sql import functions as F

    from tidemark.sources import files

    path, good = str(tmp_path / "t"), spark.range(3)
    assert files.write_with_manifest(good, path, {"by": "test"}).first()["status"] == "COMPLETE"
    with pytest.raises(Exception, match="stop"):
        files.write_with_manifest(good.select(F.raise_error(F.lit("stop")).alias("id")), path, {"by": "test"})
    assert spark.read.json(f"{path}.manifest").first()["status"] == "FAILED" and spark.read.parquet(path).count() == 3


def test_similar_sets_of_copies(spark, tmp_path):
    """Users of equal sets, clicks without a key and clicks without a user: the rows are those of the SQL."""
    rows = [(u, f'{{"k": {u % 7 + j}}}') for u in range(40) for j in range(4)] + [(None, f'{{"k": {j}}}') for j in range(3)]
    rows += [(u, p) for u in range(0, 50, 5) for p in ("{}", None, '{"k": null}')]
    spark.createDataFrame([(u, "click", p) for u, p in rows], "user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"select a, b, shared, size_a, size_b from ({SQL['similar_sets']})").fetchall()
    got = QUERIES["similar_sets"](spark, str(tmp_path)).select("a", "b", "shared", "size_a", "size_b").collect()
    assert sorted(map(tuple, got)) == sorted(want) and {w[2:] for w in want} >= {(4, 4, 4), (4, 5, 5)}


def test_sequences():
    assert T.lcs_length("abcbdab", "bdcaba") == 4 and T.edit_distance("kitten", "sitting") == 3 and T.edit_distance((), "ab") == 2


def test_cosines_by_blocks(spark):
    """Pairs of blocks give what the expression gives, bit by bit: other lengths, nulls and holes have no cosine."""
    rows = [(i, [float(i % 7), 0.1 * i, -1.5]) for i in range(25)] + [(30, None), (31, [1.0, None, 2.0]), (32, [1.0]), (33, []), (34, [0.0, 0.0, 0.0]), (35, [])]
    e = spark.createDataFrame(rows, "id int, v array<double>")
    q = e.filter("id % 5 = 0 or id > 29")
    want = q.selectExpr("id as query_id", "v as q").crossJoin(e).select("query_id", "id", retrieval.cosine(F.col("q"), F.col("v")).alias("c"))
    norm = lambda df: sorted(map(repr, map(tuple, df.collect())))
    for block in (4, 1_000):
        got = retrieval.cosine_search(e, q, "id", "v", block)
        assert norm(got) == norm(want) and got.columns == ["query_id", "id", "cosine"]
    assert retrieval.cosine_search(e.filter("false"), q, "id", "v").count() == 0


def test_bm25_of_documents(spark):
    """Scores against the formula, with rows of one id, empty texts, an index in parts, and a cut that keeps the best."""
    import math
    import random

    rnd = random.Random(5)
    rows = [(i if i < 57 else 3, " ".join(rnd.choice("abcdefgh") * 2 for _ in range(rnd.randint(0, 9)))) for i in range(60)] + [(None, "aa bb"), (None, "aa cc"), (100, None)]
    asked = [(1, "aa aa bb"), (2, "cc zz"), (3, ""), (4, "dd ee ff aa")]
    docs, queries = spark.createDataFrame(rows, "d int, text string"), spark.createDataFrame(asked, "q int, text string")
    tf, df = {}, {}
    for d, text in rows:
        words = (text or "").split()
        for w in words:
            tf[d, len(words), w] = tf.get((d, len(words), w), 0) + 1
    for _, _, w in tf:
        df[w] = df.get(w, 0) + 1
    mean, want = sum(len((t or "").split()) for _, t in rows) / len(rows), {}
    for q, text in asked:
        for (d, n, w), k in tf.items():
            if c := text.split().count(w):
                want[q, d] = want.get((q, d), 0.0) + c * math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * k * 2.5 / (k + 1.5 * (0.25 + 0.75 * n / mean))
    for postings in (2, 500_000):
        got = {(r["q"], r["d"]): r["score"] for r in retrieval.bm25(docs, queries, "d", "q", "text", postings=postings).collect()}
        assert got == pytest.approx(want)
    full = retrieval.ranked(retrieval.bm25(docs, queries, "d", "q", "text"), "q", "d", 3)
    cut = retrieval.ranked(retrieval.bm25(docs, queries, "d", "q", "text", most=3), "q", "d", 3)
    assert sorted(full.collect(), key=repr) == sorted(cut.collect(), key=repr)
    # documents of equal scores: the smallest ids stay
    same = spark.range(200).selectExpr("cast(199 - id as int) as d", "'aa' as text").coalesce(1)
    best = retrieval.ranked(retrieval.bm25(same, queries, "d", "q", "text", most=2), "q", "d", 2)
    assert sorted((r["q"], r["d"]) for r in best.collect()) == [(1, 0), (1, 1), (4, 0), (4, 1)]
    # no scores are exchanged: one exchange at most for a side that adds up rows of one id
    unique = docs.filter("d < 50 and d <> 3")
    assert "Exchange" not in retrieval.bm25(unique, queries, "d", "q", "text")._jdf.queryExecution().executedPlan().toString()


def test_ranks_over_ranges(spark):
    """Percentiles of few and of many ranges are those of sorted lists; keys may be null or have no value, and no task counts a key alone."""
    import math

    from tidemark.operators import aggregates

    rnd = random.Random(6)
    rows = [(k, rnd.choice([None, float(rnd.randint(0, 30))])) for k in ["a"] * 300 + ["b"] * 7 + [None] * 40] + [("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    percents = [0.0, 0.29, 0.5, 0.99, 1.0]
    want = {}
    for k in {k for k, _ in rows}:
        v = sorted(x for j, x in rows if j == k and x is not None)
        want[k] = [v[max(1, math.ceil(p * len(v))) - 1] if v else None for p in percents]
    out = aggregates.nearest_rank(df, ["k"], "v", percents)
    assert {r[0]: list(r[1:]) for r in out.collect()} == want
    assert "percentile" not in out._jdf.queryExecution().executedPlan().toString()


def test_diverse_sample_bounds_first(spark):
    """The rows taken are the first of each value, null values and small ones too; the cut comes before the windows over whole values."""
    from tidemark.operators import cases

    df = spark.range(400).selectExpr("id", "case when id % 7 > 0 then id % 3 end as a", "if(id = 5, 'rare', 'often') as b")
    want = set()
    for c in ("a", "b"):
        r = df.selectExpr("id", c, f"row_number() over (partition by {c} order by sha2('d:{c}:' || id, 256), id) as r").filter("r <= 4")
        want |= {x["id"] for x in r.collect()}
    out = cases.diverse_sample(df, ["a", "b"], 4, "d", "id")
    assert sorted(r["id"] for r in out.collect()) == sorted(want)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_holders_are_cut_before_selectors(spark):
    """A key's first holders are found before the join: the partial cut shows in the plan, and the holders are those of all matches."""
    from tidemark.operators import cases

    actions = spark.range(300).selectExpr("id % 90 as h", "'l' || id % 2 as label", "array('p' || id % 5, 'q') as paths")
    selectors = spark.createDataFrame([("a", "l0", None), ("b", None, "q"), ("c", "l1", "p3"), ("d", None, "none"), ("e", None, None)], "selector string, label string, path string")
    hit = "(s.label is null or s.label = a.label) and (s.path is null or array_contains(a.paths, s.path)) and (s.label is not null or s.path is not null)"
    every = selectors.alias("s").join(actions.alias("a"), F.expr(hit)).select("selector", "h").distinct()
    want = every.selectExpr("selector", "row_number() over (partition by selector order by sha2('z:' || h, 256), h) as place", "h").filter("place <= 2")
    out = cases.selected_holders(selectors, actions, "h", "z", 2)
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in want.collect()} | {("d", None, None), ("e", None, None)}
    assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 4
