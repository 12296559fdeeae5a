"""Cases and their parts: anchors, exactly-one lookups, paired conditions, patches, quotas, options, coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.text import hash_pick
from tidemark.operators._stage import bounded
from tidemark.operators.audit import assert_none
from tidemark.operators.joins import JoinError
from tidemark.operators.sets import top_per
from tidemark.operators.windows import numbered_whole


def occurred_anchors(links: DataFrame, visible: DataFrame, by: Sequence[str], instance: str, session: str, no: str) -> DataFrame:
    """The first visible session of each instance: its keys, session and number. Instances without one have no row."""
    seen = links.join(visible.select(*by, session), [*by, session], "left_semi")
    return seen.groupBy(*by, instance).agg(F.min_by(session, no).alias(session), F.min(no).alias(no))


def anchored_pairs(ledger: DataFrame, anchors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ledger entries with their anchors. An entry without an anchor raises with an example."""
    assert_none(ledger.join(anchors, list(keys), "left_anti").select(*keys), "an entry has no anchor")
    return ledger.join(anchors, list(keys))


def exactly_one(df: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` that ``wanted`` keys name, one for each. None, or more than one, raises."""
    hits = wanted.select(*keys).distinct().join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), list(keys), "left").filter("n is null or n > 1")
    assert_none(hits, "not exactly one row")
    return df.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def with_lists(df: DataFrame, parts: DataFrame, keys: Sequence[str], value: str, order: str, name: str) -> DataFrame:
    """``df`` with the ordered values of its parts as an array, empty where there are none. A key has few parts."""
    each = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias(name))
    empty = F.expr(f"cast(array() as array<{parts.schema[value].dataType.simpleString()}>)")
    return df.join(each, list(keys), "left").withColumn(name, F.coalesce(name, empty))


def paired_conditions(rows: DataFrame, case: str, condition: str, names: Sequence[str], value: str) -> DataFrame:
    """Cases that have a row under every condition, their values side by side. A condition twice in a case raises."""
    assert_none(rows.groupBy(case, condition).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "a condition is repeated")
    each = [F.max(F.when(F.col(condition) == n, F.struct(value))).alias(n) for n in names]
    out = rows.groupBy(case).agg(*each)
    return out.filter(" and ".join(f"`{n}` is not null" for n in names)).select(case, *[F.col(f"`{n}`")[value].alias(n) for n in names])


def paired_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """a - b of the rows that both have with a value that is not null."""
    x, y = a.select(*keys, F.col(value).alias("_a")), b.select(*keys, F.col(value).alias("_b"))
    return x.join(y, list(keys)).filter("_a is not null and _b is not null").select(*keys, (F.col("_a") - F.col("_b")).alias("difference"))


def product_plans(variants: DataFrame, tasks: DataFrame, order: Sequence[str]) -> DataFrame:
    """Every variant with every task, numbered in order; both are registries, the smaller side of a checked size."""
    out = variants.join(bounded(tasks, 10_000))
    return numbered_whole(out, order, "ordinal").withColumn("ordinal", (F.col("ordinal") + 1).cast("int"))


def covered(selectors: DataFrame, actions: DataFrame, keys: Sequence[str], holder: str, seed: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(up to ``most`` holders of each selector in seeded order, selectors that nobody matches). They match on ``keys``."""
    hits = selectors.join(actions.select(*keys, holder).distinct(), list(keys))
    r = F.row_number().over(W.partitionBy(*selectors.columns).orderBy(hash_pick(seed, F.col(holder)), holder))
    return hits.withColumn("place", r).filter(F.col("place") <= most), selectors.join(actions.select(*keys).distinct(), list(keys), "left_anti")


def selected_holders(selectors: DataFrame, actions: DataFrame, holder: str, seed: str, most: int) -> DataFrame:
    """Up to ``most`` holders of each selector, in seeded order, and a row without holder for a selector that nobody matches: selector, place, holder.

    ``selectors``: selector, label and path (null: not stated; one that states
    nothing matches nobody). ``actions``: holder, label, paths (array). What a
    selector states makes three joins on equal keys, so no action meets a
    selector that it does not match.
    """
    pick = hash_pick(seed, F.col(holder))
    by_path = actions.select(holder, "label", F.explode(F.array_distinct("paths")).alias("path"))
    # the order of holders is that of no selector, so only a key's first ones meet the selectors
    first = lambda rows, on: top_per(rows.select(*on, holder).distinct(), on, [pick, holder], most, "r_").drop("r_")
    kept = ["selector", holder]
    hits = selectors.filter("label is not null and path is null").join(first(actions, ["label"]), "label").select(kept)
    hits = hits.unionByName(selectors.filter("label is null and path is not null").drop("label").join(first(by_path, ["path"]), "path").select(kept))
    hits = hits.unionByName(selectors.filter("label is not null and path is not null").join(first(by_path, ["label", "path"]), ["label", "path"]).select(kept))
    r = F.row_number().over(W.partitionBy("selector").orderBy(pick, holder))
    took = hits.withColumn("place", r).filter(F.col("place") <= most)
    return selectors.select("selector").join(took, "selector", "left").select("selector", "place", holder)


def patched(rows: DataFrame, patch: DataFrame, keys: Sequence[str], swaps: Sequence[str]) -> DataFrame:
    """``rows`` with the columns ``swaps`` of their patch. A patch without a row, or one that differs in anything else, raises."""
    if set(patch.columns) - {*keys, *swaps} - set(rows.columns):
        raise JoinError("a patch has columns that the rows do not have")
    assert_none(patch.join(rows, list(keys), "left_anti").select(*keys), "a patch has no row")
    same = [c for c in patch.columns if c not in (*keys, *swaps)]
    p = patch.select(*keys, F.struct(*[c for c in patch.columns if c not in keys]).alias("_p"))
    out = rows.join(p, list(keys), "left")
    for c in same:
        assert_none(out.filter(F.col("_p").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_p.{c}"))).select(*keys), f"a patch differs in {c}")
    new = [F.when(F.col("_p").isNotNull(), F.col(f"_p.{c}")).otherwise(F.col(c)).alias(c) if c in swaps else F.col(c) for c in rows.columns]
    return out.select(*new)


def paired_inputs(rows: DataFrame, method: str, item: str) -> DataFrame:
    """What is wrong with a set of method runs: method, item, code (duplicate, missing or extra against the items that most methods have)."""
    each = rows.groupBy(method, item).agg(F.count(F.lit(1)).alias("n"))
    methods = each.select(method).distinct()
    n = methods.count()
    share = each.groupBy(item).agg(F.count(F.lit(1)).alias("have")).withColumn("common", F.col("have") * 2 > n)
    missing = share.filter(f"common and have < {n}").join(bounded(methods, 10_000)).join(each, [method, item], "left_anti").select(method, item, F.lit("missing").alias("code"))
    extra = each.join(share.filter("not common"), item).select(method, item, F.lit("extra").alias("code"))
    return each.filter("n > 1").select(method, item, F.lit("duplicate").alias("code")).unionAll(missing).unionAll(extra)


def not_nested(sets: DataFrame, by: Sequence[str], level: str, items: str) -> DataFrame:
    """Levels that lack an item which the level before them has."""
    before = F.lag(items).over(W.partitionBy(*by).orderBy(level))
    out = sets.withColumn("lost", F.array_sort(F.array_except(before, F.col(items))))
    return out.filter(F.size("lost") > 0).select(*by, level, "lost")


def atom_order(session: Column, event: Column) -> list[Column]:
    """Order of pairs: by number of the session, then by event."""
    return [F.regexp_extract(session, "([0-9]+)$", 1).cast("int"), event]


def best_templates(candidates: DataFrame, by: Sequence[str], score: str, key: str, seed: str) -> DataFrame:
    """The candidate with the best score for each key; of equal ones the least seeded hash."""
    pick = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), hash_pick(seed, *[F.col(c) for c in by], F.col(key)), key))
    return candidates.withColumn("_r", pick).filter("_r = 1").drop("_r")


def chosen(df: DataFrame, key: str, include: Sequence[str] = (), exclude: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """Rows whose key is included (all, if nothing is stated) and not excluded, the first ``most`` by key. A name in both raises."""
    if both := sorted({*include} & {*exclude}):
        raise ValueError(f"included and excluded: {both}")
    out = df.filter(F.col(key).isin(*include)) if include else df
    out = out.filter(~F.col(key).isin(*exclude)) if exclude else out
    return out if most is None else out.orderBy(key).limit(most)


def episode_events(episodes: DataFrame, by: Sequence[str], steps: str, age: str, priority: str, template: str) -> DataFrame:
    """Steps of episodes in one timeline: by age, higher priority first, then template and place in the episode."""
    rows = episodes.select(*by, template, priority, F.posexplode(steps).alias("place", "step"))
    rows = rows.select(*by, template, priority, "place", "step.*")
    return rows.withColumn("no", F.row_number().over(W.partitionBy(*by).orderBy(age, F.desc(priority), template, "place")))


def least_used(df: DataFrame, by: Sequence[str], order: Sequence[str], options: Sequence[str], seed: str) -> DataFrame:
    """A choice for each row, balanced in its group: every round uses each option once, in an order seeded by group and round."""
    n = len(options)
    at = F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1
    out = df.withColumn("_at", at)
    rounds = F.floor(F.col("_at") / n)
    ranked = F.array_sort(F.transform(F.array(*map(F.lit, options)), lambda o: F.struct(hash_pick(seed, *[F.col(c) for c in by], rounds, o).alias("h"), o.alias("o"))))
    return out.withColumn("choice", F.get(ranked, (F.col("_at") % n).cast("int"))["o"]).drop("_at")


def shuffled_options(correct: Column, wrong: Column, seed: str, key: Column) -> Column:
    """array of struct(option_id, text, correct): the right answer and distinct wrong ones in seeded order, named A, B, ..."""
    texts = F.concat(F.array(correct), F.array_except(F.array_distinct(wrong), F.array(correct)))
    ranked = F.array_sort(F.transform(texts, lambda t: F.struct(hash_pick(seed, key, t).alias("h"), t.alias("t"))))
    return F.transform(ranked, lambda x, i: F.struct(F.char(F.lit(65) + i).alias("option_id"), x["t"].alias("text"), (x["t"] == correct).alias("correct")))


def diverse_sample(df: DataFrame, kinds: Sequence[str], n_each: int, seed: str, key: str) -> DataFrame:
    """Rows that cover each value of each kind ``n_each`` times, as far as there are any: a row is taken if it is among the first of one of its values in seeded order. For a quota see ``diverse_quota``."""
    # the last row that each value takes bounds its rows, so most rows go before any of them is exchanged
    rank = lambda c: F.struct(hash_pick(f"{seed}:{c}", F.col(key)).alias("h"), F.col(key).alias("k"))
    near = df
    for c in kinds:
        last = top_per(df.select(F.struct(c).alias("value_"), rank(c).alias("last_")), ["value_"], ["last_"], n_each, "r_").filter(F.col("r_") == n_each).drop("r_")
        near = near.join(bounded(last), F.struct(c).eqNullSafe(F.col("value_")), "left")
        near = near.withColumn(f"_n_{c}", F.col("last_").isNull() | (rank(c) <= F.col("last_"))).drop("value_", "last_")
    out = near.filter(" or ".join(f"`_n_{c}`" for c in kinds)).select(df.columns)
    for c in kinds:
        out = out.withColumn(f"_r_{c}", F.row_number().over(W.partitionBy(c).orderBy(hash_pick(f"{seed}:{c}", F.col(key)), key)))
    take = F.lit(False)
    for c in kinds:
        take = take | (F.col(f"_r_{c}") <= n_each)
    return out.filter(take).drop(*[f"_r_{c}" for c in kinds])


def diverse_quota(df: DataFrame, key: str, number: str, stratum: str, kinds: Sequence[str], targets: Mapping[str, int], total: int, required: Mapping[str, Column] | None = None, most: int = 500_000) -> DataFrame:
    """``total`` rows (all, if there are fewer), chosen greedily for diversity: key, reason, place (from 1).

    First one row for each condition of ``required`` that has any, then rows of
    each stratum up to its share of ``targets`` (rounded to ``total``), then any.
    Each choice takes the row that brings most values of ``kinds`` not seen yet,
    then one whose number is not next to a chosen one, then the largest key.

    Of rows that agree in stratum, kinds and conditions, a choice only ever takes
    one of the largest 3 * total keys: each chosen row makes itself and two
    neighbours unattractive. So Spark keeps these of each combination, and the
    greedy runs over what is left, the same as over all rows. More than ``most``
    of them (combinations times 3 * total) raise.
    """
    flags = {f"is_{k}": F.coalesce(c, F.lit(False)) for k, c in enumerate((required or {}).values())}
    rows = df.select(F.col(key).alias("key"), F.col(number).cast("long").alias("number"), F.col(stratum).cast("string").alias("stratum"), *[F.col(c).cast("string").alias(f"kind_{i}") for i, c in enumerate(kinds)], *[c.alias(n) for n, c in flags.items()])
    alike = ["stratum", *[f"kind_{i}" for i in range(len(kinds))], *flags]
    best = F.row_number().over(W.partitionBy(*alike).orderBy(F.desc("key")))
    kept = rows.withColumn("best", best).filter(F.col("best") <= 3 * total).drop("best").limit(most + 1).collect()
    if len(kept) > most:
        raise ValueError(f"more than {most} candidates: too many combinations of {list(kinds)}")
    chosen, seen = _greedy(kept, len(kinds), list(flags), list(required or {}), targets, total)
    made = [(r["key"], reason, k + 1) for k, (r, reason) in enumerate(zip(chosen, seen))]
    return df.sparkSession.createDataFrame(made, f"key {df.schema[key].dataType.simpleString()}, reason string, place int").withColumnRenamed("key", key)


def _greedy(rows: list, n_kinds: int, flags: list[str], names: list[str], targets: Mapping[str, int], total: int) -> tuple[list, list[str]]:
    traits = {r["key"]: {(i, r[f"kind_{i}"]) for i in range(n_kinds)} for r in rows}
    shares = {s: round(part * total / sum(targets.values())) for s, part in targets.items()}
    # (reason, which rows, how many, of them): a share counts what its stratum has got already
    wishes = [(name, lambda r, f=flag: r[f], 1, False) for flag, name in zip(flags, names)]
    wishes += [(f"stratum:{s}", lambda r, s=s: r["stratum"] == s, n, True) for s, n in shares.items()]
    wishes.append(("rest", lambda r: True, total, True))
    free, chosen, reasons, seen, near = {r["key"]: r for r in rows}, [], [], set(), set()
    for reason, fits, n, counted in wishes:
        for _ in range(n - counted * sum(map(fits, chosen))):
            pool = [r for r in free.values() if fits(r)]
            if not pool or len(chosen) == total:
                break
            row = free.pop(max(pool, key=lambda r: (len(traits[r["key"]] - seen), r["number"] not in near, r["key"]))["key"])
            chosen.append(row)
            reasons.append(reason)
            seen |= traits[row["key"]]
            near |= {row["number"] - 1, row["number"] + 1}
    return chosen, reasons


# -- resuming and sharing work -------------------------------------------------------


def to_do(wanted: DataFrame, results: DataFrame, keys: Sequence[str], ok: Column) -> DataFrame:
    """Wanted rows without a successful result; failed ones come again, and a success is never repeated."""
    return wanted.join(results.filter(F.coalesce(ok, F.lit(False))).select(*keys).distinct(), list(keys), "left_anti")


def merged_results(old: DataFrame, new: DataFrame, keys: Sequence[str], ok: str, order: str) -> DataFrame:
    """One result for each key: a success before a failure, of equal ones the last."""
    r = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(ok), F.desc(order)))
    return old.unionByName(new).withColumn("_r", r).filter("_r = 1").drop("_r")


def prefix_digests(rows: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Each row with a digest of its key's rows up to it: equal digests are equal prefixes. A key's history is a short list."""
    seq = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("v"))))

    def step(acc: Column, x: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1))["d"], F.lit(""))
        return F.concat(acc, F.array(F.struct(x["o"].alias("o"), F.sha2(F.concat_ws(":", last, x["v"]), 256).alias("d"))))

    none = F.expr(f"cast(array() as array<struct<o:{rows.schema[order].dataType.simpleString()},d:string>>)")
    out = rows.groupBy(*by).agg(F.aggregate(seq, none, step).alias("p"))
    return out.select(*by, F.posexplode("p").alias("depth", "x")).select(*by, (F.col("depth") + 1).alias("depth"), F.col("x.o").alias(order), F.col("x.d").alias("digest"))


def shared_prefixes(prefixes: DataFrame, by: Sequence[str]) -> DataFrame:
    """The nodes of the prefix tree: digest, depth, how many keys share it. Each needs to be worked out once."""
    return prefixes.groupBy("digest", "depth").agg(F.count(F.lit(1)).alias("shared_by"), F.min(F.struct(*by)).alias("first"))


def fingerprints(states: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A digest of each key's rows, whatever their order: a query must leave it as it was."""
    each = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return states.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(each)), ","), 256).alias("fingerprint"))
