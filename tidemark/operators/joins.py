"""Joins with the checks and tie rules that keyed record sets need."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators._stage import bounded, free, staged
from tidemark.operators.windows import numbered_whole


class JoinError(ValueError):
    """A keyed join found what it must not find."""


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], on: Sequence[str], take: Sequence[str], strict: bool = False, prefix: str = "asof_") -> DataFrame:
    """For each left row the latest right row at or before it (``strict``: before it) in the order of ``on``.

    Both sides are put into one ordered stream per key and the last right row is
    carried on, so the join costs one exchange and has no range condition. The
    right row's columns ``take`` are added under ``prefix``; they are null where
    there is none. Of right rows with equal order the one with the largest
    ``take`` values wins. A null key or order matches nothing.
    """
    held = F.struct(*take)
    a = left.withColumn("_side", F.lit(0 if strict else 1)).withColumn("_held", F.lit(None).cast(right.select(held.alias("x")).schema[0].dataType))
    b = right.select(*by, *on, held.alias("_held")).withColumn("_side", F.lit(1 if strict else 0))
    both = a.unionByName(b.withColumn("_right", F.lit(True)), allowMissingColumns=True)
    order = W.partitionBy(*by).orderBy(*on, "_side", F.col("_held").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_held", ignorenulls=True).over(order)).filter("_right is null")
    whole = " and ".join(f"{c} is not null" for c in [*by, *on])
    picked = [F.when(F.expr(whole), F.col(f"_last.{c}")).alias(f"{prefix}{c}") for c in take]
    return out.select(*left.columns, *picked)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than one row, and their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def key_mismatch(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has: the keys and ``side`` (left or right)."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, list(keys), "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, list(keys), "left_anti").withColumn("side", F.lit("right")))


def validated_one_to_one(a: DataFrame, b: DataFrame, keys: Sequence[str], same: Sequence[str] = ()) -> DataFrame:
    """Inner join of two sides that must have unique and equal keys, and equal ``same`` columns.

    Raises JoinError with an example otherwise; the checks run at once.
    """
    for name, df in (("left", a), ("right", b)):
        if found := duplicates(df, keys).limit(1).collect():
            raise JoinError(f"{name} side repeats a key: {found[0].asDict()}")
    if found := key_mismatch(a, b, keys).limit(1).collect():
        raise JoinError(f"a key is on one side only: {found[0].asDict()}")
    joined = a.alias("a").join(b.alias("b"), list(keys))
    for c in same:
        if found := joined.filter(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).select(*keys).limit(1).collect():
            raise JoinError(f"sides differ in {c}: {found[0].asDict()}")
    return a.join(b.drop(*same), list(keys))


def left_overwrite(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left outer join in which a matched right row overwrites columns of the same name, with nulls too."""
    r, hit = free("right", a, b), free("hit", a, b)
    right = b.select(*keys, F.struct(*[c for c in b.columns if c not in keys]).alias(r), F.lit(True).alias(hit))
    out = a.join(right, list(keys), "left")
    cols = [F.when(F.col(hit), F.col(f"{r}.{c}")).otherwise(F.col(c)).alias(c) if c in b.columns and c not in keys else F.col(c) for c in a.columns]
    return out.select(*cols, *[F.col(f"{r}.{c}").alias(c) for c in b.columns if c not in a.columns])


def merge_upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], protected: Sequence[str] = ()) -> DataFrame:
    """``target`` with the columns of matching ``source`` rows, save ``protected`` ones. A source row without target is an error."""
    if found := source.join(target, list(keys), "left_anti").select(*keys).limit(1).collect():
        raise JoinError(f"no row to merge into: {found[0].asDict()}")
    return left_overwrite(target, source.select(*[c for c in source.columns if c in target.columns and c not in protected]), keys)


def interval(facts: DataFrame, ranges: DataFrame, by: Sequence[str], at: str, start: str, end: str, order: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Facts with the first range (in ``order``) that holds ``at``: start <= at <= end, a null end is open."""
    hit = (F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) <= F.col(end)))
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return facts.join(ranges, list(by)).filter(hit).withColumn("_r", rank).filter("_r = 1").drop("_r")


def first_mapping(pairs: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row for each key: the first in ``order``."""
    return pairs.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def first_impacts(transitions: DataFrame, actions: DataFrame, specs: DataFrame, entity: str, order: Sequence[str]) -> DataFrame:
    """Each action is impacted by the first transition of its entity that a spec connects to it.

    ``specs`` (event, kind, spec_order) is small by its nature: a registry.
    """
    hits = transitions.join(bounded(specs), "event").join(actions, [entity, "kind"])
    first = F.row_number().over(W.partitionBy(entity, "action_id").orderBy(*order, "spec_order"))
    return hits.withColumn("_r", first).filter("_r = 1").drop("_r")


def nearest(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, other: str, key: Sequence[str]) -> DataFrame:
    """Left rows with the right row of the same ``by`` whose ``other`` is closest to ``at``; ties go to the smaller one.

    Two as-of joins, back and forth, replace the range join: the nearest row is
    the last one at or before, or the first one after.
    """
    slots = right.select(*by, F.col(other).alias(at), F.col(other).alias("_o"))
    back = asof(left, slots, by, [at], ["_o"], prefix="_p")
    flip = lambda df: df.withColumn("_neg", -F.col(at))
    both = asof(flip(back), flip(slots).drop(at), by, ["_neg"], ["_o"], prefix="_n").drop("_neg")
    near = F.when(F.col("_n_o").isNull() | (F.col(at) - F.col("_p_o") <= F.col("_n_o") - F.col(at)), F.col("_p_o")).otherwise(F.col("_n_o"))
    return both.withColumn(other, near).drop("_p_o", "_n_o")


def ordered_pairs(df: DataFrame, column: str) -> DataFrame:
    """All pairs left < right of the distinct values of a dimension column, which must be few (methods, regions)."""
    v = df.select(column).distinct()
    return v.select(F.col(column).alias("left")).join(bounded(v.select(F.col(column).alias("right"))), F.col("left") < F.col("right"))


def similar_sets(sets: DataFrame, key: str, items: str, percent: int, block: int = 4_096, copies: bool = False) -> DataFrame:
    """Pairs a < b of classes of equal sets with a Jaccard similarity of at least ``percent`` percent: a, b, shared, size_a, size_b.

    Equal sets form one class named by the smallest key (see ``set_classes``);
    with ``copies`` the pairs are those of all keys, also of equal sets. A null
    item counts in the size of its set and is shared with none. Empty sets and
    null keys have no partner.

    Exact. Sets are put in order of size, equal ones side by side, and cut into
    blocks; each pair of blocks whose sizes allow the similarity is one task's
    row, which counts the common items of all its pairs. Equal sets are counted
    once in a block and their keys paired last. No pair below the limit leaves a
    task, so what is exchanged is the sets, once for each block that they meet.
    """
    rows = sets.filter((F.size(items) > 0) & F.col(key).isNotNull()).select(F.array_sort(items).alias("s"), F.col(key).alias("k"))
    if not copies:
        rows = rows.groupBy("s").agg(F.min("k").alias("k"))
    rows = numbered_whole(rows.withColumn("n", F.size("s")), ["n", F.xxhash64("s"), "k"], "no")
    ends = rows.agg(F.max("no").alias("no"), F.max("n").alias("n")).first()
    size = max(1, min(block, 2_000_000 // (ends["n"] or 1)))
    # up to 256 keys of one set go together
    held = rows.groupBy(F.expr(f"cast(no div {size} as int)").alias("block"), F.expr("no div 256"), "n", "s")
    held = staged(held.agg(F.min("no").alias("no"), F.collect_list("k").alias("k")).select("block", "no", "n", "k", "s"))
    # an item's number tells it apart; its value is not needed any more
    flat = held.select("no", F.explode("s").alias("x"))
    codes = numbered_whole(flat.select("x").distinct(), ["x"], "code").select("x", F.col("code").cast("int").alias("code"))
    coded = flat.join(codes, "x").groupBy("no").agg(F.collect_list("code").alias("c")).join(held.drop("s"), "no")
    blocks = staged(coded.groupBy("block").agg(F.collect_list(F.struct("k", "n", "c")).alias("sets"), F.min("n").alias("lo"), F.max("n").alias("hi")))
    low, high = blocks.select(F.col("block").alias("i"), "hi"), blocks.select(F.col("block").alias("j"), "lo")
    pairs = low.join(bounded(high), F.col("i") <= F.col("j")).filter(f"100 * hi >= {percent} * lo").select("i", "j")
    sent = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")).join(blocks.select("block", "sets"), "block")
    n_pairs = ((ends["no"] or 0) // size + 1) * ((ends["no"] or 0) // size + 2) // 2
    sent = sent.repartition(min(n_pairs, 2_000), F.xxhash64("i", "j")).sortWithinPartitions("i", "j", "block").select("i", "j", "block", "sets")
    kind = sets.schema[key].dataType.simpleString()
    found = sent.mapInArrow(lambda batches: _block_pairs(batches, percent), f"x {kind}, y {kind}, shared long, size_x long, size_y long").filter("x <> y")
    first = F.col("x") < F.col("y")
    turn = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    return found.select(turn("x", "y").alias("a"), turn("y", "x").alias("b"), "shared", turn("size_x", "size_y").alias("size_a"), turn("size_y", "size_x").alias("size_b"))


def _block_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Similar pairs of two blocks that come one behind the other, or of one block with itself."""
    held = None
    for batch in batches:
        for row in range(batch.num_rows):
            i, j, block = (batch.column(c)[row].as_py() for c in range(3))
            keys, sizes, codes = batch.column(3)[row].values.flatten()
            side = keys.flatten(), np.diff(keys.offsets.to_numpy()).astype(np.int64), sizes.to_numpy().astype(np.int64), np.diff(codes.offsets.to_numpy()), codes.flatten().to_numpy()
            if i < j and block == i:
                held = side
                continue
            yield from _similar(held if i < j else side, side, i == j, percent)


def _similar(left: tuple, right: tuple, same: bool, percent: int, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Counts of common items: frequent ones by products of 0/1 matrices, the others by writing out their pairs."""
    (ka, ma, sa, na, ca), (kb, mb, sb, nb, cb) = left, right
    first_a, first_b = np.cumsum(ma) - ma, np.cumsum(mb) - mb
    ra, rb = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    items = np.intersect1d(ca, cb)
    xa, xb = (np.searchsorted(items, c) for c in (ca, cb))
    ina, inb = (np.isin(c, items) for c in (ca, cb))
    (ra, xa), (rb, xb) = (ra[ina], xa[ina]), (rb[inb], xb[inb])
    order = np.argsort(xb, kind="stable")
    rb, xb = rb[order], xb[order]
    fb = np.bincount(xb, minlength=len(items))
    start = np.cumsum(fb) - fb
    often = np.bincount(xa, minlength=len(items)) * fb > 50_000
    place = np.cumsum(often) - 1
    n_often = int(often.sum())
    kind = np.float32 if max(len(ca), len(cb)) < 2**24 else np.float64  # counts are whole in it
    # limits just below the true ones; what passes is judged in whole numbers
    la, lb = ((percent * s / (100 + percent) * (1 - 1e-6)).astype(kind) for s in (sa, sb))
    dense = np.zeros((len(nb), n_often), kind)
    dense[rb[often[xb]], place[xb[often[xb]]]] = 1
    edges = np.searchsorted(ra, np.arange(0, len(na) + rows, rows))  # ra rises
    for k, lo in enumerate(range(0, len(na), rows)):
        r, x = ra[edges[k] : edges[k + 1]] - lo, xa[edges[k] : edges[k + 1]]
        n = min(rows, len(na) - lo)
        some = np.zeros((n, n_often), kind)
        some[r[often[x]], place[x[often[x]]]] = 1
        shared = some @ dense.T
        r, x = r[~often[x]], x[~often[x]]
        if len(x):
            times = fb[x]
            at = np.repeat(start[x] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            shared += np.bincount(np.repeat(r, times) * len(nb) + rb[at], minlength=n * len(nb)).reshape(n, len(nb))
        at = np.flatnonzero(shared >= la[lo : lo + n, None] + lb[None, :])
        common, p, q = shared.ravel()[at].astype(np.int64), at // len(nb) + lo, at % len(nb)
        fits = (common > 0) & (common * (100 + percent) >= percent * (sa[p] + sb[q]))
        if same:
            fits &= p <= q
        common, p, q = common[fits], p[fits], q[fits]
        before = np.cumsum(ma[p] * mb[q]) - ma[p] * mb[q]
        for part in np.split(np.arange(len(p)), np.flatnonzero(np.diff(before // 200_000)) + 1):
            i, j = p[part], q[part]
            u, v, of = _all_keys(first_a[i], ma[i], first_b[j], mb[j])
            if same:  # a key meets those behind it
                u, v, of = u[u < v], v[u < v], of[u < v]
            yield pa.RecordBatch.from_arrays([ka.take(pa.array(u)), kb.take(pa.array(v)), pa.array(common[part][of]), pa.array(sa[i][of]), pa.array(sb[j][of])], names=["x", "y", "shared", "size_x", "size_y"])


def _all_keys(first_a: np.ndarray, n_a: np.ndarray, first_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of all places of two runs, for each pair of runs, and which pair of runs they are of."""
    n = n_a * n_b
    of = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(of)) - (np.cumsum(n) - n)[of]
    return first_a[of] + at // n_b[of], first_b[of] + at % n_b[of], of


def set_classes(sets: DataFrame, key: str, items: str) -> DataFrame:
    """Class of each row: the smallest key with the same set. Empty sets stand alone."""
    s = F.sha2(F.array_join(F.array_sort(items), "\n"), 256)
    named = staged(sets.select(key, F.when(F.size(items) > 0, s).alias("s")))
    # only sets that occur twice need a join; those of many rows go to all tasks, so that no task gets all rows of one
    least = staged(named.filter("s is not null").groupBy("s").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    large = bounded(least.filter("n > 1000").select("s", F.col("class_id").alias("_large")))
    out = named.join(large, "s", "left").withColumn("_s", F.when(F.col("_large").isNull(), F.col("s")))
    out = out.join(bounded(least.filter("n <= 1000").select(F.col("s").alias("_s"), "class_id")), "_s", "left")
    return out.select(key, F.coalesce("_large", "class_id", key).alias("class_id"))


def grounded(claims: DataFrame, evidence: DataFrame, on: Sequence[tuple[str, Column]]) -> DataFrame:
    """Claims with ``grounded``: whether evidence agrees in all of ``on``, nulls being equal to nulls."""
    keys = [c for c, _ in on]
    ev = evidence.select(*[e.alias(f"_e{i}") for i, (_, e) in enumerate(on)]).distinct().withColumn("_hit", F.lit(True))
    cond = [F.col(c).eqNullSafe(F.col(f"_e{i}")) for i, c in enumerate(keys)]
    return claims.join(ev, cond, "left").select(*claims.columns, F.coalesce("_hit", F.lit(False)).alias("grounded"))


def impacts(transitions: DataFrame, specs: DataFrame, actions: DataFrame, entity: str, order: Sequence[str]) -> DataFrame:
    """Impacts of transitions on standing actions: each action is hit once, by the first transition whose spec selects it.

    ``transitions``: entity, event, columns of ``order``, with ``hook`` and
    ``params`` (map of text) if specs ask for them. ``specs`` (a registry): event,
    spec_no, label and path (null: not stated; one of them must be), decision;
    maybe hook, ``wanted`` (map of a parameter to its allowed values), impact_type
    and risk. ``actions``: entity, action_id, kind, paths, status, moves_funds.
    Cancelled and historical actions are left out. What moves funds must not be
    executed by itself: a decision to execute becomes one to ask.

    Of an entity's transitions only the first that meets a spec counts, so that is
    found before actions are joined; what a spec states (label, path, both) makes
    three joins on equal keys. An entity has at most specs times actions rows.
    """
    more = [c for c in ("impact_type", "risk") if c in specs.columns]
    hits = transitions.join(bounded(specs), ["event", *(["hook"] if "hook" in specs.columns else [])])
    if "wanted" in specs.columns:
        hits = hits.filter(F.forall(F.map_entries("wanted"), lambda e: F.coalesce(F.array_contains(e["value"], F.try_element_at("params", e["key"])), F.lit(False))))
    what = ["spec_no", "label", "path", "decision", *more]
    first = hits.filter("label is not null or path is not null").groupBy(entity, "event", *what).agg(F.min(F.struct(*order)).alias("at"))
    live = actions.filter(~F.coalesce(F.col("status").isin("cancelled", "historical"), F.lit(False))).select(entity, "action_id", F.col("kind").alias("label"), "paths", F.coalesce("moves_funds", F.lit(False)).alias("moves_funds"))
    by_path = live.select(entity, "action_id", "label", "moves_funds", F.explode(F.array_distinct("paths")).alias("path"))
    kept = [entity, "action_id", "moves_funds", "at", "spec_no", "decision", *more]
    found = first.filter("path is null").drop("path").join(live.drop("paths"), [entity, "label"]).select(kept)
    found = found.unionByName(first.filter("label is null").drop("label").join(by_path.drop("label"), [entity, "path"]).select(kept))
    found = found.unionByName(first.filter("label is not null and path is not null").join(by_path, [entity, "label", "path"]).select(kept))
    hit = found.groupBy(entity, "action_id").agg(F.min_by(F.struct("at", "spec_no", "decision", "moves_funds", *more), F.struct("at", "spec_no")).alias("hit")).select(entity, "action_id", "hit.*")
    ask = F.when(F.col("moves_funds") & (F.col("decision") == "execute"), "ask_confirmation").otherwise(F.col("decision"))
    return hit.select(entity, "action_id", "at.*", "spec_no", ask.alias("decision"), F.col("moves_funds").alias("must_not_execute"), *more)


def identity_join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``validated_one_to_one`` of two sides whose other common columns must agree row by row; they appear once."""
    return validated_one_to_one(a, b, keys, [c for c in b.columns if c in a.columns and c not in keys])


def running_firsts(df: DataFrame, by: Sequence[str], key: Sequence[str], order: Sequence[str], item: str) -> DataFrame:
    """The first row of each key, with all items of its ``by`` up to it, in order."""
    first = F.row_number().over(W.partitionBy(*by, *key).orderBy(*order))
    upto = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("_r", first).filter("_r = 1").drop("_r").withColumn("so_far", F.collect_list(item).over(upto))
