"""Near-duplicate documents by b-bit MinHash.

Documents with equal shingle sets form a class first, so that copies cost one
row. Each class gets 128 minima; bands of four of them name buckets, whose
members are compared. From each minimum only the low bits are kept, packed into
a few long integers; the share of equal lanes, counted by bit operations and
corrected for lanes that agree by chance, estimates the similarity and drops
pairs that are far off. The rest is confirmed on the full shingle sets.

Not all pairs of a bucket are made. Every member meets the bucket's smallest
member, and the links found give components. Where a bucket still holds several
components, blocks of its members are compared by a longer signature, the largest
component with the rest and the rest with itself: first each member's best
partners are confirmed, then, between the components that remain, all pairs that
pass. Pairs that are left out lie in one component already, so no component
misses a link.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm._common import materialize, mix64, small, text_batches

PERMS, ROWS, BITS = 128, 4, 2
#: A pair whose estimate is this much below the threshold (six standard errors and more) is not confirmed.
MARGIN = 0.27
#: Signature for comparing blocks of a bucket: minima, margin (five standard errors), members in a block, best partners tried first.
WIDE, WIDE_MARGIN, BLOCK, FIRST = 2048, 0.055, 1024, 4
#: Rows of three numbers that are sent to all tasks at most (beyond it both sides are dealt by key); copies from which on a class is sent.
BROADCAST, LARGE = 500_000, 1_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_LANES = 64 // BITS
_rng = np.random.default_rng(0x5EED)
_MUL = _rng.integers(0, 2**63, PERMS + WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, PERMS + WIDE, dtype=np.uint64)
_MIXER = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SIGNED = "doc_id long, h long, n_shingles long, set_id binary, bands array<long>, packed array<long>"


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a text with fewer words is one shingle, an empty one none."""
    codes: dict[bytes, int] = {}
    words = [(t or "").encode().translate(_LOWER).split() for t in texts]
    flat = np.fromiter((codes.setdefault(w, len(codes)) for ws in words for w in ws), np.int64)
    named = np.fromiter((int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in codes), np.uint64, len(codes))[flat] if len(flat) else np.zeros(0, np.uint64)
    out, at = [], 0
    n = len(named)
    whole = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width if len(whole) else 0):
        whole = mix64(whole * _MIXER[k] + named[k : k + len(whole)])
    for ws in words:
        if len(ws) >= width:
            out.append(np.unique(whole[at : at + len(ws) - width + 1]))
        elif ws:
            h = np.full(1, len(ws), np.uint64)
            for k in range(at, at + len(ws)):
                h = mix64(h * _MIXER[9] + named[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        at += len(ws)
    return out


def minima(sets: list[np.ndarray], perms: range = range(PERMS)) -> np.ndarray:
    """Minima of each non-empty set under the permutations, as a matrix of unsigned 32-bit integers."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    flat = np.concatenate(sets)
    out = np.empty((len(sets), len(perms)), np.uint32)
    for k, p in enumerate(perms):
        out[:, k] = np.minimum.reduceat(((flat * _MUL[p] + _ADD[p]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _signatures(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, which hold the number of their band, and packed low bits."""
    groups = least.reshape(len(least), -1, ROWS).astype(np.uint64)
    bands = np.tile(np.arange(groups.shape[1], dtype=np.uint64), (len(least), 1))
    for k in range(ROWS):
        bands = mix64(bands * _MIXER[k] + groups[:, :, k])
    return bands.view(np.int64), pack(least).view(np.int64)


def pack(least: np.ndarray) -> np.ndarray:
    """The low BITS of every minimum, side by side in unsigned 64-bit integers."""
    low = (least & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(len(least), -1, _LANES)
    return np.bitwise_or.reduce(low << (np.arange(_LANES, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def sign(docs: DataFrame, width: int) -> DataFrame:
    """Set size, set identity, band keys and packed low bits of every document; empty sets have nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, texts in text_batches(batch, 2_000_000):
                sets = shingle_sets(texts, width)
                full = [i for i, x in enumerate(sets) if len(x)]
                bands, packed = [None] * len(sets), [None] * len(sets)
                if full:
                    for i, b, p in zip(full, *_signatures(minima([sets[i] for i in full]))):
                        bands[i], packed[i] = b, p
                names = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), batch.column(2).slice(at, len(ids)), pa.array(map(len, sets), pa.int64()), pa.array(names, pa.binary()), pa.array(bands, longs), pa.array(packed, longs)],
                    names=["doc_id", "h", "n_shingles", "set_id", "bands", "packed"],
                )
                at += len(ids)

    return _keyed(docs).select("doc_id", "text", "h").mapInArrow(run, SIGNED)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and h, a hash of the text: it tells rows with one id apart, and equal rows share both."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h"))


def estimate(a: str, b: str) -> Column:
    """Similarity by the share of equal lanes of two packed signatures, corrected for chance agreement."""
    low = sum(1 << (BITS * k) for k in range(_LANES))
    low -= (low >> 63) << 64
    apart = "0"
    for k in range(PERMS // _LANES):
        x = f"({a}[{k}] ^ {b}[{k}])"
        lanes = " | ".join([x, *(f"shiftrightunsigned({x}, {s})" for s in range(1, BITS))])
        apart += f" + bit_count(({lanes}) & {low}L)"
    chance = 0.5**BITS
    return F.expr(f"((1 - ({apart}) / {PERMS}.0D) - {chance}) / {1 - chance}")


def components(labels: DataFrame, links: DataFrame, tag: str) -> DataFrame:
    """New labels of the vertices that move: (v, d), the smallest label reachable over ``links`` (a, b).

    ``labels`` (v, c) has one label for each vertex so far; vertices that share
    a label are one component. Only labels at a link take part, so the work
    follows the links. Each round takes the least label among the neighbours and
    then that label's own, which shortens long chains; it ends when no label changes.
    """
    ends = links.join(labels.toDF("a", "x"), "a").join(labels.toDF("b", "y"), "b").filter("x <> y").select("x", "y")
    both = materialize(ends.union(ends.select("y", "x")).distinct(), f"{tag}_edges")
    now = both.select("x").distinct().select("x", F.col("x").alias("d"))
    for k in itertools.count(1):
        near = both.join(now.toDF("y", "dy"), "y").groupBy("x").agg(F.min("dy").alias("near"))
        new = now.join(near, "x", "left").select("x", "d", F.least("d", "near").alias("e"))
        new = new.join(now.toDF("e", "top"), "e", "left").select("x", "d", F.least("e", "top").alias("e"))
        new = materialize(new, f"{tag}_{k}")
        if new.filter("e < d").limit(1).count() == 0:
            break
        now = new.select("x", F.col("e").alias("d"))
    return labels.join(new.select(F.col("x").alias("c"), F.col("e").alias("d")), "c").select("v", "d")


def _moved(labels: DataFrame, links: DataFrame, tag: str) -> DataFrame:
    """``labels`` after ``links``."""
    new = components(labels, links, tag)
    return materialize(labels.join(new, "v", "left").select("v", F.coalesce("d", "c").alias("c")), tag)


def _candidates(docs: DataFrame, wanted: DataFrame, repeated: bool, width: int) -> DataFrame:
    """(v, members): the packed shingle sets of the classes in ``wanted`` (v, doc_id, h), made in one pass over the texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vs, texts in text_batches(batch, 4_000_000):
                yield pa.RecordBatch.from_arrays([pa.array(vs, pa.int64()), pa.array([x.tobytes() for x in shingle_sets(texts, width)], pa.binary())], names=["v", "members"])

    rows = _keyed(docs).join(small(wanted, BROADCAST), ["doc_id", "h"])
    rows = rows.groupBy("v").agg(F.first("text").alias("text")) if repeated else rows.select("v", "text")
    return materialize(rows.mapInArrow(sets, "v long, members binary"), "sets")


def confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets share ``percent`` of their union."""
    wanted = pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).distinct()
    full = sets.join(small(wanted, BROADCAST), "v", "left_semi")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(k) for k in range(4))
            fine = []
            for i in range(len(a)):
                p, q = np.frombuffer(x[i].as_py(), np.uint64), np.frombuffer(y[i].as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                fine.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(fine, pa.bool_()))

    left = pairs.join(full.select(F.col("v").alias("a"), F.col("members").alias("x")), "a")
    return left.join(full.select(F.col("v").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _sharp(sets: DataFrame, placed: DataFrame) -> DataFrame:
    """Longer signatures of the classes in ``placed``."""

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sig = pack(minima([np.frombuffer(x, np.uint64) for x in part.column(1).to_pylist()], range(PERMS, PERMS + WIDE)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in sig], pa.binary())], names=["v", "sig"])

    return materialize(sets.join(small(placed.select("v").distinct(), BROADCAST), "v", "left_semi").mapInArrow(wide, "v long, sig binary"), "sharp")


def _mixed(placed: DataFrame) -> DataFrame:
    """Buckets that hold several components: k, the component with most members, and block counts of it and of the rest."""
    comps = placed.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"))
    out = comps.groupBy("k").agg(F.max_by("c", F.struct("n", "c")).alias("top"), F.max("n").alias("n_top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("comps"))
    return out.filter("comps > 1").select("k", "top", F.expr(f"(n_top - 1) div {BLOCK} + 1").alias("g_top"), F.expr(f"(n - n_top - 1) div {BLOCK} + 1").alias("g_rest"))


def _block_pairs(placed: DataFrame, sharp: DataFrame, percent: int, best: int | None) -> DataFrame:
    """Pairs (s, v) of members of a bucket that lie in different components and pass the longer estimate.

    ``placed``: k, v, c, n_shingles and the columns of ``_mixed``. The members of
    a bucket's largest component meet those outside of it, and these meet each
    other, so what the largest component shares is never compared. Both kinds are
    cut into blocks of about BLOCK members; a task compares two blocks by their
    signatures and returns only what passes: each pair under the first of the
    buckets that both are in, and with ``best`` only that many of the closest
    partners of a member in a block.
    """
    x = F.pmod(F.xxhash64("v"), F.when(F.col("c") == F.col("top"), F.col("g_top")).otherwise(F.col("g_rest")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    # kind 0: block i of the rest with block j of the largest component (for j = 0 also with itself); kind 1: two blocks of the rest
    at_top = F.transform(upto("g_rest"), lambda i: cell(0, i, F.col("x")))
    others = F.filter(upto("g_rest"), lambda y: y != F.col("x"))
    at_rest = F.concat(F.transform(upto("g_top"), lambda j: cell(0, F.col("x"), j)), F.transform(others, lambda y: cell(1, F.least(F.col("x"), y), F.greatest(F.col("x"), y))))
    rows = placed.withColumn("x", x).withColumn("cell", F.explode(F.when(F.col("c") == F.col("top"), at_top).otherwise(at_rest)))
    of = placed.groupBy("v").agg(F.collect_list("k").alias("ks"))  # a few buckets for each
    rows = rows.join(sharp.join(of, "v"), "v").select("k", "cell", F.struct("v", "c", "n_shingles", "x", (F.col("c") == F.col("top")).alias("t"), "sig", "ks").alias("m"))
    cells = rows.groupBy("k", "cell").agg(F.collect_list("m").alias("ms"))
    low = np.uint64(sum(1 << (BITS * k) for k in range(_LANES)))
    chance = 0.5**BITS

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                here, kind, i, j = (batch.column(k)[row].as_py() for k in range(4))
                ms = batch.column(4)[row].values
                v, c, n, x = (np.asarray(ms.field(k)) for k in ("v", "c", "n_shingles", "x"))
                t = np.array(ms.field("t").to_pylist(), bool)
                sig = np.frombuffer(b"".join(ms.field("sig").to_pylist()), np.uint64).reshape(len(v), -1)
                near_size = lambda a, b: (c[a] != c[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))  # noqa: B023, E731
                grid = lambda xs, ys: tuple(z.ravel() for z in np.meshgrid(xs, ys, indexing="ij"))
                todo = [grid(np.flatnonzero(~t), np.flatnonzero(t))] if kind == 0 else [grid(np.flatnonzero(x == i), np.flatnonzero(x == j))]
                if kind == 0 and j == 0:
                    p, q = grid(np.flatnonzero(~t), np.flatnonzero(~t))
                    todo.append((p[v[p] < v[q]], q[v[p] < v[q]]))
                p, q = (np.concatenate(z) for z in zip(*todo))
                ok = near_size(p, q)
                p, q = p[ok], q[ok]
                before = [frozenset(k for k in ks if k < here) for ks in ms.field("ks").to_pylist()]
                found = []
                for at in range(0, len(p), 4_000):
                    a, b = p[at : at + 4_000], q[at : at + 4_000]
                    diff = sig[a] ^ sig[b]
                    apart = diff.copy()
                    for s in range(1, BITS):
                        apart |= diff >> np.uint64(s)
                    like = (1 - np.bitwise_count(apart & low).sum(axis=1) / WIDE - chance) / (1 - chance)
                    near = np.flatnonzero(like >= percent / 100 - WIDE_MARGIN)
                    near = near[[before[u].isdisjoint(before[w]) for u, w in zip(a[near], b[near])]] if len(near) else near
                    found.append((a[near], b[near], like[near]))
                if found:
                    a, b, like = (np.concatenate(z) for z in zip(*found))
                    if best is not None and len(a):
                        order = np.lexsort((-like, a))
                        a, b = a[order], b[order]
                        start = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                        rank = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
                        a, b = a[rank < best], b[rank < best]
                    yield pa.RecordBatch.from_arrays([pa.array(v[a]), pa.array(v[b])], names=["s", "v"])

    return cells.select("k", "cell.kind", "cell.i", "cell.j", "ms").mapInArrow(compare, "s long, v long")


def _labelled(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, h, n_shingles of every row and, for those with an id and a set, the key of the row that stands for its component: first_id, first_h."""
    signed = materialize(sign(docs, width), "signed")
    usable = signed.filter("set_id is not null and doc_id is not null")
    least = F.min_by(F.struct("doc_id", "h", "n_shingles", "bands", "packed"), F.struct("doc_id", "h"))
    reps = usable.groupBy("set_id").agg(least.alias("r"), F.count(F.lit(1)).alias("size")).select(F.monotonically_increasing_id().alias("v"), "set_id", "size", "r.*")
    reps = materialize(reps, "reps")
    repeated = usable.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() > 0
    banded = reps.select("v", F.explode("bands").alias("k"))
    buckets = banded.groupBy("k").agg(F.min("v").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("k", "first")
    members = materialize(banded.join(buckets, "k"), "members")
    sizes = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    sig = reps.select("v", "packed", "n_shingles")
    star = members.filter("v <> first").select(F.col("first").alias("a"), F.col("v").alias("b")).distinct()
    star = star.join(sig.toDF("a", "sig_a", "n_a"), "a").join(sig.toDF("b", "sig_b", "n_b"), "b")
    star = materialize(star.filter(sizes).filter(estimate("sig_a", "sig_b") >= percent / 100 - MARGIN).select("a", "b"), "star")
    sets = _candidates(docs, reps.select("v", "doc_id", "h").join(members.select("v").distinct(), "v", "left_semi"), repeated, width)
    labels = _moved(reps.select("v", F.col("v").alias("c")), materialize(confirmed(sets, star, percent), "links"), "star_components")
    sharp = None
    for best in (FIRST, None):
        placed = members.select("k", "v").join(labels, "v")
        placed = materialize(placed.join(_mixed(placed), "k").join(reps.select("v", "n_shingles"), "v"), "placed")
        if sharp is None:
            sharp = _sharp(sets, placed)
        met = _block_pairs(placed, sharp, percent, best)
        met = materialize(met.select(F.least("s", "v").alias("a"), F.greatest("s", "v").alias("b")).distinct(), "met")
        if met.limit(1).count() == 0:
            break
        labels = _moved(labels, confirmed(sets, met, percent), "components")
    firsts = reps.join(labels, "v").groupBy("c").agg(F.min(F.struct("doc_id", "h")).alias("f"))
    classes = reps.join(labels, "v").select("set_id", "size", "c").join(firsts, "c").select("set_id", "size", F.col("f.doc_id").alias("first_id"), F.col("f.h").alias("first_h"))
    classes = materialize(classes, "classes")
    # large classes go to every task, so that the rows of one are not dealt to a single task
    large = small(classes.filter(f"size > {LARGE}").select("set_id", F.col("first_id").alias("large_id"), F.col("first_h").alias("large_h")), BROADCAST)
    out = signed.select("doc_id", "h", "n_shingles", "set_id").join(large, "set_id", "left")
    key = F.when(F.col("large_id").isNull() & F.col("doc_id").isNotNull(), F.col("set_id"))
    rest = classes.filter(f"size <= {LARGE}").select(F.col("set_id").alias("key"), "first_id", "first_h")
    out = out.withColumn("key", key).join(rest, "key", "left")
    own = F.col("doc_id").isNotNull()
    return out.select("doc_id", "h", "n_shingles", F.when(own, F.coalesce("large_id", "first_id")).alias("first_id"), F.when(own, F.coalesce("large_h", "first_h")).alias("first_h"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Component of near duplicates of every document: doc_id, n_shingles, component_id, kept.

    ``docs`` has ``doc_id`` and ``text``; other columns are left alone, whatever
    their names. ASCII letters count as lower case. A text with fewer words than
    ``width`` is one shingle; null and empty texts have no shingles, link with
    nothing and are kept. ``component_id`` is the smallest id reachable over
    links with at least ``percent`` percent of shared shingles. Rows with a null
    id are their own component. Every row gives one row: repeated ids are
    documents of their own, linked by their texts alone, and all of those with
    the component's id are kept. An empty table gives an empty result.
    """
    out = _labelled(docs, width, percent)
    c = F.coalesce("first_id", "doc_id")
    return out.select("doc_id", "n_shingles", c.alias("component_id"), F.coalesce(F.col("doc_id") == c, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id, all columns as they are.

    Of rows with that id the one with the smallest hash of its text stays, of
    equal ones any one. Rows with a null id and texts without words all stay.
    """
    found = materialize(_labelled(docs, width, percent), "verdicts")
    mine = F.struct("doc_id", "h") == F.struct(F.col("first_id"), F.col("first_h"))
    is_in = lambda keys: (docs["doc_id"] == keys["id_"]) & (F.xxhash64(docs["text"]) == keys["h_"])
    gone = found.filter("first_id is not null").filter(~mine).select(F.col("doc_id").alias("id_"), F.col("h").alias("h_")).distinct()
    out = docs.join(small(gone, BROADCAST), is_in(gone), "left_anti")
    again = found.filter("first_id is not null").filter(mine).groupBy(F.col("doc_id").alias("id_"), F.col("h").alias("h_")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = materialize(again, "again")
    if again.limit(1).count() == 0:
        return out
    one = docs.join(again, is_in(again), "left_semi").groupBy("doc_id", F.xxhash64("text")).agg(F.first(F.struct("*")).alias("row")).select("row.*")
    return out.join(again, is_in(again), "left_anti").unionAll(one)
