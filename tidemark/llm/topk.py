"""Exact top-k inner-product search by Fagin's threshold algorithm.

Vectors are cut into blocks. Each block holds one list per dimension, sorted by
that component. A query walks down the lists of its dimensions (up from the end
where its own component is negative), scores what it meets, and stops when the
score of a fictitious vector made of the components last seen in each list is
below its kth best score: nothing further down can beat that. The best k of all
blocks are then ranked per query. Queries are cut into blocks too, and those of
a block share what they read; what a first block of rows gives bounds the search
in all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm._common import materialize

#: Vectors of a block, queries of a block, list entries read at a time.
BLOCK, QUERY_BLOCK, STEP = 4_096, 512, 16


def threshold_search(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, floors: np.ndarray | None = None, read: list[int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its id, and ids and scores of its best k rows, own id left out; ties go to smaller ids.

    ``rows`` and ``queries`` hold integers. The queries of a block read the lists
    together: what any of them meets is scored for all that still run, and each
    stops by its own bound. ``floors`` are scores that k other rows are known to
    reach: what cannot reach them is not looked for, and may be missing. Scores
    are exact: in floats or 64-bit integers while all products fit, else in
    Python's integers. ``read`` is told how many rows were scored.
    """
    if not len(rows) or not len(queries):
        return
    n = len(rows)
    biggest = float(np.abs(rows.astype(np.float64)).max()) * float(np.abs(queries.astype(np.float64)).max()) * rows.shape[1]
    # score and place share an integer below
    kind = object if biggest * (n + 1) >= 2**61 else np.float32 if biggest < 2**24 else np.float64 if biggest < 2**53 else np.int64
    whole = object if kind is object else np.int64
    place = np.empty(n, np.int64)
    place[np.lexsort((np.arange(n), ids))] = np.arange(n)  # ties go to smaller ids
    exact = lambda x: np.array([[int(v) for v in r] for r in x], object)
    data, vecs = (exact(rows), exact(queries)) if kind is object else (rows.astype(kind), queries.astype(kind))
    up, down = np.maximum(vecs, 0), np.minimum(vecs, 0)
    lists = np.argsort(rows, axis=0, kind="stable")
    seen = np.zeros(n, bool)
    worst = -(2**62) if kind is not object else -(1 << 200)
    best = np.full((len(queries), min(k, n)), worst, whole)  # score, then place, in one integer
    least = np.full(len(queries), worst, whole) if floors is None else floors.astype(whole)
    columns = np.arange(rows.shape[1])

    def bound(of: np.ndarray, depth: int) -> np.ndarray:
        highest, lowest = data[lists[n - max(depth, 1)], columns], data[lists[max(depth, 1) - 1], columns]
        return (up[of] @ highest + down[of] @ lowest).astype(whole)

    live = np.flatnonzero(least <= bound(np.arange(len(queries)), 0))
    depth, step = 0, STEP
    while len(live) and not seen.all():
        depth, step = min(depth + step, n), step * 2
        new = np.zeros(n, bool)
        new[lists[:depth].ravel()] = True
        new[lists[n - depth :].ravel()] = True
        fresh = np.flatnonzero(new & ~seen)
        seen |= new
        scores = (vecs[live] @ data[fresh].T).astype(whole)
        both = np.where(query_ids[live][:, None] == ids[fresh][None, :], worst, scores * n + (n - 1 - place[fresh])[None, :])
        both = -np.sort(-np.concatenate([best[live], both], axis=1), axis=1) if kind is object else np.concatenate([best[live], both], axis=1)
        if both.shape[1] > best.shape[1]:
            both = (both if kind is object else -np.partition(-both, best.shape[1] - 1, axis=1))[:, : best.shape[1]]
        best[live] = both
        kth = best[live].min(axis=1)
        reach = np.maximum(np.where(kth == worst, worst, kth // n), least[live])
        live = live[((kth == worst) & (least[live] == worst)) | (reach <= bound(live, depth))]
    if read is not None:
        read.append(int(seen.sum()))
    owner = np.argsort(place)
    for own, row in zip(query_ids, best):
        row = np.sort(row[row > worst])[::-1]
        yield int(own), ids[owner[(n - 1 - row % n).astype(np.int64)]], row // n


def _packed(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """Rows (id, vec) of each block side by side; a block has a bounded number of rows."""
    return rows.withColumn(name, key).groupBy(name, "dim").agg(F.collect_list("id").alias(f"{name}_ids"), F.flatten(F.collect_list("vec")).alias(f"{name}_vecs"))


def quantized(rows: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(id, vec, dim) with integer components floor(scale * x), x as double; unusable vectors are gone. A component that does not fit 64 bits raises."""
    bad = f"exists({vector}, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    good = rows.filter(f"{vec_id} is not null and {vector} is not null and size({vector}) > 0 and not {bad}")
    wide = f"exists({vector}, x -> abs({scale} * cast(x as double)) >= 9223372036854775807D)"
    whole = F.expr(f"transform({vector}, x -> cast(floor({scale} * cast(x as double)) as long))")
    return good.select(F.col(vec_id).alias("id"), F.when(F.expr(wide), F.raise_error(F.lit("a component does not fit 64 bits")).cast("array<bigint>")).otherwise(whole).alias("vec"), F.size(vector).alias("dim"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k best rows of each query by inner product: query_id, rank, vec_id, score.

    Both tables come from ``quantized``. Vectors of another length than the
    query's are no candidates. Rows with the query's own id are left out, and
    repeated ids are separate candidates. A query with no candidate has no row;
    empty tables give an empty result. A score that does not fit 64 bits raises.

    Each block of queries first searches one block of rows; the kth scores found
    there are floors for all other blocks, which mostly end at once.
    """
    n, m = rows.count(), queries.count()
    g, h = n // BLOCK + 1, m // QUERY_BLOCK + 1
    left = _packed(rows, F.pmod(F.xxhash64("id"), F.lit(g)), "b")
    keyed = queries.withColumn("a", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(h)).cast("int"))
    right = _packed(keyed, F.col("a"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                b_ids, b, a_ids, a = (np.asarray(batch.column(j)[i].values) for j in range(1, 5))
                known = dict(batch.column(5)[i].as_py() or ())
                floors = np.array([known.get(q, -(2**62)) for q in a_ids.tolist()]) if known else None
                out = [(np.full(len(v), q), v, s) for q, v, s in threshold_search(b.reshape(-1, dim), b_ids, a.reshape(-1, dim), a_ids, k, floors)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).tolist(), pa.int64()) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    cols = ["dim", "b_ids", "b_vecs", "a_ids", "a_vecs"]
    no_floor = F.lit(None).cast("map<bigint,bigint>").alias("floors")
    own = F.pmod(F.col("a"), F.lit(g)).cast("long")
    first = right.withColumn("b", own).join(left, ["b", "dim"]).select(*cols, no_floor).mapInArrow(run, FOUND)
    if g > 1:
        first = materialize(first, "first")
        # queries with one id share a floor, so the least of what each of them reaches: their rows have ranks of their own
        ranked = first.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k)
        once = queries.groupBy("id").agg(F.count(F.lit(1)).alias("times")).filter("times = 1").select(F.col("id").alias("query_id"))
        floors = ranked.join(once, "query_id").select(F.col("query_id").alias("id"), "score")
        floors = keyed.select("id", "a").join(floors, "id").groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("id", "score"))).alias("floors"))
        spread = left.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).filter(F.col("b") != own)
        cells = spread.repartition("a", "b").join(right.join(floors, "a", "left"), ["a", "dim"])
        first = first.unionAll(cells.select(*cols, "floors").mapInArrow(run, FOUND))
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


FOUND = "query_id long, vec_id long, score long"
