"""Aligning ordered ledgers, and chains across checkpoints."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.operators._stage import dealt

ALIGNED = "item string, gold_ord int, pred_ord int, distance int"
CHAINS = "entity string, event string, chain int, n int, first_checkpoint int, last_checkpoint int"


def _gains(gold: Sequence, pred: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are of one event, and what matching them is worth: one integer that orders by matches, then distance, then overlap."""
    codes: dict[str, int] = {}
    kinds = [np.array([codes.setdefault(x[0], len(codes)) for x in side]) for side in (gold, pred)]
    apart = np.abs(np.array([x[1] for x in gold])[:, None] - np.array([x[1] for x in pred])[None, :])
    shared = np.zeros(apart.shape, np.int64)
    holders: dict[str, list[int]] = {}
    for j, x in enumerate(pred):
        for token in x[2]:
            holders.setdefault(token, []).append(j)
    for i, x in enumerate(gold):
        for token in x[2]:
            shared[i, holders.get(token, [])] += 1
    most = min(apart.shape)
    far = int(shared.max()) * most + 1
    one = (int(apart.max()) * most + 1) * far
    kind = np.int64 if one * (most + 1) < 2**62 else object
    return kinds[0][:, None] == kinds[1][None, :], one - apart.astype(kind) * far + shared.astype(kind)


def align_lists(gold: Sequence[tuple[str, int, frozenset]], pred: Sequence[tuple[str, int, frozenset]]) -> list[tuple[int, int]]:
    """Index pairs of a monotonic alignment of (event, anchor, evidence) lists.

    It has the most matches of equal events; among those the least sum of anchor
    distances; among those the largest evidence overlap. Ties prefer a match to
    leaving out gold, and that to leaving out a prediction. The values of what is
    still to come are found diagonal by diagonal from the end of both lists, a
    diagonal in one numpy step; the first way that reaches them is then taken.
    """
    n, m = len(gold), len(pred)
    if not n or not m:
        return []
    same, gain = _gains(gold, pred)
    rest = np.zeros((n + 1, m + 1), gain.dtype)  # worth of gold[i:] with pred[j:]
    for d in range(n + m - 2, -1, -1):
        i = np.arange(max(0, d - m + 1), min(n - 1, d) + 1)
        j = d - i
        leave = np.maximum(rest[i + 1, j], rest[i, j + 1])
        take = rest[i + 1, j + 1] + gain[i, j]
        rest[i, j] = np.where(same[i, j] & (take > leave), take, leave)
    pairs, i, j = [], 0, 0
    while i < n and j < m:
        if same[i, j] and rest[i, j] == rest[i + 1, j + 1] + gain[i, j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif rest[i, j] == rest[i + 1, j]:
            i += 1
        else:
            j += 1
    return pairs


def order_predictions(df: DataFrame, by: Sequence[str], first_evidence: str, given: str) -> DataFrame:
    """Adds ``ord``: place by number of the first evidence, then by the order given."""
    return df.withColumn("ord", F.row_number().over(W.partitionBy(*by).orderBy(first_evidence, given)))


def align_ledgers(entries: DataFrame) -> DataFrame:
    """Alignment of each item's ledgers: item, gold_ord, pred_ord, distance; one of the orders is null for what has no partner.

    ``entries``: item, side (gold or pred), ord, event, anchor int, evidence
    array<string>. A task holds the ledgers of one item, which are short lists.
    """
    schema = pa.schema([("item", pa.string()), ("gold_ord", pa.int32()), ("pred_ord", pa.int32()), ("distance", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, sides, out = None, {"gold": [], "pred": []}, []

        def done() -> list[tuple]:
            g, p = sides["gold"], sides["pred"]
            pairs = align_lists(g, p)
            rows = [(item, g[a][3], p[b][3], abs(g[a][1] - p[b][1])) for a, b in pairs]
            left, right = {a for a, _ in pairs}, {b for _, b in pairs}
            rows += [(item, x[3], None, None) for k, x in enumerate(g) if k not in left]
            return rows + [(item, None, x[3], None) for k, x in enumerate(p) if k not in right]

        for batch in batches:
            for name, side, ord_, event, anchor, evidence in zip(*(c.to_pylist() for c in batch.columns)):
                if name != item:
                    out += done()
                    item, sides = name, {"gold": [], "pred": []}
                    if len(out) > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                        out = []
                sides[side].append((event, anchor, frozenset(evidence or ()), ord_))
        out += done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    rows = dealt(entries.select("item", "side", "ord", "event", "anchor", "evidence"), ["item"], ["side", "ord"])
    return rows.mapInArrow(run, ALIGNED)


def hallucination_chains(unmatched: DataFrame, grid: DataFrame, most: int = 3) -> DataFrame:
    """Chains of the same unmatched event over checkpoints: entity, event, chain, n, first_checkpoint, last_checkpoint.

    ``unmatched``: entity, event, checkpoint, ord, anchor; ``grid``: entity and
    all its checkpoints, also those without unmatched events. At each checkpoint
    every open chain, the oldest first, takes the first prediction (by ``ord``)
    of its event that is not taken and whose anchor is at most ``most`` away; a
    chain that finds none ends there, and predictions left over start chains. A
    null anchor continues nothing.
    """
    numbered = grid.select("entity", "checkpoint").distinct().withColumn("k", F.row_number().over(W.partitionBy("entity").orderBy("checkpoint")))
    rows = unmatched.join(numbered, ["entity", "checkpoint"]).select("entity", "event", "k", "checkpoint", "ord", "anchor")
    types = (pa.string(), pa.string(), *[pa.int32()] * 4)
    names = [c.split()[0] for c in CHAINS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, at = None, 0, None
        before: list[list] = []  # chains that reached the checkpoint before: number, anchor, n, first, last
        waiting: list[tuple] = []  # predictions of the checkpoint that is being read
        out: list[tuple] = []

        def settle() -> None:
            nonlocal number, before, waiting
            free, kept = waiting, []
            for c in before:
                hit = next((p for p in free if p[1] is not None and c[1] is not None and abs(p[1] - c[1]) <= most), None)
                if hit is None:
                    out.append((*key, c[0], c[2], c[3], c[4]))
                else:
                    free = [p for p in free if p is not hit]
                    kept.append([c[0], hit[1], c[2] + 1, c[3], hit[0]])
            for p in free:
                kept.append([number, p[1], 1, p[0], p[0]])
                number += 1
            before, waiting = kept, []

        def close() -> None:
            nonlocal before
            out.extend((*key, c[0], c[2], c[3], c[4]) for c in before)
            before = []

        for batch in batches:
            for entity, event, k, checkpoint, _, anchor in zip(*(c.to_pylist() for c in batch.columns)):
                if (entity, event) != key or k != at:
                    if waiting:
                        settle()
                    if (entity, event) != key:
                        close()
                        key, number = (entity, event), 0
                    elif k != at + 1:  # a checkpoint without this event
                        close()
                    at = k
                waiting.append((checkpoint, anchor))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out.clear()
        if waiting:
            settle()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return dealt(rows, ["entity", "event"], ["k", "ord"]).mapInArrow(run, CHAINS)
