"""Finding what is repeated anywhere in a corpus, without a row for each position.

A map turns documents into runs of 64-bit hashes, some hundred thousand at a
time (a flush). A hash that is repeated inside a flush is settled there. The
others travel once, as packed arrays dealt by hash, to the tasks that compare
flushes; back come the numbers of the repeated ones. A hash that is in every
document therefore costs a task one entry for each flush, not one for each
document. Hashes and their numbers cost about ten bytes of shuffle each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm._common import materialize, mix64, parts, rolling, text_batches

#: Hashes of a flush, at least, and packed arrays for each shuffle partition.
FLUSH, PARTS = 600_000, 8
#: Bytes of text that are hashed at a time: their arrays fit a core's cache.
CHUNK = 100_000

_PACKED = pa.schema([("part", pa.int32()), ("flush", pa.int64()), ("hashes", pa.binary()), ("numbers", pa.binary()), ("docs", pa.binary())])
_PACKED_DDL = "part int, flush long, hashes binary, numbers binary, docs binary"


def anchors(values: np.ndarray, stop: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, anchor of each, hash of each anchor) for every window of ``width`` symbols.

    ``values`` are symbol hashes of several documents in a row and ``stop[i]``
    the end of the document of symbol i. The anchor of a window is the leftmost
    of its ``gram``-symbol spans with the least hash, so equal windows have equal
    anchors at equal places.
    """
    n = len(values)
    starts = np.flatnonzero(np.arange(n) + width <= stop)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    prefix = rolling(values)
    sums, down = prefix
    at = np.arange(n - gram + 1, dtype=np.int32)
    grams = mix64((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    span = width - gram + 1
    # running minimum of (hash, place) by doubling; the left one wins ties
    low, place, reach = grams, at, 1
    while reach < span:
        step = min(reach, span - reach)
        right = low[step:] < low[:-step]
        low, place, reach = np.where(right, low[step:], low[:-step]), np.where(right, place[step:], place[:-step]), reach + step
    return starts, place[starts].astype(np.int64), low[starts]


def text_symbols(texts: list[bytes], by_word: bool) -> tuple[np.ndarray, np.ndarray]:
    """Symbol hashes (words, or bytes) of some texts in a row, and the end of each text."""
    if by_word:
        codes: dict[bytes, int] = {}
        words = [t.split() for t in texts]
        flat = np.fromiter((codes.setdefault(w, len(codes)) for ws in words for w in ws), np.int64)
        named = np.fromiter((_word_hash(w) for w in codes), np.uint64, len(codes))
        return (named[flat] if len(flat) else np.zeros(0, np.uint64)), np.cumsum([len(ws) for ws in words])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    return _BYTE[raw], np.cumsum([len(t) for t in texts])


def _word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

#: A unit of hashing: (ids, texts, further column values) -> (hashes, doc index of each hash); hashes have 64 bits, or two columns of 64.
Hasher = Callable[[list, list[bytes], list], tuple[np.ndarray, np.ndarray]]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and h, a hash of the text, of rows with an id: id and h tell rows with one id apart, and only equal rows share both."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).filter("doc_id is not null")


def _sorted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by hash, where a new hash begins in it, and where each hash's first place is."""
    order = np.argsort(hashes, kind="stable") if hashes.ndim == 1 else np.lexsort((hashes[:, 1], hashes[:, 0]))
    h = hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1] if h.ndim == 1 else (h[1:] != h[:-1]).any(axis=1)
    return order, new, np.flatnonzero(new)


def repeated(docs: DataFrame, hasher: Hasher, across: bool, tag: str, width: int = 1) -> DataFrame:
    """Numbers of each document's repeated hashes: (doc_id, h, numbers: packed unsigned 32-bit).

    ``docs`` has doc_id, text, h (see ``keyed``) and maybe a column for the
    hasher, which gives hashes of ``width`` times 64 bits in document order; they
    are numbered from 0 in each document. Repeated: found in another row
    (``across``), or anywhere else. Equal rows share one row of the result: all
    their hashes are repeated, so it is the same for each.
    """
    spark = docs.sparkSession
    n_parts = PARTS * parts(spark)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, k = TaskContext.get().partitionId(), 0
        size, held = 0, []  # held: hashes, document of each, ids
        for batch in batches:
            at = 0
            for ids, texts in text_batches(batch, CHUNK):
                more = batch.column(3).slice(at, len(ids)).to_pylist() if batch.num_columns > 3 else []
                keys = np.stack([np.array(ids, np.int64), np.asarray(batch.column(2).slice(at, len(ids)))], axis=1)
                at += len(ids)
                held.append((*hasher(ids, [t.encode() for t in texts], more), keys))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield from flush(held, (where << 24) + k)
                    size, held, k = 0, [], k + 1
        if held:
            yield from flush(held, (where << 24) + k)

    def flush(held: list, name: int) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate([h for h, _, _ in held])
        if not len(hashes):
            return
        shift = np.cumsum([0, *(len(keys) for _, _, keys in held[:-1])])
        of = np.concatenate([d + s for (_, d, _), s in zip(held, shift)])
        keys = np.concatenate([own for _, _, own in held])
        order, new, first = _sorted(hashes)
        group = np.cumsum(new) - 1
        last = np.append(first[1:], len(order)) - 1
        again = (of[order[first]] != of[order[last]]) if across else (last > first)
        settled = again[group]
        sent = order[~settled | new]
        sent.sort()
        part = ((hashes if hashes.ndim == 1 else hashes[:, 0])[sent] >> np.uint64(20)) % np.uint64(n_parts)
        by = np.argsort(part, kind="stable")
        sent, part = sent[by], part[by]
        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ends = np.append(cuts[1:], len(sent))
        counts = np.bincount(of, minlength=len(keys))
        rows = [(int(part[a]), name, hashes[sent[a:b]].tobytes(), np.diff(sent[a:b], prepend=0).astype(np.uint32).tobytes(), None) for a, b in zip(cuts, ends)]
        own = np.sort(order[settled]).astype(np.uint32).tobytes()
        rows.append((-1, name, None, own, np.column_stack([keys, counts]).astype(np.int64).tobytes()))
        for a in range(0, len(rows), 2_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 2_000]), _PACKED.types)], schema=_PACKED)

    packed = materialize(docs.mapInArrow(collect, _PACKED_DDL), f"{tag}_hashes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if row[0] != part and held:
                    yield from settle(held)
                    held = []
                part = row[0]
                held.append(row)
        if held:
            yield from settle(held)

    def settle(held: list) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate([np.frombuffer(r[2], np.uint64) for r in held])
        sizes = [len(r[2]) // (8 * width) for r in held]
        of = np.repeat(np.arange(len(held)), sizes)
        order, new, first = _sorted(hashes if width == 1 else hashes.reshape(-1, width))
        last = np.append(first[1:], len(order)) - 1
        again = np.zeros(len(order), bool)  # the same hash from two flushes
        again[order] = (of[order[first]] != of[order[last]])[np.cumsum(new) - 1]
        ends = np.cumsum(sizes)
        out = []
        for row, a, b in zip(held, ends - sizes, ends):
            numbers = np.cumsum(np.frombuffer(row[3], np.uint32).astype(np.int64))[again[a:b]]
            if len(numbers):
                out.append((row[1], numbers.astype(np.uint32).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary()))], names=["flush", "numbers"])

    found = packed.filter("part >= 0").select("part", "flush", "hashes", "numbers").repartition(parts(spark), "part").sortWithinPartitions("part", "flush").mapInArrow(compare, "flush long, numbers binary")
    found = found.union(packed.filter("part < 0").select("flush", "numbers")).groupBy("flush").agg(F.collect_list("numbers").alias("numbers"))
    owners = packed.filter("part < 0").select("flush", "docs")

    def hand_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs_, lists in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, hs, counts = np.frombuffer(docs_, np.int64).reshape(-1, 3).T
                ends = np.cumsum(counts)
                numbers = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in lists])).astype(np.int64)
                a = np.searchsorted(numbers, ends - counts)
                b = np.searchsorted(numbers, ends)
                has = np.flatnonzero(b > a)
                if len(has):
                    own = [(numbers[a[i] : b[i]] - (ends[i] - counts[i])).astype(np.uint32).tobytes() for i in has]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(hs[has]), pa.array(own, pa.binary())], names=["doc_id", "h", "numbers"])

    rows = owners.join(found, "flush").select("docs", "numbers").mapInArrow(hand_out, "doc_id long, h long, numbers binary")
    return materialize(rows.groupBy("doc_id", "h").agg(F.first("numbers").alias("numbers")), f"{tag}_repeated")
