"""Removing byte strings that an earlier document has, by distributed prefix doubling.

The positions to be ranked are thinned out first: a 50-byte string can only be
in two documents if its anchor (the least hash among its 16-byte spans) is, so
positions under other anchors are unique from the start. The rest is dealt by
anchor, each with the bytes around it, so that equal strings meet in one
partition. There strings whose hash is in one context only drop out, since they
are in no other. Positions of the rest are ranked by their first eight bytes, and
ranks are paired at growing offsets (8, 16, ... up to the threshold) and ranked
anew. Ranks compare bytes, so no hash decides what is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm._common import materialize, parts, rolling, span_hash, text_batches
from tidemark.llm._repeats import _BYTE, CHUNK, anchors, keyed, repeated, text_symbols

#: Bytes of a string, and of the spans that its anchor is chosen from.
WIDTH, GRAM = 50, 16
#: Bytes of context in a flush, and packed arrays for each shuffle partition.
FLUSH, PARTS = 12_000_000, 4

_PACKED = pa.schema([("part", pa.int32()), ("docs", pa.binary()), ("hs", pa.binary()), ("starts", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary())])
_PACKED_DDL = "part int, docs binary, hs binary, starts binary, sizes binary, bytes binary"
_GONE_DDL = "doc_id long, h long, runs binary"


def _runs(texts: list[bytes], width: int, gram: int):
    """Runs of windows with one anchor: first window, number of windows, anchor hash, text index; and the text bounds."""
    values, ends = text_symbols(texts, by_word=False)
    sizes = np.diff(ends, prepend=0)
    starts, place, low = anchors(values, np.repeat(ends, sizes), width, gram)
    of = np.repeat(np.arange(len(texts)), sizes)
    new = np.ones(len(starts), bool)
    # a run also ends where a text is too short to carry it on
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    return starts[at], count, low[at], of[starts[at]], ends, sizes


def double(context: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Ranks of the ``width``-byte strings at ``starts``, equal for equal strings, by prefix doubling."""
    n = len(context)
    reach = 1
    name = context.astype(np.int64)
    while reach < min(8, width):  # the first eight bytes are packed into one integer
        step = min(reach, width - reach, 8 - reach)
        name = np.left_shift(name[: n - reach - step + 1].astype(np.uint64), np.uint64(8 * step)) | (name[step : n - reach + 1].astype(np.uint64) & np.uint64(2 ** (8 * step) - 1))
        reach += step
    name = np.unique(name, return_inverse=True)[1].astype(np.int64)
    while reach < width:
        step = min(reach, width - reach)
        pair = name[: n - reach - step + 1] * (int(name.max()) + 1) + name[step : n - reach + 1]
        reach += step
        if reach >= width:
            return np.unique(pair[starts], return_inverse=True)[1]
        name = np.unique(pair, return_inverse=True)[1]
    return name[starts]


def _in_several(context: np.ndarray, of: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """Which strings may be in several contexts: those whose hash is. Others cannot be, whatever hashes collide."""
    hashes = np.empty(len(place), np.uint64)
    for a in range(0, len(place), CHUNK * 10):
        b = min(a + CHUNK * 10, len(place))
        at = int(place[a])
        prefix = rolling(_BYTE[context[at : int(place[b - 1]) + width]])
        hashes[a:b] = span_hash(prefix, place[a:b] - at, place[a:b] - at + width)
    order = np.argsort(hashes)
    h = hashes[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    owners = of[order]
    several = np.minimum.reduceat(owners, first) != np.maximum.reduceat(owners, first)
    out = np.empty(len(place), bool)
    out[order] = np.repeat(several, np.diff(np.append(first, len(place))))
    return out


def settle(docs: np.ndarray, starts: np.ndarray, counts: np.ndarray, contexts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries, starts and ends of the byte runs whose windows start in a smaller document too.

    Entry i holds ``counts[i]`` windows of document ``docs[i]``, from byte
    ``starts[i]`` on, whose bytes are ``contexts[i]``. Equal contexts are ranked
    once: all but those of the smallest document that has them are gone whole.
    """
    ids: dict[bytes, int] = {}
    kind = np.fromiter((ids.setdefault(c, len(ids)) for c in contexts), np.int64, len(contexts))
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, docs)
    lens = np.fromiter(map(len, ids), np.int64, len(ids))
    whole = np.frombuffer(b"".join(ids), np.uint8)
    wins = lens - width + 1
    first = np.cumsum(wins) - wins
    of = np.repeat(np.arange(len(ids)), wins)
    place = np.arange(len(of)) - first[of] + (np.cumsum(lens) - lens)[of]
    gone = np.zeros(len(of), bool)
    shared = _in_several(whole, of, place, width)
    if shared.any():
        # only contexts with such windows are ranked
        has = np.zeros(len(ids), bool)
        has[of[shared]] = True
        part = whole[np.repeat(has, lens)]
        shift = (np.cumsum(lens) - lens) - (np.cumsum(lens * has) - lens * has)
        rank = double(part, place[shared] - shift[of[shared]], width)
        owner = least[of[shared]]
        lowest = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(lowest, rank, owner)
        gone[shared] = lowest[rank] < owner  # a smaller document has the window
    same = of[1:] == of[:-1]
    a = np.flatnonzero(gone & ~np.append(False, gone[:-1] & same))
    b = np.flatnonzero(gone & ~np.append(gone[1:] & same, False))
    run_of = of[a]
    a, b = a - first[run_of], b - first[run_of] + width
    times = np.bincount(run_of, minlength=len(ids))
    copy = docs > least[kind]
    own = np.flatnonzero(~copy)
    n = times[kind[own]]
    at = np.arange(int(n.sum())) + np.repeat((np.cumsum(times) - times)[kind[own]] - (np.cumsum(n) - n), n)
    own = np.repeat(own, n)
    return np.append(np.flatnonzero(copy), own), np.concatenate([starts[copy], starts[own] + a[at]]), np.concatenate([starts[copy] + counts[copy] + width - 1, starts[own] + b[at]])


def _by_document(docs: np.ndarray, hs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """One row of packed bounds for each document."""
    order = np.lexsort((starts, hs, docs))
    docs, hs, pairs = docs[order], hs[order], np.stack([starts[order], ends[order]], axis=1).astype(np.int64)
    cuts = np.flatnonzero(np.append(True, (docs[1:] != docs[:-1]) | (hs[1:] != hs[:-1]))) if len(docs) else np.zeros(0, np.int64)
    offsets = np.append(cuts, len(docs)).astype(np.int32) * 16
    runs = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(pairs.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(docs[cuts], pa.int64()), pa.array(hs[cuts], pa.int64()), runs], names=["doc_id", "h", "runs"])


def earlier_strings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Byte ranges of each document whose strings start in a document with a smaller id: doc_id, h, runs (packed 64-bit pairs, end exclusive)."""
    slim = keyed(docs)
    spark = docs.sparkSession
    n_parts = PARTS * parts(spark)

    def by_anchor(ids: list, texts: list[bytes], _: list):
        _, _, low, of, *_ = _runs(texts, width, gram)
        return low, of

    maybe = repeated(slim, by_anchor, True, "byte_anchors")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            at = 0
            for ids, texts in text_batches(batch, CHUNK):
                hs = batch.column(2).slice(at, len(ids)).to_pylist()
                flagged = batch.column(3).slice(at, len(ids)).to_pylist()
                at += len(ids)
                raws = [t.encode() for t in texts]
                starts, count, low, of, ends, sizes = _runs(raws, width, gram)
                first = np.searchsorted(of, np.arange(len(ids)))
                for i, f in enumerate(flagged):
                    j = first[i] + np.frombuffer(f, np.uint32)
                    a = starts[j] - (ends[i] - sizes[i])
                    b = a + count[j] + width - 1
                    raw, doc, h = raws[i], ids[i], hs[i]
                    held += [(p, raw[x:y], doc, h, x) for p, x, y in zip(((low[j] >> np.uint64(20)) % np.uint64(n_parts)).tolist(), a.tolist(), b.tolist())]
                    size += int((b - a).sum())
                if size >= FLUSH:
                    yield from pack(held)
                    held, size = [], 0
        if held:
            yield from pack(held)

    def pack(held: list) -> Iterator[pa.RecordBatch]:
        # within a flush only the smallest document that has a context passes it on; later ones lose it here
        least: dict[bytes, int] = {}
        for _, c, d, _, _ in held:
            if least.setdefault(c, d) > d:
                least[c] = d
        gone: dict[tuple[int, int], list[int]] = {}
        by: dict[int, list[tuple[int, int, int, bytes]]] = {}
        for p, c, d, h, a in held:
            if d > least[c]:
                gone.setdefault((d, h), []).extend((a, a + len(c)))
            else:
                by.setdefault(p, []).append((d, h, a, c))
        packed = lambda xs, k, t: np.array([x[k] for x in xs], t).tobytes()
        rows = [(p, packed(xs, 0, np.int64), packed(xs, 1, np.int64), packed(xs, 2, np.uint32), np.array([len(x[3]) for x in xs], np.int32).tobytes(), b"".join(x[3] for x in xs)) for p, xs in by.items()]
        rows += [(-1, np.array([d], np.int64).tobytes(), np.array([h], np.int64).tobytes(), None, None, np.array(xs, np.int64).tobytes()) for (d, h), xs in gone.items()]
        for k in range(0, len(rows), 2_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 2_000]), _PACKED.types)], schema=_PACKED)

    packed = materialize(slim.join(maybe, ["doc_id", "h"]).select("doc_id", "text", "h", "numbers").mapInArrow(contexts, _PACKED_DDL), "contexts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if row[0] != part and held:
                    yield told(held)
                    held = []
                part = row[0]
                held.append(row)
        if held:
            yield told(held)

    def told(held: list) -> pa.RecordBatch:
        docs_, hs = (np.concatenate([np.frombuffer(r[k], np.int64) for r in held]) for k in (1, 2))
        starts = np.concatenate([np.frombuffer(r[3], np.uint32) for r in held]).astype(np.int64)
        sizes = np.concatenate([np.frombuffer(r[4], np.int32) for r in held]).astype(np.int64)
        cuts = np.cumsum(sizes)
        whole = b"".join(r[5] for r in held)
        entry, a, b = settle(docs_, starts, sizes - width + 1, [whole[y - n : y] for y, n in zip(cuts.tolist(), sizes.tolist())], width)
        return _by_document(docs_[entry], hs[entry], a, b)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs = ([int(np.frombuffer(x, np.int64)[0]) for x in batch.column(k).to_pylist()] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), batch.column(2)], names=["doc_id", "h", "runs"])

    met = packed.filter("part >= 0").repartition(parts(spark), "part").sortWithinPartitions("part").mapInArrow(compare, _GONE_DDL)
    met = met.union(packed.filter("part < 0").select("docs", "hs", "bytes").mapInArrow(local, _GONE_DDL))
    return materialize(met, "runs")


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_earlier(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Each document without the bytes of strings that start in a document with a smaller id.

    Returned per row of ``docs`` (doc_id, text; other columns are left alone):
    doc_id, n_bytes of the UTF-8 text, n_removed, n_spans (maximal removed
    runs), kept_sha256 and kept, the remaining bytes, which may end inside a
    character. A null text is empty; a null id neither loses nor removes
    anything. Rows with one id remove nothing from each other. Texts of under ``width`` bytes lose nothing. An empty
    table gives an empty result.
    """
    runs = earlier_strings(docs, width, gram).groupBy("doc_id", "h").agg(F.collect_list("runs").alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, texts in text_batches(batch):
                marks = batch.column(3).slice(at, len(ids)).to_pylist()
                at += len(ids)
                rows = []
                for doc_id, text, mark in zip(ids, texts, marks):
                    raw = text.encode()
                    spans = 0
                    kept = raw
                    if mark:
                        ab = np.concatenate([np.frombuffer(x, np.int64) for x in mark]).reshape(-1, 2)
                        ab = np.minimum(ab, len(raw))
                        edge = np.zeros(len(raw) + 1, np.int64)
                        np.add.at(edge, ab[:, 0], 1)
                        np.add.at(edge, ab[:, 1], -1)
                        gone = np.cumsum(edge)[:-1] > 0
                        spans = int((np.diff(gone.astype(np.int8), prepend=0) > 0).sum())
                        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    rows.append((doc_id, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(runs, ["doc_id", "h"], "left")
    return rows.select("doc_id", "text", "h", "runs").mapInArrow(cut, SCHEMA)
