"""Interpolated modified Kneser-Ney language model: counted by Spark, kept in sorted hash arrays, mapped by the workers that score.

Counting goes down from the longest n-grams. Map tasks count the distinct
n-grams of some megabytes of text and deal them, packed, by range of their hash;
so a frequent n-gram is one entry for each map task and no shard is hot. The task
of a shard sums them, writes the shard's arrays, and deals what the next shorter
length needs: of each n-gram's ending how many n-grams end so (continuation
counts), and of each n-gram's beginning how often it goes on, and with how many
n-grams that occur once, twice, or more often. Only sums over a whole length
(counts of counts, totals) come to the driver.

A shard's arrays are raw little-endian files in the shared folder, sorted by the
64-bit hash. Workers map them and look up the sorted distinct n-grams of a few
megabytes of text, shard by shard in ascending order. Mapped pages belong to the
system's cache, not to the heap of a worker.
"""

from __future__ import annotations

import functools
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidemark.llm._common import BASE, materialize, mix64, parts, scratch_dir
from tidemark.llm._repeats import text_symbols

#: Words of the longest n-grams that the query counts.
ORDER = 2
#: Bytes of text that are counted, and scored, at a time.
COUNT_BYTES, SCORE_BYTES = 24_000_000, 8_000_000
#: Hashes of the mark before a text and of the one behind it; those of words are xxh3.
START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x27D4EB2F165667C5)
#: Discounts where the counts of counts give none.
FALLBACK = (0.5, 1.0, 1.5)
#: What a shard knows of an n-gram: its own count, how often it is in the texts, and of what follows it: sum of counts, n-grams of count 1, 2, and 3 or more.
STATS = ("count", "raw", "follow", "once", "twice", "more")


def lengthened(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of an n-gram with one more word behind it."""
    return mix64(key * np.uint64(BASE) + word)


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a hash: ranges of equal width."""
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _key(words: np.ndarray) -> np.ndarray:
    key = words[:, 0]
    for k in range(1, words.shape[1]):
        key = lengthened(key, words[:, k])
    return key


def _sums(key: np.ndarray, stats: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each distinct key is first, in ascending order of keys, and its sums."""
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]) != 0) if len(key) else np.zeros(0, np.int64)
    return order[new], [np.add.reduceat(s[order], new) if len(new) else s[:0] for s in stats]


def _planes(values: np.ndarray) -> bytes:
    """Unsigned integers byte by byte, the lowest of all first, so that equal high bytes stand together."""
    width = values.dtype.itemsize
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes()


def _unplanes(data: memoryview, dtype, n: int) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, n).T).view(dtype).reshape(n)


def pack(words: np.ndarray, stats: list[np.ndarray]) -> bytes:
    """n-grams (a row of word hashes each) and their sums, the words numbered within the block."""
    known, ids = np.unique(words, return_inverse=True)
    ids = ids.reshape(words.shape).astype(np.uint32)
    order = np.lexsort(ids.T[::-1])
    ids = ids[order]
    ids[1:, 0] -= ids[:-1, 0].copy()  # ascending
    gaps = np.diff(known, prepend=known[:1])
    body = [known[:1].tobytes(), _planes(gaps), *[_planes(np.ascontiguousarray(ids[:, k])) for k in range(words.shape[1])], *[_planes(s[order].astype(np.uint64)) for s in stats]]
    return struct.pack("<IIII", len(known), len(words), words.shape[1], len(stats)) + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def unpack(block: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    n_known, n, width, n_stats = struct.unpack_from("<IIII", block)
    data = memoryview(zstandard.ZstdDecompressor().decompress(memoryview(block)[16:]))
    at = 0

    def take(dtype, count: int) -> np.ndarray:
        nonlocal at
        size = np.dtype(dtype).itemsize * count
        at += size
        return _unplanes(data[at - size : at], dtype, count)

    first = take(np.uint64, min(1, n_known))
    known = np.cumsum(take(np.uint64, n_known), dtype=np.uint64) + (first[0] if len(first) else np.uint64(0))
    ids = np.stack([take(np.uint32, n) for _ in range(width)], axis=1)
    ids[:, 0] = np.cumsum(ids[:, 0])
    return known[ids], [take(np.uint64, n) for _ in range(n_stats)]


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[bytes]]]:
    """Rows without their text, and the lower-case texts in UTF-8, some ``most`` bytes at a time; the text is the last column."""
    rows, texts, size = [], [], 0
    for batch in batches:
        for *row, text in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append(row)
            texts.append((text or "").encode().lower())  # of bytes, A-Z only
            size += len(texts[-1])
            if size >= most:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def padded(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, each behind order - 1 start marks and before an end mark; where the words and end marks are; how many each text has."""
    values, ends = text_symbols(texts, by_word=True)
    sizes = np.diff(ends, prepend=0)
    whole = sizes + order
    last = np.cumsum(whole)
    flat = np.full(int(last[-1]) if len(last) else 0, START, np.uint64)
    scored = np.ones(len(flat), bool)
    for k in range(order - 1):
        scored[last - whole + k] = False
    at = np.flatnonzero(scored)
    is_end = np.zeros(len(flat), bool)
    is_end[last - 1] = True
    flat[at[~is_end[at]]] = values
    flat[last - 1] = END
    return flat, at, sizes + 1


def _dealt(words: np.ndarray, key: np.ndarray, stats: list[np.ndarray], shards: int) -> Iterator[tuple[int, bytes]]:
    """Blocks by shard; ``key`` is ascending."""
    ends = np.searchsorted(shard_of(key, shards), np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(ends)):
        part = slice(ends[s], ends[s + 1])
        yield int(s), pack(words[part], [x[part] for x in stats])


_BLOCKS = "shard int, kind int, block binary"


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], names=names)


def counted(docs: DataFrame, order: int, shards: int) -> DataFrame:
    """Packed counts of the longest n-grams of the column text: shard, kind, block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _chunks(batches, COUNT_BYTES):
            flat, at, _ = padded(texts, order)
            words = np.stack([flat[at - (order - 1) + k] for k in range(order)], axis=1)
            key = _key(words)
            first, (n,) = _sums(key, [np.ones(len(key), np.uint64)])
            for s, block in _dealt(words[first], key[first], [n, n], shards):
                yield _batch([(s, 0, block)], [pa.int32(), pa.int32(), pa.binary()], ["shard", "kind", "block"])

    return docs.select("text").mapInArrow(count, _BLOCKS)


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


#: One row for a shard's arrays (kind -1), with its sums; else a block for the next shorter length.
_LEVEL = "shard int, kind int, block binary, path string, sizes array<long>, sums array<long>"
_LEVEL_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def _reduced(folder: str, length: int, top: bool, shards: int) -> Callable:
    """The work of a shard: its blocks to arrays, sums, and blocks for length - 1. Kind 0 has counts, kind 1 what follows."""

    def reduce(table: pa.Table) -> pa.Table:
        words, stats = [], []
        for kind, block in zip(table["kind"].to_pylist(), table["block"].to_pylist()):
            w, s = unpack(block)
            zero = np.zeros(len(w), np.uint64)
            words.append(w)
            stats.append([*s, zero, zero, zero, zero] if kind == 0 else [zero, zero, *s])
        words = np.concatenate(words)
        key = _key(words)
        first, stats = _sums(key, [np.concatenate(c) for c in zip(*stats)])
        words, key = words[first], key[first]
        count, raw = stats[:2]
        if top:  # most are seen once: these need no count beside the hash
            once = count == 1
            arrays = [key[once], key[~once], count[~once]]
        else:
            arrays = [key, *stats]
        path = f"{length}-{table['shard'][0].as_py():06d}-{uuid.uuid4().hex}"
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{path}", compression=None) as out:
            for x in arrays:
                out.write(x.astype("<u8").tobytes())
        n = [int((count == k).sum()) for k in (1, 2, 3, 4)]
        sums = [*n, int((count >= 3).sum()), int((count > 0).sum()), int(count.sum()), int(raw.sum())]
        rows = [(table["shard"][0].as_py(), -1, None, path, [len(x) for x in arrays], sums)]
        if length > 1:
            own = count > 0
            words, count, raw = words[own], count[own], raw[own]
            key = _key(words[:, 1:])
            first, cont = _sums(key, [np.ones(len(key), np.uint64), raw])
            rows += [(s, 0, b, None, None, None) for s, b in _dealt(words[first, 1:], key[first], cont, shards)]
            key = _key(words[:, :-1])
            first, follow = _sums(key, [count, *[x.astype(np.uint64) for x in (count == 1, count == 2, count >= 3)]])
            rows += [(s, 1, b, None, None, None) for s, b in _dealt(words[first, :-1], key[first], follow, shards)]
        return pa.Table.from_batches([_batch(rows, _LEVEL_TYPES, ["shard", "kind", "block", "path", "sizes", "sums"])])

    return reduce


class Model:
    """Where the arrays are and the few numbers of each length. ``files`` by length and shard: path and array sizes, or nothing."""

    def __init__(self, folder: str, order: int, shards: int, files: dict[int, list], sums: dict[int, list[int]]):
        self.folder, self.order, self.shards, self.files, self.sums = folder, order, shards, files, sums
        self.discounts = {k: discounts(v) for k, v in sums.items()}
        self.tokens, self.words = sums[1][7], sums[1][5]

    def find(self, length: int, key: np.ndarray) -> list[np.ndarray]:
        """The stats of each hash of ``key``, ascending and distinct: of the longest n-grams the count only."""
        top = length == self.order
        out = [np.zeros(len(key)) for _ in range(1 if top else len(STATS))]
        ends = np.searchsorted(shard_of(key, self.shards), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(ends)):
            if not self.files[length][s]:
                continue
            path, sizes = self.files[length][s]
            arrays = opened(self.folder, path, tuple(sizes))
            part = slice(ends[s], ends[s + 1])
            if top:
                out[0][part] = _held(arrays[0], key[part]).astype(float) if len(arrays[0]) else 0
                where, hit = _place(arrays[1], key[part])
                out[0][part][hit] = arrays[2][where[hit]]
            else:
                where, hit = _place(arrays[0], key[part])
                for o, x in zip(out, arrays[1:]):
                    o[part][hit] = x[where[hit]]
        return out


def _place(have: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    where = np.searchsorted(have, want)
    where[where == len(have)] = 0
    return where, have[where] == want if len(have) else np.zeros(len(want), bool)


def _held(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    return _place(have, want)[1]


@functools.lru_cache(maxsize=4_096)
def _mapped(folder: str, path: str, total: int) -> np.ndarray:
    store, root = _store(folder)
    if store.type_name == "local":
        return np.memmap(f"{root}/{path}", "<u8", "r", shape=(total,)) if total else np.zeros(0, np.uint64)
    return np.zeros(0, np.uint64)


def opened(folder: str, path: str, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """The arrays of a shard: mapped, or where the shared folder is not a mounted one, read for this use (a shard is bounded)."""
    total = sum(sizes)
    data = _mapped(folder, path, total)
    if len(data) < total:
        store, root = _store(folder)
        with store.open_input_file(f"{root}/{path}") as f:
            data = np.frombuffer(f.read(), "<u8")
    return np.split(data, np.cumsum(sizes)[:-1])


def discounts(sums: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2, and 3 or more, from n-grams of count 1, 2, 3, 4."""
    n = sums[:4]
    if not all(n):
        return FALLBACK
    y = n[0] / (n[0] + 2 * n[1])
    out = tuple(k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3))
    return out if all(0 <= d <= k + 1 for k, d in enumerate(out)) else FALLBACK


def trained(docs: DataFrame, order: int = ORDER, shards: int = 0) -> Model:
    """A model of the column text of ``docs`` with n-grams of ``order`` words, two or more. Eager: its arrays are written when it returns."""
    if order < 2:
        raise ValueError(f"order {order}: two or more")
    spark = docs.sparkSession
    shards = shards or parts(spark)
    folder = scratch_dir(spark) + "/ngrams"
    files, sums = {}, {}
    blocks = counted(docs, order, shards)
    for length in range(order, 0, -1):
        work = _reduced(folder, length, length == order, shards)
        done = materialize(blocks.groupBy("shard").applyInArrow(work, _LEVEL), f"length_{length}")
        made = done.filter("kind = -1").select("shard", "path", "sizes", "sums").collect()  # one row for each shard
        files[length] = [None] * shards
        for r in made:
            files[length][r["shard"]] = (r["path"], r["sizes"])
        sums[length] = [sum(x) for x in zip(*(r["sums"] for r in made))] or [0] * 8
        blocks = done.filter("kind >= 0").select("shard", "kind", "block")
    return Model(folder, order, shards, files, sums)


def _looked_up(model: Model, length: int, key: np.ndarray) -> list[np.ndarray]:
    distinct, back = np.unique(key, return_inverse=True)
    return [x[back] for x in model.find(length, distinct)]


def log_probabilities(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token of lower-case texts: log10 of the model's probability, its count in training, and tokens of each text."""
    flat, at, sizes = padded(texts, model.order)
    p = np.full(len(at), 1 / (model.words + 1))
    key, follow, raw = flat, None, None
    for length in range(1, model.order + 1):
        d = model.discounts[length]
        found = _looked_up(model, length, key[at])
        count = found[0]
        kept = np.maximum(count - np.select([count >= 3, count == 2, count == 1], [d[2], d[1], d[0]], 0.0), 0)
        if length == 1:
            n, raw = model.sums[1], found[1]
            total, once, twice, more = (np.full(len(at), float(x)) for x in (n[6], n[0], n[1], n[4]))
        else:
            total, once, twice, more = follow
        seen = total > 0
        safe = np.where(seen, total, 1)
        p = np.where(seen, kept / safe + (d[0] * once + d[1] * twice + d[2] * more) / safe * p, p)
        if length < model.order:
            # what follows the n-gram that ends one place before; start marks have places of their own
            follow = _looked_up(model, length, key[at - 1])[2:]
            longer = np.zeros_like(key)
            longer[1:] = lengthened(key[:-1], flat[1:])
            key = longer
    return np.log10(p), raw, sizes


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Scores of ``docs`` (doc_id, held_out, text) under ``model``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = [x.split()[0] for x in SCORES.split(", ")]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for rows, texts in _chunks(batches, SCORE_BYTES):
            logs, raw, sizes = log_probabilities(model, texts)
            base = np.log10((raw + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
            starts = np.cumsum(sizes) - sizes
            added = [np.add.reduceat(x, starts).tolist() for x in ((raw > 0).astype(np.int64), base, logs)]
            ids, held = zip(*rows)
            yield _batch(list(zip(ids, held, sizes.tolist(), added[0], [model.tokens] * len(ids), added[1], added[2])), types, schema)

    return docs.select("doc_id", "held_out", "text").mapInArrow(work, SCORES)


def score_documents(docs: DataFrame, order: int = ORDER, folds: int = 5, held: int = 1) -> DataFrame:
    """Scores of all rows of ``docs`` (doc_id, text) by a model of those whose id's crc32 modulo ``folds`` is not ``held``.

    Tokens are words, A-Z in lower case, then one end of text. A null text is
    empty: one token. A null id counts as an empty one (crc32 of 0), so its rows
    are learnt from. Repeated rows are documents of their own. Without training
    documents every token has probability 1 / (V + 1) = 1, a score of 0. An
    empty table gives an empty result. Other columns are not looked at.
    """
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.crc32(named) % folds == held).alias("held_out"), "text")
    return scored(rows, trained(rows.filter("not held_out"), order))
