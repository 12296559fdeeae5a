"""Token ids in sorted-string-table shards.

A shard holds documents in ascending id order. File layout:

    blocks   entries (shared, own, value length: varints; rest of the key; value),
             each key given by what it does not share with the key before it
    index    one entry per block: first key, offset, length, crc32
    bloom    bits over all keys
    footer   fixed size: offsets and lengths of index and bloom, counts, magic

Keys are the ids as eight big-endian bytes with the sign bit flipped, so that
byte order is number order; a null id is the empty key, before all others.
Values are ids of 16 bits each where the vocabulary allows, else of 32.
``lookup`` reads the footer, asks the Bloom filter, finds the block by binary
search in the index and decodes that block only.
"""

from __future__ import annotations

import functools
import re
import struct
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.llm._common import materialize, parts, scratch_dir

#: Bytes of a block and of a shard, after which a new one begins; bits for each key of the Bloom filter, and its hashes.
BLOCK, SHARD, BLOOM_BITS, BLOOM_HASHES = 32_768, 8_000_000, 10, 7
_MAGIC = b"TMSST001"
_FOOTER = struct.Struct("<QIQIQQIII8s")  # index offset, length; bloom offset, length; entries; tokens; id width; block count; crc of index and bloom; magic
#: Words whose ids a worker keeps at most; letters that are encoded at a time; ids looked up at a time.
CACHE, CHUNK, LOOKUP = 1_000_000, 4_000_000, 1_000_000


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + 2**63) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - 2**63 if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, pos: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[pos]
        n, pos, shift = n | (b & 127) << shift, pos + 1, shift + 7
        if b < 128:
            return n, pos


class Shard:
    """Collects sorted (key, value) pairs into one shard."""

    def __init__(self, width: int):
        self.width, self.out, self.block, self.index, self.keys = width, bytearray(), bytearray(), [], []
        self.last, self.first, self.tokens = b"", b"", 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.tokens = key, self.tokens + len(value) // self.width
        self.keys.append(key)
        if len(self.block) >= BLOCK:
            self._close_block()

    def _close_block(self) -> None:
        if self.block:
            self.index.append((self.first, len(self.out), len(self.block), zlib.crc32(self.block)))
            self.out += self.block
            self.block = bytearray()

    def size(self) -> int:
        return len(self.out) + len(self.block)

    def finish(self) -> bytes:
        self._close_block()
        index = b"".join(_varint(len(k)) + k + _varint(off) + _varint(n) + struct.pack("<I", crc) for k, off, n, crc in self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = bytearray(-(-bits // 8))
        for key in self.keys:
            for b in _bloom_bits(key, len(bloom) * 8):
                bloom[b >> 3] |= 1 << (b & 7)
        at = len(self.out)
        foot = _FOOTER.pack(at, len(index), at + len(index), len(bloom), len(self.keys), self.tokens, self.width, len(self.index), zlib.crc32(bloom, zlib.crc32(index)), _MAGIC)
        return bytes(self.out) + index + bytes(bloom) + foot


def _bloom_bits(key: bytes, bits: int) -> Iterator[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return ((a + k * b) % bits for k in range(BLOOM_HASHES))


class Reader:
    """Reads one shard from its bytes or from an open file, of which only the footer, the index, the filter and wanted blocks are read."""

    def __init__(self, source: bytes | BinaryIO, size: int | None = None):
        self.source = source
        size = len(source) if isinstance(source, bytes) else size if size is not None else source.seek(0, 2)
        foot = self._at(size - _FOOTER.size, _FOOTER.size) if size >= _FOOTER.size else b""
        if foot[-8:] != _MAGIC:
            raise ValueError("not a shard: footer is missing")
        at, n, bloom_at, bloom_n, self.entries, self.tokens, self.width, blocks, crc, _ = _FOOTER.unpack(foot)
        both = self._at(at, n + bloom_n)
        index, self.bloom = both[:n], both[n:]
        if bloom_at != at + n or zlib.crc32(both) != crc:
            raise ValueError("damaged shard: index or Bloom filter does not have its checksum")
        self.first, self.where, pos = [], [], 0
        for _ in range(blocks):
            k, pos = _read_varint(index, pos)
            self.first.append(index[pos : pos + k])
            off, pos = _read_varint(index, pos + k)
            size, pos = _read_varint(index, pos)
            self.where.append((off, size, struct.unpack_from("<I", index, pos)[0]))
            pos += 4

    def _at(self, offset: int, size: int) -> bytes:
        if isinstance(self.source, bytes):
            return self.source[offset : offset + size]
        self.source.seek(offset)
        return self.source.read(size)

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        off, size, crc = self.where[i]
        data = self._at(off, size)
        if zlib.crc32(data) != crc:
            raise ValueError(f"damaged shard: block {i} does not have its checksum")
        key, pos = b"", 0
        while pos < len(data):
            shared, pos = _read_varint(data, pos)
            own, pos = _read_varint(data, pos)
            n, pos = _read_varint(data, pos)
            key = key[:shared] + data[pos : pos + own]
            yield key, data[pos + own : pos + own + n]
            pos += own + n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.where)):
            yield from self.block(i)

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.width == 2 else "<u4")

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids stored for a document, once for each row that had this id."""
        key = key_of(doc_id)
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bloom_bits(key, len(self.bloom) * 8)):
            return []
        i = max(bisect_right(self.first, key) - 1, 0)
        while i and self.first[i] == key:  # equal keys may begin in the block before
            i -= 1
        out = []
        while i < len(self.where) and self.first[i] <= key:
            out += [self.ids(v) for k, v in self.block(i) if k == key]
            i += 1
        return out


# -- tokens -------------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def _tokenizer(file: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


#: Bytes that are white space, and letters and digits before which this tokenizer's words do not end.
_SPACE, _ALNUM = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b" \t\n\r\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz0123456789"))
#: Words of these characters are in normal form as they are, and their lower case is that of each character.
_PLAIN = re.compile("[\x21-\x7e\u00a1-\u012f\u0131-\u017f]*")
#: Fixed value: what the tokenizer takes for a part of a word.
_PART = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class _Kept:
    """Ids by word: what was used lately stays when it is full, the rest goes."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, words: Iterable[str]) -> list[str]:
        """Those of some distinct words that are not kept; the others will stay."""
        if len(self.new) > CACHE // 2:
            self.new, self.old = {}, self.new
        new, old, out = self.new, self.old, []
        for w in words:
            if w not in new:
                if (x := old.get(w)) is not None:
                    new[w] = x
                else:
                    out.append(w)
        return out


_caches: dict[tuple[str, str], _Kept] = {}


@functools.cache
def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte from 128 on in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + hidden.index(b)) for b in hidden if b >= 128}


def _encode_new(words: list[str], file: str, kind: str) -> Iterator[tuple[str, bytes]]:
    """(word, packed ids) of each word.

    Plain words are cut into parts here and go to the tokenizer's model, which
    spares the normal forms of the whole way; all others take that.
    """
    tok = _tokenizer(file)
    model, code, letters = tok.model.tokenize, {"<u2": "H", "<u4": "I"}[kind], _byte_letters()
    other = []
    for w in words:
        if "<|" in w or not _PLAIN.fullmatch(w):
            other.append(w)
            continue
        low = w if w.isascii() else w.lower()
        ids = array(code)
        for part in (low,) if low.isalpha() else _PART.findall(low):
            ids.extend([t.id for t in model(part if part.isascii() else part.encode().decode("latin-1").translate(letters))])
        yield w, ids.tobytes()
    for w, e in zip(other, tok.encode_batch_fast(other, add_special_tokens=False)):
        yield w, np.array(e.ids, kind).tobytes()


def _words(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """The words of some texts, ASCII letters in lower case save in words that could hold a special token, and the end of each text among them.

    A full stop or comma behind a letter or digit and before white space is a
    word of its own, as it is for the tokenizer.
    """
    raws = [t.encode() for t in texts]
    raws = [r.lower() if b"<|" not in r else b" ".join(w if b"<|" in w else w.lower() for w in r.split()) for r in raws]
    data = np.frombuffer(b"\n".join([*raws, b""]), np.uint8)
    solid = ~_SPACE[data]
    begins = solid & np.append(True, ~solid[:-1])
    points = np.flatnonzero((data == 46) | (data == 44))
    points = points[(points > 0) & ~solid[np.minimum(points + 1, len(data) - 1)]]
    begins[points[_ALNUM[data[points - 1]]]] = True
    starts = np.flatnonzero(begins)
    letters = data[solid]
    offsets = np.append(np.cumsum(solid, dtype=np.int32)[starts] - 1, len(letters)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters))
    return words, np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raws]))


def encode_texts(texts: Iterable[str], file: str, kind: str) -> Iterator[bytes]:
    """Ids of each text as packed integers of numpy type ``kind``.

    For a tokenizer that drops white space, lower-cases, and never joins across
    white space. The words of about CHUNK bytes of text are numbered, each
    distinct one is looked up or encoded once, and the ids are gathered by number.
    """
    kept, width = _caches.setdefault((file, kind), _Kept()), int(kind[2:])

    def done(held: list[str]) -> Iterator[bytes]:
        words, last = _words(held)
        numbered = words.dictionary_encode()
        words = numbered.dictionary.to_pylist()
        missing = kept.missing(words)  # before kept.new is taken: this may put another in its place
        kept.new.update(_encode_new(missing, file, kind))
        packed = [*map(kept.new.__getitem__, words)]
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // width
        which = np.asarray(numbered.indices)
        counts = sizes[which]
        ends = np.cumsum(counts)
        # the ids of word i of the texts begin at first[which[i]] of all distinct words' ids
        first = np.cumsum(sizes) - sizes
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[which] - (ends - counts), counts)
        ids = np.frombuffer(b"".join(packed), kind)[at]
        bounds = np.append(0, np.append(0, ends)[last])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield ids[a:b].tobytes()

    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= CHUNK:
            yield from done(held)
            held, size = [], 0
    if held:
        yield from done(held)


def write_shards(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 1, vocabulary: int = 49_408) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write shards in ascending id order; the table of shards: file, seq, n_docs, n_tokens, first_id, last_id.

    ``seq`` orders the shards. Every document ends with ``end_id``; a null text
    is empty. Repeated ids are stored side by side. Eager.
    """
    width = 2 if vocabulary <= 65_536 else 4
    kind = f"<u{width}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(root, recursive=True)
        ctx = TaskContext.get()
        own = f"{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        end = np.array([end_id], kind).tobytes()
        shard, k = None, 0

        def close() -> pa.RecordBatch:
            name = f"{own}-{k:05d}.sst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(shard.finish())
            numbers = ((ctx.partitionId() << 24) + k, len(shard.keys), shard.tokens, id_of(shard.keys[0]), id_of(shard.keys[-1]))
            return pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([x], pa.int64()) for x in numbers)], names=["file", "seq", "n_docs", "n_tokens", "first_id", "last_id"])

        for batch in batches:
            texts = (batch.column(1)[i].as_py() or "" for i in range(batch.num_rows))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_texts(texts, tokenizer_file, kind)):
                shard = shard or Shard(width)
                shard.add(key_of(doc_id), ids + end)
                if shard.size() >= SHARD:
                    yield close()
                    shard, k = None, k + 1
        if shard is not None:
            yield close()

    rows = docs.select("doc_id", "text").repartitionByRange(parts(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(rows.mapInArrow(write, "file string, seq long, n_docs long, n_tokens long, first_id long, last_id long"), "shards")


def read_shards(spark, folder: str, shards: DataFrame, with_ids: bool = True) -> DataFrame:
    """All documents of the shards in order: doc_id, start (ids before it), n_tokens, ids_crc32 (over 32-bit ids) and, if wanted, ids."""
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = materialize(shards.withColumn("base", before).select("file", "base"), "bases")  # one row for each shard
    raw = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, start = Reader(batch.column(1)[i].as_py()), batch.column(0)[i].as_py()
                rows, size = [], 0
                for key, value in shard:
                    ids = shard.ids(value)
                    rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids))
                    start, size = start + len(ids), size + len(ids)
                    if size > 500_000:
                        yield _decoded(rows, with_ids)
                        rows, size = [], 0
                if rows:
                    yield _decoded(rows, with_ids)

    return raw.join(placed, "file").select("base", "content").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)))


def _decoded(rows: list, with_ids: bool) -> pa.RecordBatch:
    numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([*numbers, _lists([r[4] for r in rows])], names=[*names, "ids"]) if with_ids else pa.RecordBatch.from_arrays(numbers, names=names)


def lookup(spark, folder: str, shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """The stored rows of the ids in ``wanted`` (doc_id): doc_id, ids; an id that is not stored has no row.

    Each shard whose range of ids holds a wanted one is opened; its Bloom filter
    and index tell which blocks are read. Wanted ids, each taken once, are dealt
    to blocks of about LOOKUP, and those of a block go to all tasks; the shards
    are gone through once for each block. A null id finds rows with a null id.
    """
    wanted = materialize(wanted.select("doc_id").distinct(), "wanted")
    blocks = wanted.count() // LOOKUP + 1
    out = []
    for b in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == b).toArrow().column(0)  # about LOOKUP numbers
        ids = np.sort(rows.drop_null().to_numpy())
        shared = spark.sparkContext.broadcast((ids, rows.null_count > 0))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs

            store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
            ids, with_null = shared.value
            for batch in batches:
                for name, first, last in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    a = 0 if first is None else np.searchsorted(ids, first)
                    z = 0 if last is None else np.searchsorted(ids, last, "right")
                    mine = [*([None] if with_null and first is None else []), *ids[a:z].tolist()]
                    if mine:
                        with store.open_input_file(f"{root}/{name}") as f:
                            reader = Reader(f, f.size())
                            found = [(i, x) for i in mine for x in reader.lookup(i)]
                        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), _lists([x for _, x in found])], names=["doc_id", "ids"])

        out.append(shards.select("file", "first_id", "last_id").repartition(parts(spark), "file").mapInArrow(find, "doc_id long, ids array<int>"))
    return functools.reduce(DataFrame.unionAll, out)


def round_trip(docs: DataFrame, tokenizer_file: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` as shards and read them back, without the ids themselves. An empty table gives an empty result."""
    spark = docs.sparkSession
    folder = scratch_dir(spark) + "/sst"
    shards = write_shards(docs, folder, tokenizer_file, end_id)
    if not shards.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_shards(spark, folder, shards, with_ids=False)
