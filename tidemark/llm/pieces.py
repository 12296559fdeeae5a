"""SentencePiece encoding and decoding over a relational lattice.

A text becomes one string with a mark (U+2581) for each space and one in front.
No piece goes on past the last letter before a mark, so words (a mark and what
follows) are encoded on their own. A word's lattice has an edge for every
substring that is a piece. With a unigram model the path with the largest sum of
scores is folded over the ends of the edges (Viterbi). Scores of a BPE model are
merge ranks and mean nothing when summed: from single characters on, of all
neighbours that make a piece together the pair with the highest score is merged,
the leftmost of equal ones, until no pair makes a piece. Both give the ids of the
sentencepiece library. Characters that are no piece become byte pieces.

The lattice is built with relational operations: substrings of bounded length
are exploded, joined to the piece table, grouped by word, and folded with
higher-order ``aggregate``. This encodes the words that make up at least a stated
share of all words. Their number is bounded by that share, their ids go to all
tasks and cover most of the text; the remaining rare words are folded by the same
rule inside the tasks that put documents together, since dealing every word of
the corpus to a join and back would shuffle several times the input.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm._common import materialize, text_batches

MARK = "▁"
#: Words that occur at least once in so many words are encoded ahead (there are at most so many of them); rare words kept by a worker.
FREQUENT, CACHE = 1_000_000, 250_000
#: Longer words are merged with a heap.
LONG = 64


class Pieces(NamedTuple):
    """A vocabulary: normal pieces with ids and scores, ids of the 256 byte pieces, score of the fall-back, whether scores add up."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: list[int]
    fallback: float
    longest: int
    unigram: bool = False

    @staticmethod
    def of(model: bytes) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))}
        scores = {p: sp.get_score(i) for p, i in ids.items()}
        low = min(scores.values()) - 10
        kind = model_type(model)
        if kind not in (UNIGRAM, BPE):
            raise ValueError(f"neither a unigram nor a BPE model: type {kind}")
        return Pieces(ids, scores, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], low, max(map(len, ids)), kind == UNIGRAM)


#: Fixed values of the model file: kinds of model, and where the kind stands.
UNIGRAM, BPE, _SPEC, _KIND = 1, 2, 2, 3


def fields(message: bytes) -> Iterator[tuple[int, int | bytes, int, int]]:
    """(number, value, start, end) of each field of a protocol-buffer message."""

    def varint(pos: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n, shift, pos = n | (message[pos] & 127) << shift, shift + 7, pos + 1
            if message[pos - 1] < 128:
                return n, pos

    pos = 0
    while pos < len(message):
        start = pos
        tag, pos = varint(pos)
        if tag & 7 == 0:
            value, pos = varint(pos)
        else:
            size, pos = varint(pos) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], pos)
            value, pos = message[pos : pos + size], pos + size
        yield tag >> 3, value, start, pos


def model_type(model: bytes) -> int:
    """The kind of a SentencePiece model; unigram where none is stated."""
    spec = next((v for n, v, *_ in fields(model) if n == _SPEC), b"")
    return next((v for n, v, *_ in fields(spec) if n == _KIND), UNIGRAM)


def as_unigram(model: bytes) -> bytes:
    """The same vocabulary as a unigram model: scores fall with the logarithm of a piece's rank, in steps of 1/64 so that sums are exact."""
    number = lambda n: bytes([n & 127 | 128]) + number(n >> 7) if n > 127 else bytes([n])
    field = lambda n, data: number(n << 3 | 2) + number(len(data)) + data
    out, rank = [], 0
    for n, value, a, b in fields(model):
        if n == 1:  # a piece: its score is a float in field 2
            rank += 1
            kept = b"".join(value[x:y] for k, _, x, y in fields(value) if k != 2)
            out.append(field(1, kept + b"\x15" + np.float32(-np.round(np.log(rank + 1) * 64) / 64).tobytes()))
        elif n == _SPEC:
            out.append(field(_SPEC, b"".join(value[x:y] for k, _, x, y in fields(value) if k != _KIND) + bytes([_KIND << 3, UNIGRAM])))
        else:
            out.append(model[a:b])
    return b"".join(out)


@functools.lru_cache(maxsize=2)
def load(file: str, best_path: bool = False) -> Pieces:
    """The vocabulary of a SentencePiece model file, with ``best_path`` as a unigram model; the file is there on every machine."""
    with open(file, "rb") as f:
        model = f.read()
    return Pieces.of(as_unigram(model) if best_path else model)


# -- the lattice as relations -------------------------------------------------


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """(piece, id, score); a vocabulary has some ten thousand rows."""
    return spark.createDataFrame([(p, i, pieces.scores[p]) for p, i in pieces.ids.items()], "piece string, id int, score double")


def encode_words(words: DataFrame, table: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) of distinct non-empty words, by joins, grouping and folds alone."""
    n = F.length("word")
    starts = words.select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("a"))
    spans = starts.select("word", "a", F.explode(F.sequence(F.lit(1), F.least(n - F.col("a"), F.lit(pieces.longest)))).alias("k"))
    spans = spans.withColumn("piece", F.substring("word", F.col("a") + 1, F.col("k")))
    edges = spans.join(F.broadcast(table), "piece", "left").filter("id is not null or k = 1")
    at = lambda a, k: a * (pieces.longest + 1) + k
    edge = F.struct(at(F.col("a"), F.col("k")).alias("at"), F.struct("score", "id").alias("edge"))
    lattice = edges.groupBy("word").agg(F.map_from_entries(F.collect_list(edge)).alias("edges"))
    found = lambda a, k, part: F.try_element_at(F.col("edges"), at(a, k))[part]
    path = (_best_path if pieces.unigram else _merged_path)(lattice, found, n, pieces)
    byte_ids = F.array(*map(F.lit, pieces.bytes_))
    as_bytes = lambda c: F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda k: F.element_at(byte_ids, F.conv(F.substring(F.hex(F.encode(c, "UTF-8")), k * 2 - 1, F.lit(2)), 16, 10).cast("int") + 1))
    ids = F.flatten(F.transform("path", lambda p: F.when(p["id"].isNotNull(), F.array(p["id"])).otherwise(as_bytes(F.substring(F.col("word"), p["a"] + 1, F.lit(1))))))
    return path.select("word", ids.alias("ids"))


def _best_path(lattice: DataFrame, found, n: Column, pieces: Pieces) -> DataFrame:
    """Viterbi: for each end the best score of a way there, of equal ones that with the longest last piece; then the way back."""
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("k"), F.lit(None).cast("int").alias("id")))

    def step(best, e):
        def candidate(k):
            score = F.coalesce(found(e - k, k, "score"), F.when(k == 1, F.lit(pieces.fallback)))
            return F.struct((F.get(best, e - k)["score"] + score).alias("score"), k.alias("k"), found(e - k, k, "id").alias("id"))

        ways = F.filter(F.transform(F.sequence(F.lit(1), F.least(e, F.lit(pieces.longest))), candidate), lambda c: c["score"].isNotNull())
        return F.concat(best, F.array(F.array_max(ways)))

    ends = lattice.select("word", F.aggregate(F.sequence(F.lit(1), n), first, step).alias("best"))
    none = F.expr("cast(array() as array<struct<a:int,id:int>>)")

    def back(way, e):
        piece = F.get(F.col("best"), e)
        here = F.when(F.size(way) == 0, e == n).otherwise(F.get(way, F.lit(0))["a"] == e)
        return F.when(here, F.concat(F.array(F.struct((e - piece["k"]).alias("a"), piece["id"].alias("id"))), way)).otherwise(way)

    return ends.select("word", F.aggregate(F.sequence(n, F.lit(1), F.lit(-1)), none, back).alias("path"))


def _merged_path(lattice: DataFrame, found, n: Column, pieces: Pieces) -> DataFrame:
    """Merges: of the cuts between pieces the one whose removal makes the best-ranked piece goes first."""

    def step(cuts, _):
        pair = lambda c, i: F.struct(F.coalesce(F.when(F.get(cuts, i + 2) - c <= pieces.longest, found(c, F.get(cuts, i + 2) - c, "score")), F.lit(float("-inf"))).alias("score"), (-i).alias("left"))
        best = F.array_max(F.transform(F.slice(cuts, F.lit(1), F.size(cuts) - 2), pair))
        merge = lambda p: F.when(p["score"] > float("-inf"), F.concat(F.slice(cuts, F.lit(1), 1 - p["left"]), F.slice(cuts, 3 - p["left"], F.size(cuts)))).otherwise(cuts)
        return F.get(F.transform(F.array(best), merge), F.lit(0))

    merged = lattice.select("word", "edges", F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.sequence(F.lit(0), n), step).alias("cuts"))
    spelt = lambda a, i: F.struct(a.alias("a"), found(a, F.get(F.col("cuts"), i + 1) - a, "id").alias("id"))
    return merged.select("word", F.transform(F.slice("cuts", F.lit(1), F.size("cuts") - 1), spelt).alias("path"))


def frequent_words(docs: DataFrame, one_in: int = FREQUENT) -> DataFrame:
    """The words that occur once in ``one_in`` words of all texts, or more often, and twice at least, counted in full: at most ``one_in`` of them."""
    words = docs.select(F.explode(F.split("text", " ")).alias("w")).filter("w <> ''")
    counts = materialize(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return counts.filter((F.col("n") > 1) & (F.col("n") * one_in >= total)).select(F.concat(F.lit(MARK), "w").alias("word"))


# -- the lattice of one word --------------------------------------------------


def merge_long(word: str, scores: dict[str, float]) -> list[str]:
    """The merges of ``fold_word`` with a heap of pairs, for words of any length."""
    n = len(word)
    part, left, right = list(word), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[float, int, str]] = []

    def pair(a: int, b: int) -> None:
        if a >= 0 and b < n and (s := scores.get(p := part[a] + part[b])) is not None:
            heapq.heappush(heap, (-s, a, p))

    for a in range(n - 1):
        pair(a, a + 1)
    while heap:
        _, a, p = heapq.heappop(heap)
        b = right[a]
        if b >= n or not part[a] or part[a] + part[b] != p:
            continue  # one of the two was merged since
        part[a], part[b], right[a] = p, "", right[b]
        if right[b] < n:
            left[right[b]] = a
        pair(left[a], a)
        pair(a, right[a])
    return [p for p in part if p]


def best_split(word: str, pieces: Pieces) -> list[str]:
    """The pieces with the largest sum of scores; of equal ways to an end the one with the longest last piece."""
    best, last = [0.0], [0]
    for e in range(1, len(word) + 1):
        top, length = float("-inf"), 1
        for a in range(max(0, e - pieces.longest), e):
            s = pieces.scores.get(word[a:e], pieces.fallback if a == e - 1 else None)
            if s is not None and best[a] + s > top:
                top, length = best[a] + s, e - a
        best.append(top)
        last.append(length)
    out, e = [], len(word)
    while e:
        out.append(word[e - last[e] : e])
        e -= last[e]
    return out[::-1]


def fold_word(word: str, pieces: Pieces) -> list[int]:
    """The same encoding of a single word."""
    ids, scores, none = pieces.ids, pieces.scores, float("-inf")
    if pieces.unigram:
        parts = best_split(word, pieces)
    elif len(word) > LONG:
        parts = merge_long(word, scores)
    else:
        parts = list(word)
        pairs = [scores.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (top := max(pairs)) > none:
            i = pairs.index(top)
            parts[i : i + 2] = [p := parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = scores.get(parts[i - 1] + p, none)
            if i < len(pairs):
                pairs[i] = scores.get(p + parts[i + 1], none)
    out: list[int] = []
    for p in parts:
        if p in ids:
            out.append(ids[p])
        else:
            out += [pieces.bytes_[x] for x in p.encode()]
    return out


def split_marked(text: str) -> list[str]:
    """Words of a text as they are encoded: runs of marks stay with the word behind them."""
    if not text:
        return []
    words = text.replace(MARK, " ").split(" ")
    if "" not in words:
        return [MARK + w for w in words]
    out, marks = [], ""
    for w in words:
        marks += MARK
        if w:
            out.append(marks + w)
            marks = ""
    return [*out, marks] if marks else out


def decode_ids(ids: list[int], table: list[bytes]) -> str:
    """Text of piece ids; ``table`` has the UTF-8 bytes of each id. A wrong byte sequence becomes U+FFFD."""
    text = b"".join([table[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
    return text.removeprefix(" ")


def byte_table(pieces: Pieces, size: int) -> list[bytes]:
    table = [b""] * size
    for p, i in pieces.ids.items():
        table[i] = p.encode()
    for b, i in enumerate(pieces.bytes_):
        table[i] = bytes([b])
    return table


_rare: dict[tuple[str, bool], dict[str, bytes]] = {}

SCHEMA = "doc_id long, n_pieces long, n_bytes long, round_trip boolean, ids array<int>"


def encode(docs: DataFrame, model_file: str, one_in: int = FREQUENT, best_path: bool = False) -> DataFrame:
    """Piece ids of each row of ``docs`` (doc_id, text; other columns are left alone).

    With ``best_path`` the vocabulary is taken as a unigram model (``as_unigram``)
    whatever its kind, so that ids are those of the Viterbi fold.

    Returned: doc_id, n_pieces, n_bytes of the text, round_trip (whether decoding
    gives the text back; a text that holds the mark itself decodes to a space
    there) and ids. A null or empty text has no pieces. Texts are encoded whole,
    and ids do not depend on which words are frequent. Repeated rows give a row
    each.
    """
    spark = docs.sparkSession
    pieces = load(model_file, best_path)
    ahead = materialize(encode_words(frequent_words(docs, one_in), piece_table(spark, pieces), pieces), "frequent")
    known = {r[0]: np.array(r[1], "<i4").tobytes() for r in ahead.collect()}  # at most ``one_in`` words
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, frequent, rare = load(model_file, best_path), shared.value, _rare.setdefault((model_file, best_path), {})
        table = byte_table(voc, max(*voc.ids.values(), *voc.bytes_) + 1)
        for batch in batches:
            for doc_ids, texts in text_batches(batch, 2_000_000):
                packed, rows = [], []
                for doc_id, text in zip(doc_ids, texts):
                    parts = []
                    for w in split_marked(text):
                        x = frequent.get(w) or rare.get(w)
                        if x is None:
                            if len(rare) >= CACHE:
                                rare.clear()
                            x = np.array(fold_word(w, voc), "<i4").tobytes()
                            if len(w) < 64:
                                rare[w] = x
                        parts.append(x)
                    ids = np.frombuffer(b"".join(parts), "<i4")
                    packed.append(ids)
                    rows.append((doc_id, len(ids), len(text.encode()), decode_ids(ids.tolist(), table) == text))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, packed)]), pa.int32()), pa.array(np.concatenate(packed)))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows), types)), lists], names=["doc_id", "n_pieces", "n_bytes", "round_trip", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids). Null ids give a null text; ids outside of the vocabulary give nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = load(model_file)
        size = max(*voc.ids.values(), *voc.bytes_) + 1
        table = byte_table(voc, size)
        for batch in batches:
            texts = [None if ids is None else decode_ids([i for i in ids if i is not None and 0 <= i < size], table) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
