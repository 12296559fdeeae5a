"""Removing repeated passages by Rabin-Karp hashes of every fixed-length word window.

Every window's hash spans are reduced to the window's anchor first: the least
Rabin-Karp hash among its shorter spans. A window can only be repeated if its
anchor is, and neighbouring windows mostly share theirs, so about a tenth of the
positions tell which windows need counting. Those windows' Rabin-Karp hashes, two
of 64 bits for each, are then counted over the corpus, and the repeated windows of a document merge into
maximal removal intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm._common import materialize, mix64, rolling, span_hash, text_batches
from tidemark.llm._repeats import anchors, keyed, repeated, text_symbols

#: Words of a window, and of the shorter spans that its anchor is chosen from.
WIDTH, GRAM = 35, 14
#: A window is counted under two hashes of 64 bits, made from differently mixed words.
SALTS = (np.uint64(0), np.uint64(0xC2B2AE3D27D4EB4F))


def _windows(texts: list[bytes], width: int, gram: int):
    values, ends = text_symbols(texts, by_word=True)
    sizes = np.diff(ends, prepend=0)
    starts, place, low = anchors(values, np.repeat(ends, sizes), width, gram)
    of = np.repeat(np.arange(len(texts)), sizes)
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    return values, ends, sizes, of, starts, place, low, new


def repeated_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Starts (in words) of the windows of each document that also start anywhere else: doc_id, h, starts (packed unsigned 32-bit)."""

    def by_anchor(ids: list, texts: list[bytes], _: list):
        *_, of, starts, place, low, new = _windows(texts, width, gram)
        return low[new], of[place[new]] if len(place) else place

    def candidates(texts: list[bytes], flagged: list[bytes]):
        values, ends, sizes, of, starts, place, low, new = _windows(texts, width, gram)
        if not len(starts):
            return values, of, starts, ends, sizes
        run = np.cumsum(new) - 1
        owner = of[place[new]]
        first = np.searchsorted(owner, np.arange(len(texts)))
        good = np.zeros(int(new.sum()), bool)
        for i, f in enumerate(flagged):
            good[first[i] + np.frombuffer(f, np.uint32)] = True
        return values, of, starts[good[run]], ends, sizes

    def by_window(ids: list, texts: list[bytes], flagged: list[bytes]):
        values, of, starts, *_ = candidates(texts, flagged)
        two = [span_hash(rolling(mix64(values ^ salt)), starts, starts + width) for salt in SALTS]
        return np.stack(two, axis=1), of[starts]

    slim = keyed(docs)
    maybe = repeated(slim, by_anchor, False, "anchors")
    marked = materialize(slim.join(maybe, ["doc_id", "h"]).select("doc_id", "text", "h", "numbers"), "marked")
    hits = repeated(marked, by_window, False, "windows", width=2)

    def place_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, texts in text_batches(batch, 2_000_000):
                rows = batch.slice(at, len(ids))
                at += len(ids)
                _, of, starts, ends, sizes = candidates([t.encode() for t in texts], rows.column(3).to_pylist())
                first = np.searchsorted(of[starts], np.arange(len(ids)))
                out = [(starts[first[i] + np.frombuffer(x, np.uint32)] - (ends[i] - sizes[i])).astype(np.uint32).tobytes() for i, x in enumerate(rows.column(4).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), rows.column(2), pa.array(out, pa.binary())], names=["doc_id", "h", "starts"])

    placed = marked.join(hits.withColumnRenamed("numbers", "hits"), ["doc_id", "h"]).select("doc_id", "text", "h", "numbers", "hits")
    found = placed.mapInArrow(place_hits, "doc_id long, h long, starts binary")
    return materialize(found.groupBy("doc_id", "h").agg(F.first("starts").alias("starts")), "starts")  # equal rows have equal starts


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_intervals long, kept_text string"


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Each document without the words of repeated windows.

    Returned per row of ``docs`` (doc_id, text; other columns are left alone):
    doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one
    space, n_intervals (maximal removed runs) and kept_text. A null text has no
    words; a row with a null id neither loses nor removes anything. Rows with
    one id are documents of their own, so equal rows lose all their windows.
    Texts with fewer words than ``width`` lose nothing. Windows never cross
    documents. An empty table gives an empty result.
    """
    starts = repeated_windows(docs, width, gram)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, texts in text_batches(batch):
                marks = batch.column(3).slice(at, len(ids)).to_pylist()
                at += len(ids)
                rows = []
                for doc_id, text, mark in zip(ids, texts, marks):
                    words = text.encode().split()
                    gone = np.zeros(len(words) + 1, np.int64)
                    if mark:
                        s = np.frombuffer(mark, np.uint32).astype(np.int64)
                        np.add.at(gone, s, 1)
                        np.add.at(gone, s + width, -1)
                    out = np.cumsum(gone)[:-1] > 0
                    kept = b" ".join([w for w, o in zip(words, out.tolist()) if not o] if mark else words)
                    rows.append((doc_id, len(words), int(out.sum()), hashlib.sha256(kept).hexdigest(), int((np.diff(out.astype(np.int8), prepend=0) > 0).sum()), kept.decode()))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(starts, ["doc_id", "h"], "left")
    return rows.select("doc_id", "text", "h", "starts").mapInArrow(cut, SCHEMA)
