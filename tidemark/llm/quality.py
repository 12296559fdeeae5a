"""Quality rules: word statistics and zstandard compression bands.

A text that repeats itself compresses far better than prose, and a text that is
encoded or random hardly compresses at all. Both are measured twice: over the
whole document, with limits that depend on its length, since a compressor needs
some text before it gains anything, and over fixed chunks, so that a bad stretch
shows in a long good document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tidemark.llm._common import text_batches

#: (bytes from, lowest ratio, highest ratio) of whole documents: raw bytes by compressed bytes at LEVEL. The lowest ratios are
#: above those of base64 and of random letters and digits, in words or not, of any length in the band (1.39 at most). Below 130
#: bytes prose often does not compress either (0.82 to 1.1, like base64), so only the highest ratio says anything there.
BANDS = ((0, 0.0, 2.5), (60, 0.0, 3.0), (80, 0.0, 3.5), (100, 0.0, 4.0), (130, 1.0, 4.0), (140, 1.02, 4.0), (150, 1.035, 4.5), (170, 1.045, 4.5), (180, 1.07, 4.5), (200, 1.18, 4.5), (300, 1.4, 4.5), (500, 1.45, 4.5), (700, 1.5, 4.5), (1_000, 1.55, 4.5), (2_000, 1.6, 4.5), (4_000, 1.6, 5.5), (16_000, 1.6, 6.0))
#: Chunks of CHUNK bytes: one outside of (low, high) is bad, and so is a document with over CHUNK_SHARE percent of its bytes in bad ones.
#: The rest behind the whole chunks is one, too; its lowest ratio is that of its length in BANDS.
CHUNK, CHUNK_LOW, CHUNK_HIGH, CHUNK_SHARE = 4_096, 1.6, 8.0, 25
LEVEL = 3
WINDOW = 5
MOST_REPEATED = 20
LEAST_WORDS = 10

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_bytes long, ratio double, n_chunks long, n_bad_chunks long"


def repeated_words(words: list[list[bytes]], window: int = WINDOW) -> list[int]:
    """For each word list, how many words lie in windows that occur twice or more in it."""
    codes: dict[bytes, int] = {}
    flat = np.fromiter((codes.setdefault(w, len(codes)) for ws in words for w in ws), np.int64)
    sizes = np.array([len(ws) for ws in words], np.int64)
    if len(flat) < window:
        return [0] * len(words)
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(words)), sizes)
    start = np.flatnonzero(np.arange(len(flat)) + window <= ends[of])
    # windows are named exactly: pairs of codes, then pairs of pairs, are numbered anew
    name, reach = flat, 1
    while reach < window:
        step = min(reach, window - reach)
        top = int(name.max()) + 1
        pair = name[: len(name) - step] * top + name[step:]
        name, reach = np.unique(pair, return_inverse=True)[1], reach + step
    name = name[start] * len(words) + of[start]
    _, back, times = np.unique(name, return_inverse=True, return_counts=True)
    hits = start[times[back] > 1]
    cover = np.zeros(len(flat) + 1, np.int32)
    np.add.at(cover, hits, 1)
    np.add.at(cover, hits + window, -1)
    return np.bincount(of[np.cumsum(cover)[:-1] > 0], minlength=len(words)).tolist()


def band(size: int) -> tuple[float, float]:
    """The lowest and highest ratio of a text of ``size`` bytes."""
    return next((lo, hi) for least, lo, hi in reversed(BANDS) if size >= least)


def band_verdict(raw: bytes, zip_: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """(ratio, chunks, bad chunks, verdict) of one text in UTF-8; a text under one whole chunk has no chunks."""
    if not raw:
        return 0.0, 0, 0, False
    ratio = len(raw) / len(zip_.compress(raw))
    low, high = band(len(raw))
    chunks = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)] if len(raw) >= CHUNK else []
    bad = [len(c) for c in chunks if not (CHUNK_LOW if len(c) == CHUNK else band(len(c))[0]) <= len(c) / len(zip_.compress(c)) <= CHUNK_HIGH]
    return ratio, len(chunks), len(bad), low <= ratio <= high and 100 * sum(bad) <= CHUNK_SHARE * sum(map(len, chunks))


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


def quality(docs: DataFrame) -> DataFrame:
    """One row of statistics and verdicts for each row of ``docs`` (doc_id, text; other columns are left alone).

    A null text counts as an empty one: no words, ``base_failed``, not kept.
    Texts are read whole. Repeated rows and null ids give a row each. A map over
    the input without any exchange.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for ids, texts in text_batches(batch):
                raws = [t.encode() for t in texts]
                words = [r.split() for r in raws]
                rows = []
                for doc_id, text, raw, ws, again in zip(ids, texts, raws, words, repeated_words(words)):
                    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
                    failed = base_failed(len(ws), again)
                    ratio, n, bad, fine = band_verdict(raw, zip_)
                    rows.append((doc_id, len(ws), len(text) - sum(map(text.count, " \t\n\r\x0b\x0c")), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), again, failed, fine and not failed, len(raw), ratio, n, bad))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [{"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[x.split()[1]] for x in SCHEMA.split(", ")]


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns as they are.

    Every row is judged on its own, whatever its id. A map over the input
    without any exchange.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            fine: list[bool] = []
            for _, texts in text_batches(pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], names=["id", "text"])):
                raws = [t.encode() for t in texts]
                words = [r.split() for r in raws]
                fine += [not base_failed(len(ws), again) and band_verdict(raw, zip_)[3] for raw, ws, again in zip(raws, words, repeated_words(words))]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
