"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dir: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Where that setting is missing and Spark runs on this machine alone (local
    tests) one temporary folder per process is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: executors and driver need a shared folder")
    if not base:
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="tidemark-"))
        base = _own_dir[0]
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    This cuts the lineage in a way that outlives executors. Spark drops the
    shuffle files of the finished write, so a chain of steps needs the disk of
    its largest step, not of their sum.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def lean_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Let at most ``rows`` rows go to Python at a time in this session, unless it asks for fewer already.

    A row carries a whole text here, and Arrow holds a batch several times over,
    outside of the heap.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def small(df: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most_rows`` rows; else as it is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def parts(spark: SparkSession, at_least: int = 8) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply, twice) on unsigned integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; a worker keeps the longest row so far."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 200_000), base, np.uint64)
        out[:1] = 1
        have = _powers[base] = np.cumprod(out, dtype=np.uint64)
    return have[:n]


#: Odd multipliers of the rolling hashes and their inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 2**64)


def rolling(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums for ``span_hash`` over unsigned 64-bit symbol values."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=sums[1:], dtype=np.uint64)
    return sums, powers(UNBASE, len(values) + 1)


def span_hash(prefix: tuple[np.ndarray, np.ndarray], start, stop) -> np.ndarray:
    """Rabin-Karp hash of values[start:stop] for arrays of bounds."""
    sums, down = prefix
    return mix64((sums[stop] - sums[start]) * down[start])


def text_batches(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts (null: empty) of a batch of (id, text), about ``most`` bytes of text at a time."""
    ids, texts = batch.column(0), batch.column(1)
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).cumsum()
    a = 0
    while a < len(ids):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most)))
        yield ids.slice(a, b - a).to_pylist(), [t or "" for t in texts.slice(a, b - a).to_pylist()]
        a = b
