"""Intermediate tables and checked broadcasts for the engine's own operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.streaming.events import scratch


def staged(df: DataFrame) -> DataFrame:
    """``df`` written in the shared folder and read again: it is worked out once, and lost executors cost no more than a task."""
    path = f"{scratch(df.sparkSession)}/staged"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def tasks_for(df: DataFrame, rows: int = 200_000) -> int:
    """How many tasks take about ``rows`` rows each of ``df``, which is counted: Spark's own number is the same for tables of any size."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), df.count() // rows + 1)


def dealt(df: DataFrame, by: Sequence[str], order: Sequence[str], tasks: int | None = None) -> DataFrame:
    """``df`` with all rows of a key in one task, in ``order`` within it, for functions that see rows as they pass.

    The key is dealt by a hash of its own: Spark leaves out a repartition by
    columns by which the sides of a union or join are dealt already, and may then
    put these sides together in other ways, as nothing behind asks for the key.
    """
    deal = [F.xxhash64(*by)] if tasks is None else [tasks, F.xxhash64(*by)]
    return df.repartition(*deal).sortWithinPartitions(*by, *order)


def free(base: str, *tables: DataFrame) -> str:
    """A column name that none of ``tables`` has."""
    while any(base in t.columns for t in tables):
        base += "_"
    return base
