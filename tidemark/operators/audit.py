"""Rules and the rows that break them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def violations(df: DataFrame, key: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """A row for each broken rule, in one pass: key and code. A rule that is null is not broken."""
    codes = F.array(*[F.when(broken, F.lit(code)) for code, broken in rules.items()])
    return df.select(*key, F.explode(F.array_compact(codes)).alias("code"))


def code_counts(found: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Number of violations of each code, with zeros."""
    shown = found.sparkSession.createDataFrame([(c,) for c in codes], "code string")
    return shown.join(found.groupBy("code").agg(F.count(F.lit(1)).alias("n")), "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))


def not_alternating(df: DataFrame, by: Sequence[str], order: str, speaker: str) -> DataFrame:
    """Rows whose speaker is that of the row before."""
    w = W.partitionBy(*by).orderBy(order)
    return df.withColumn("_b", F.lag(speaker).over(w)).filter(F.col(speaker) == F.col("_b")).drop("_b")


def gaps(df: DataFrame, by: Sequence[str], no: str, first: int) -> DataFrame:
    """Keys whose numbers are not first, first + 1, ...: n, lowest, highest, distinct numbers."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(no).alias("lowest"), F.max(no).alias("highest"), F.countDistinct(no).alias("n_distinct"))
    return g.filter(~((F.col("lowest") == first) & (F.col("highest") == F.col("n") + first - 1) & (F.col("n_distinct") == F.col("n"))))


def assert_none(found: DataFrame, what: str) -> None:
    """Raise with an example if ``found`` has rows."""
    if rows := found.limit(1).collect():
        raise ValueError(f"{what}: {rows[0].asDict()}")


def assert_columns(df: DataFrame, allowed: Sequence[str], forbidden: Sequence[str] = ()) -> None:
    """Raise at analysis time if ``df`` has a forbidden column or one that is not allowed."""
    bad = [c for c in df.columns if c in forbidden or c not in allowed]
    if bad:
        raise ValueError(f"columns must not be exported: {bad}")
