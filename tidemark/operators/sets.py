"""Sets, multisets, seeded samples and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions.text import hash_pick


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` beyond those of ``b`` and the other way round, with multiplicity and ``side``."""
    cols = a.columns
    n = a.withColumn("_d", F.lit(1)).unionByName(b.withColumn("_d", F.lit(-1))).groupBy(*cols).agg(F.sum("_d").alias("d")).filter("d <> 0")
    return n.select(*cols, F.when(F.col("d") > 0, "left").otherwise("right").alias("side"), F.abs("d").alias("times"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct rows with what became of them: retained, lost or new."""
    cols = before.columns
    n = before.distinct().withColumn("_b", F.lit(1)).unionByName(after.distinct().withColumn("_b", F.lit(2))).groupBy(*cols).agg(F.sum("_b").alias("b"))
    return n.select(*cols, F.when(F.col("b") == 3, "retained").when(F.col("b") == 1, "lost").otherwise("new").alias("fate"))


def quota_sample(df: DataFrame, band: str, quota: dict[str, int], seed: str, key: str, strict: bool = False) -> DataFrame:
    """Exactly ``quota[band]`` rows of each band by seeded hash order; all if there are fewer, or an error with ``strict``."""
    if strict:
        have = {r[0]: r[1] for r in df.filter(F.col(band).isin(*quota)).groupBy(band).agg(F.count(F.lit(1))).collect()}  # a row for each quota
        if short := {b: have.get(b, 0) for b, n in quota.items() if have.get(b, 0) < n}:
            raise ValueError(f"too few rows: {short}")
    most = F.coalesce(*[F.when(F.col(band) == b, n) for b, n in quota.items()], F.lit(0))
    r = F.row_number().over(W.partitionBy(band).orderBy(hash_pick(seed, F.col(key)), key))
    return df.withColumn("_r", r).filter(F.col("_r") <= most).drop("_r")


def hash_sample(df: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """``n`` rows without replacement in seeded hash order: a distributed top-n."""
    return df.orderBy(hash_pick(seed, F.col(key)), key).limit(n)


def bin_representatives(df: DataFrame, by: Sequence[str], order: Sequence[str], bins: int, seed: str, key: str) -> DataFrame:
    """One row for each contiguous bin of a key's ordered rows (the last bin takes the remainder): the least seeded hash."""
    group = W.partitionBy(*by)
    i = F.row_number().over(group.orderBy(*order)) - 1
    size = F.greatest(F.floor(F.count(F.lit(1)).over(group) / bins), F.lit(1))
    out = df.withColumn("bin", F.least(F.floor(i / size), F.lit(bins - 1)).cast("long")).withColumn("_h", hash_pick(seed, F.col(key)))
    r = F.row_number().over(W.partitionBy(*by, "bin").orderBy("_h", key))
    return out.withColumn("_r", r).filter("_r = 1").drop("_r", "_h")


def top_per(df: DataFrame, by: Sequence[str], order: Sequence, k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def strata_claims(df: DataFrame, key: str, strata: Sequence[tuple[str, str, int]], seed: str) -> DataFrame:
    """Ordered strata (name, condition, most): rows in seeded order up to each stratum's cap; a row belongs to the first stratum that takes it."""
    claimed = None
    for place, (name, cond, most) in enumerate(strata):
        rest = df.filter(cond) if claimed is None else df.filter(cond).join(claimed.select(key), key, "left_anti")
        took = hash_sample(rest, most, f"{seed}:{name}", key).withColumn("stratum", F.lit(name)).withColumn("place", F.lit(place))
        claimed = took if claimed is None else claimed.unionByName(took)
    return claimed
