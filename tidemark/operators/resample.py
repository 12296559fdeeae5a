"""Resampling statistics with draws that depend on seed and position only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.text import hash_mod, hash_pick
from tidemark.operators._stage import bounded, staged
from tidemark.operators.windows import numbered_whole


def cluster_sums(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """(i from 0, s, n) of each cluster in cluster order; resampling only needs these."""
    out = df.filter(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    return staged(numbered_whole(out, [cluster], "i").select("i", "s", "n"))


def bootstrap_means(spark: SparkSession, clusters: DataFrame, draws: int, seed: str) -> DataFrame:
    """Mean of each replicate that draws as many clusters as there are, with replacement: rep, mean.

    Every draw is a hash of seed, replicate and slot, so results do not depend
    on partitioning and other engines can repeat them.
    """
    k = max(clusters.count(), 1)
    drawn = spark.range(draws * k).select(F.expr(f"id div {k}").alias("rep"), (F.col("id") % k).alias("slot"))
    drawn = drawn.withColumn("i", hash_mod(hash_pick(seed, F.col("rep"), F.col("slot")), k)).groupBy("rep", "i").agg(F.count(F.lit(1)).alias("times"))
    sums = drawn.join(bounded(clusters), "i").groupBy("rep").agg(F.sum(F.col("s") * F.col("times")).alias("s"), F.sum(F.col("n") * F.col("times")).alias("n"))
    return sums.select("rep", (F.col("s") / F.col("n")).alias("mean"))


def interval(means: DataFrame, alpha: float = 0.05, inner: bool = False) -> DataFrame:
    """Bounds (low, high) of sorted replicate means.

    Two index rules: int(a/2 n) and min(n - 1, int((1 - a/2) n)); or, with
    ``inner``, int(a/2 (n - 1)) and int((1 - a/2) (n - 1)).
    """
    a = means.agg(F.array_sort(F.collect_list("mean")).alias("m"))  # one value for each replicate
    n = F.size("m") - (1 if inner else 0)
    low = F.floor(F.lit(alpha / 2) * n).cast("int")
    high = F.least(F.size("m") - 1, F.floor(F.lit(1 - alpha / 2) * n).cast("int"))
    return a.select(F.get("m", low).alias("low"), F.get("m", high).alias("high"))


def sign_flip(spark: SparkSession, clusters: DataFrame, draws: int, seed: str) -> DataFrame:
    """Two-sided p-value of a mean of zero: clusters change sign by hash; (hits + 1) / (draws + 1)."""
    total = clusters.agg((F.sum("s") / F.sum("n")).alias("observed"), F.sum("n").alias("n_all"))
    flips = clusters.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    flips = flips.withColumn("sign", F.when(hash_mod(hash_pick(seed, F.col("rep"), F.col("i")), 2) == 0, 1).otherwise(-1))
    reps = flips.groupBy("rep").agg((F.sum(F.col("s") * F.col("sign")) / F.sum("n")).alias("m"))
    hit = F.abs("m") >= F.abs("observed") - 1e-12
    return reps.join(F.broadcast(total)).agg(F.first("observed").alias("observed"), ((F.count_if(hit) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))
