"""Summaries of corpora and audits that read a table once: concentrations, token sums, phrase families, coverage of codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.aggregates import ratio


def concentrations(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Of each group: rows, distinct values, the most frequent value and its share (ties to the smaller value)."""
    each = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    top = F.max_by(value, F.struct("n", F.col("_neg")))
    ranked = each.withColumn("_neg", -F.dense_rank().over(_by_value(by, value)))
    out = ranked.groupBy(*by).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_values"), top.alias("top_value"), F.max("n").alias("_top"))
    return out.withColumn("top_share", ratio(F.col("_top"), F.col("rows"))).drop("_top")


def _by_value(by: Sequence[str], value: str):
    from pyspark.sql import Window as W

    return W.partitionBy(*by).orderBy(value)


def counters(df: DataFrame, by: Sequence[str], conditions: Mapping[str, Column], sums: Mapping[str, Column]) -> DataFrame:
    """Many counters and sums of each group in one pass; a null condition does not count, a null sum is 0."""
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *counts, *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()])


def phrase_counts(df: DataFrame, text: str, phrases: Sequence[str]) -> DataFrame:
    """Texts by the longest of some phrases that they hold, zeros kept: phrase, n. The phrases are a short stated list."""
    from tidemark.functions.text import longest_phrase

    have = df.select(longest_phrase(F.col(text), phrases).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    shown = df.sparkSession.createDataFrame([(p,) for p in phrases], "phrase string")
    return shown.join(have, "phrase", "left").select("phrase", F.coalesce("n", F.lit(0)).alias("n"))


def violation_rates(found: DataFrame, rows: DataFrame, key: Sequence[str], codes: Sequence[str]) -> DataFrame:
    """Of each code: violations, keys with one, and their share of all keys."""
    n = rows.select(*key).distinct().agg(F.count(F.lit(1)).alias("keys"))
    each = found.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*key).alias("hit"))
    shown = found.sparkSession.createDataFrame([(c,) for c in codes], "code string")
    out = shown.join(each, "code", "left").join(F.broadcast(n))  # n is one row
    return out.select("code", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hit", F.lit(0)).alias("hit"), ratio(F.coalesce("hit", F.lit(0)), F.col("keys")).alias("share"))


def grid_errors(rows: DataFrame, by: Sequence[str], checkpoint: str, stride: int, last: int) -> DataFrame:
    """Checkpoints that a key lacks, or has beside the grid of stride, 2 stride, ..., last: by, checkpoint, code."""
    have = rows.select(*by, F.col(checkpoint).cast("long").alias("checkpoint")).distinct()
    wanted = rows.select(*by).distinct().withColumn("checkpoint", F.explode(F.sequence(F.lit(stride), F.lit(last), F.lit(stride)).cast("array<bigint>")))
    missing = wanted.join(have, [*by, "checkpoint"], "left_anti").withColumn("code", F.lit("missing"))
    return missing.unionByName(have.filter((F.col("checkpoint") % stride != 0) | ~F.col("checkpoint").between(stride, last)).withColumn("code", F.lit("off_grid")))


def repaired(rows: DataFrame, truth: DataFrame, keys: Sequence[str], slot: str) -> DataFrame:
    """Rows whose map ``slot`` is reconciled with the true one: entries that it does not have go, wrong values are set right; ``repairs`` names them."""
    empty = F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))")
    t = truth.select(*keys, F.col(slot).alias("_t"))
    out = rows.join(t, list(keys), "left").withColumn("_t", F.coalesce("_t", empty)).withColumn("_s", F.coalesce(slot, empty))
    gone = F.filter(F.map_keys("_s"), lambda k: ~F.map_contains_key("_t", k))
    wrong = F.filter(F.map_keys("_s"), lambda k: F.map_contains_key("_t", k) & ~F.try_element_at("_s", k).eqNullSafe(F.try_element_at("_t", k)))
    fixed = F.map_from_entries(F.transform(F.filter(F.map_keys("_s"), lambda k: F.map_contains_key("_t", k)), lambda k: F.struct(k, F.try_element_at("_t", k))))
    notes = F.array_sort(F.concat(F.transform(gone, lambda k: F.concat(F.lit("dropped:"), k)), F.transform(wrong, lambda k: F.concat(F.lit("set:"), k))))
    return out.withColumn("repairs", notes).withColumn(slot, fixed).drop("_t", "_s")
