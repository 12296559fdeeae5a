"""Scores and summaries: ratios with their zero rules, macro levels, calibration, multisets, confusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators._stage import free, staged
from tidemark.operators.windows import numbered_whole


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.when(b != 0, a / b)


def f1(p: Column, r: Column) -> Column:
    """Harmonic mean; null if either is null, 0 if both are 0."""
    return F.when(p.isNotNull() & r.isNotNull(), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def prf(matched: Column, predicted: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of matched counts: all 1 if nothing is there and nothing is said, 0 if only one side is empty."""
    nothing = (predicted == 0) & (gold == 0)
    p = F.when(nothing, 1.0).when(predicted == 0, 0.0).otherwise(matched / predicted)
    r = F.when(nothing, 1.0).when(gold == 0, 0.0).otherwise(matched / gold)
    return p, r, F.when(nothing, 1.0).when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def macro(df: DataFrame, levels: Sequence[Sequence[str]], metrics: Sequence[str]) -> DataFrame:
    """Mean of means: averages over the first level's keys, then over each further level's, and over all at last. Nulls are left out."""
    for keys in [*levels, []]:
        df = df.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])
    return df


def calibration_bins(df: DataFrame, confidence: str, outcome: str, bins: int = 10) -> DataFrame:
    """bin, n, mean confidence, mean outcome; bins are [lo, hi), the last one holds 1.0 too."""
    c = F.col(confidence)
    which = F.lit(None).cast("int")
    for b in range(bins - 1, -1, -1):
        top = c <= 1.0 if b == bins - 1 else c < (b + 1) / bins
        which = F.when((c >= b / bins) & top, b).otherwise(which)
    binned = df.filter(c.isNotNull() & F.col(outcome).isNotNull()).withColumn("bin", which).filter("bin is not null")
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("confidence"), F.avg(F.col(outcome).cast("double")).alias("accuracy"))


def calibration_error(df: DataFrame, confidence: str, outcome: str, bins: int = 10, least: int = 10) -> DataFrame:
    """Expected calibration error as one row (n, ece); null under ``least`` samples."""
    b = calibration_bins(df, confidence, outcome, bins)
    return b.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece")).withColumn("ece", F.when(F.col("n") >= least, F.col("ece")))


def brier(df: DataFrame, by: Sequence[str], confidence: str, outcome: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(confidence) - F.col(outcome).cast("double"), 2)).alias("brier"), F.avg(confidence).alias("mean_confidence"), F.count(confidence).alias("n"))


def multiset_scores(gold: DataFrame, predicted: DataFrame, item: str, atom: Sequence[str]) -> DataFrame:
    """Per item true positives (sum of the smaller multiplicity), predicted and gold counts."""
    g = gold.groupBy(item, *atom).agg(F.count(F.lit(1)).alias("g"))
    p = predicted.groupBy(item, *atom).agg(F.count(F.lit(1)).alias("p"))
    both = g.unionByName(p, allowMissingColumns=True).groupBy(item, *atom).agg(F.coalesce(F.sum("g"), F.lit(0)).alias("g"), F.coalesce(F.sum("p"), F.lit(0)).alias("p"))
    return both.groupBy(item).agg(F.sum(F.least("g", "p")).alias("tp"), F.sum("p").alias("n_pred"), F.sum("g").alias("n_gold"))


def class_f1(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Per class: tp, n_pred, n_gold and f1; classes without gold rows are left out."""
    g = df.groupBy(F.col(gold).alias("label")).agg(F.count(F.lit(1)).alias("n_gold"), F.count_if(F.col(gold).eqNullSafe(F.col(predicted))).alias("tp"))
    p = df.groupBy(F.col(predicted).alias("label")).agg(F.count(F.lit(1)).alias("n_pred"))
    out = g.join(p, "label", "left").withColumn("n_pred", F.coalesce("n_pred", F.lit(0)))
    return out.filter("label is not null").select("label", "tp", "n_pred", "n_gold", prf(F.col("tp"), F.col("n_pred"), F.col("n_gold"))[2].alias("f1"))


def change_class(initial: Column, gold: Column, predicted: Column, is_predicted: Column) -> Column:
    """Class of a state cell by what changed and what was said to change; cells compare with nulls equal."""
    changed, said = ~gold.eqNullSafe(initial), is_predicted & ~predicted.eqNullSafe(initial)
    right = is_predicted & predicted.eqNullSafe(gold)
    return F.when(changed & said & right, "tp_correct").when(changed & said, "tp_wrong_value").when(changed, "fn").when(said, "fp").otherwise("tn")


def cell_confusion(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of the change classes and of right cells; ``cells``: initial, gold, predicted, is_predicted."""
    c = cells.withColumn("k", change_class(F.col("initial"), F.col("gold"), F.col("predicted"), F.col("is_predicted")))
    kinds = ("tp_correct", "tp_wrong_value", "fn", "fp", "tn")
    right = F.col("is_predicted") & F.col("predicted").eqNullSafe(F.col("gold"))
    return c.groupBy(*by).agg(*[F.count_if(F.col("k") == k).alias(k) for k in kinds], F.count_if(right).alias("n_right"), F.count(F.lit(1)).alias("n_cells"))


def falsy_to_unknown(c: Column, kind: str) -> Column:
    """Null, empty text and zero become "unknown"."""
    falsy = c.isNull() | (c.cast("string") == "") | ((c == 0) if kind in ("int", "bigint", "double", "float") else F.lit(False))
    return F.when(falsy, "unknown").otherwise(c.cast("string"))


def by_dimensions(df: DataFrame, dims: Sequence[str], metric: Column) -> DataFrame:
    """One summary for each dimension on its own, in a single pass: dimension, value, n, mean."""
    kinds = dict(df.dtypes)
    clean = df.select(*[falsy_to_unknown(F.col(d), kinds[d]).alias(d) for d in dims], metric.alias("_m"))
    sets = clean.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), F.avg("_m").alias("mean"))
    which = F.element_at(F.array(*map(F.lit, dims)), F.lit(0).cast("int"))
    n = len(dims)
    for i, d in enumerate(dims):
        which = F.when(F.col("_g") == (2**n - 1) - 2 ** (n - 1 - i), d).otherwise(which) if i else F.when(F.col("_g") == (2**n - 1) - 2 ** (n - 1), d)
    return sets.select(which.alias("dimension"), F.coalesce(*dims).alias("value"), "n", "mean")


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, percents: Sequence[float]) -> DataFrame:
    """Nearest-rank percentiles: the value at place ceil(p * n) of the sorted values; null for keys without values.

    Values are counted, dealt by range, and placed behind the ranges before them,
    so a key with most of the rows is spread over all tasks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    v, n, part, start, total, end = (free(c, df) for c in ("value_", "n_", "part_", "start_", "total_", "end_"))
    counts = df.groupBy(*by, F.col(value).alias(v)).agg(F.count(value).alias(n))  # a null value counts 0
    counts = staged(counts.repartitionByRange(parts, *by, v).withColumn(part, F.spark_partition_id()))
    sums = counts.groupBy(*by, part).agg(F.sum(n).alias(n))  # a row for each key and range
    before = W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.struct(*by, part).alias("range_"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start), F.sum(n).over(W.partitionBy(*by)).alias(total))
    upto = W.partitionBy(*by, part).orderBy(v).rowsBetween(W.unboundedPreceding, 0)
    placed = counts.withColumn(end, F.sum(n).over(upto)).join(sums, F.struct(*by, part).eqNullSafe(F.col("range_")))
    placed = placed.withColumn(end, F.col(start) + F.col(end))

    def at(p: float) -> Column:
        place = F.greatest(F.col(total) * p, F.lit(0.5))
        return F.max(F.when((F.col(n) > 0) & (F.col(end) >= place) & (F.col(end) - F.col(n) < place), F.col(v)))

    return placed.groupBy(*by).agg(*[at(p).alias(f"p{int(p * 100)}") for p in percents])


def pivot_ladder(df: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Mean of ``value`` per row and stated column, and over each row's columns."""
    out = df.groupBy(row).pivot(column, list(columns)).agg(F.avg(value))
    shown = [F.col(f"`{c}`") for c in columns]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in shown[1:]), F.coalesce(shown[0], F.lit(0.0)))
    n = sum((c.isNotNull().cast("int") for c in shown[1:]), shown[0].isNotNull().cast("int"))
    return out.withColumn("mean", ratio(total, n))


def majority(df: DataFrame, by: Sequence[str], vote: Column) -> DataFrame:
    """Strict majority of boolean votes; a tie is false."""
    return df.groupBy(*by).agg(F.count_if(vote).alias("yes"), F.count(F.lit(1)).alias("n")).withColumn("majority", F.col("yes") * 2 > F.col("n"))


def gates(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """Metrics (name, value) against limits (name, low, high, severity): FAIL or REVIEW by severity outside of them, PASS inside."""
    out = limits.join(metrics, "name", "left")
    bad = F.col("value").isNull() | (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    return out.withColumn("verdict", F.when(F.coalesce(bad, F.lit(False)), F.col("severity")).otherwise("PASS"))


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds; null if none does."""
    out = F.lit(None).cast("string")
    for cond, name in reversed(rules):
        out = F.when(cond, name).otherwise(out)
    return out


def most_common(df: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    """Counts of each value with its place: more first, of equal ones the value seen first."""
    from pyspark.sql import Window as W

    out = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    return out.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "_first"))).drop("_first")


def verdict_counts(df: DataFrame, by: Sequence[str], verdict: str, verdicts: Sequence[str]) -> DataFrame:
    """Number of rows of each stated verdict, side by side, zeros kept."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), *[F.count_if(F.col(verdict) == v).alias(v) for v in verdicts])


def retrieval_recall(df: DataFrame, wanted: str, found: str) -> DataFrame:
    """Adds any_hit, all_found (of a non-empty wanted set) and recall (null if nothing is wanted)."""
    n = F.size(wanted)
    hit = F.size(F.array_intersect(wanted, found))
    return df.withColumn("any_hit", hit > 0).withColumn("all_found", (n > 0) & (hit == F.size(F.array_distinct(F.col(wanted))))).withColumn("recall", F.when(n > 0, hit / F.size(F.array_distinct(F.col(wanted)))))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Counts by value with nulls as "unknown", and each value's rank by count."""
    out = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return numbered_whole(out, [F.desc("n"), "value"], "place").withColumn("place", F.col("place") + 1)
