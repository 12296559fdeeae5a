"""Importance resampling towards a target distribution over hashed n-grams.

Every run of one to three words is a feature; its bucket is its crc32 modulo
``BUCKETS``. How much more often a bucket occurs in the target than in the
corpus is its gain; a document weighs the sum of its features' gains. Documents
are drawn without replacement by adding seeded Gumbel noise to the weights and
taking the highest scores.

All work is in Spark SQL: the hashed n-gram arrays are made once and kept,
exploded and counted by bucket (``BUCKETS`` groups at most, summed in the map
tasks first), joined with the gains (a broadcast of ``BUCKETS`` rows, whatever
the corpus) and summed by document. Ranks come from a range partition by score:
each row's place in its partition plus the rows of the partitions before it, so
no window holds the corpus.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm._common import materialize, parts

#: Buckets of the hashed features; longest run of words; least words of a document that may be drawn.
BUCKETS, LONGEST, LEAST_WORDS = 10_000, 3, 20
#: What stands between words; they hold digits, letters of any script, and whatever else is not ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """Words of a text, A-Z in lower case; null: none."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)  # all ASCII: the built-in lower case is the same, and faster
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, BETWEEN), "")


def hashed(words: Column, longest: int = LONGEST, buckets: int = BUCKETS) -> Column:
    """Buckets of all runs of 1 to ``longest`` words, repeats kept, the shorter runs first."""

    def of_length(n: int) -> Column:
        def run(word: Column, i: Column) -> Column:
            rest = [c for k in range(1, n) for c in (F.lit(" "), F.get(words, i + k))]  # null behind the last word
            return (F.crc32(F.concat(word, *rest)) % buckets).cast("int")

        return F.slice(F.transform(words, run), F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))

    return F.concat(*[of_length(n) for n in range(1, longest + 1)])


def bucket_counts(df: DataFrame, name: str) -> DataFrame:
    """How often each bucket occurs in the column ``buckets``."""
    return df.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A row for each bucket: floor(1000 * log ratio of its smoothed shares in target and source)."""
    spark = source.sparkSession
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(bucket_counts(source, "s"), "bucket", "left").join(bucket_counts(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    ratio = ((d("t") + 1) * (d("all_s") + buckets)) / ((d("s") + 1) * (d("all_t") + buckets))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))  # sums is one row


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) of a document, from a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, 3...) in the given total order, from a range partition and the sizes of the partitions before."""
    spark = rows.sparkSession
    placed = rows.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = materialize(placed, "ranked").withColumn("slice", F.shiftright("place", 33))
    sizes = placed.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # one row for each partition
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(offsets), "slice").withColumn("rank", rank).drop("slice", "place", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, least_words: int = LEAST_WORDS) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_features, weight, score, rank.

    ``target`` has ``text``. ``rank`` counts the drawn documents from the highest
    score on and is null for those not drawn: of the N documents with at least
    ``least_words`` words, floor(percent * N / 100) are drawn. Ties go to the
    smaller doc_id, a null id last, then to the fewer features; equal rows are
    ranked one after the other. A null text has no words and weighs 0; a null id
    draws its noise as an empty one. An empty table gives an empty result; an
    empty target weighs like a uniform one. Other columns are not looked at.
    """
    slim = docs.select("doc_id", terms(F.col("text")).alias("words"))
    n = F.size("words").cast("long")
    count = sum((F.greatest(n - k, F.lit(0)) for k in range(1, LONGEST)), n)
    rows = materialize(slim.select("doc_id", n.alias("n_words"), count.alias("n_features"), hashed(F.col("words")).alias("buckets"), F.monotonically_increasing_id().alias("row")), "buckets")
    wanted = target.select(terms(F.col("text")).alias("words")).select(hashed(F.col("words")).alias("buckets"))
    gain = F.broadcast(materialize(gains(rows, wanted), "gains"))  # ``BUCKETS`` rows
    keys = ["row", "doc_id", "n_words", "n_features"]
    summed = rows.select(*keys, F.explode_outer("buckets").alias("bucket")).join(gain, "bucket", "left").groupBy(*keys).agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    scored = materialize(summed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    may = scored.filter(F.col("n_words") >= least_words)
    draw = may.agg(F.expr(f"({percent} * count(1)) div 100").alias("draw"))
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("row").asc())
    drawn = ranked(may, *order).crossJoin(F.broadcast(draw)).withColumn("rank", F.when(F.col("rank") <= F.col("draw"), F.col("rank")))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    cols = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn.select(cols).unionByName(rest.select(cols))
