"""Operators over ordered rows of a key: prefixes, blocks, carried values, drift."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from tidemark.operators._stage import free


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "no") -> DataFrame:
    """Adds the place of each row in its key, from 1."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long"))


def numbered_whole(df: DataFrame, order: Sequence[Column | str], name: str = "no") -> DataFrame:
    """Adds the place of each row in the whole table, from 0: rows are dealt by range, and each range starts behind the rows of those before it.

    Ties have no stated order; give ``order`` enough columns.
    """
    from tidemark.operators._stage import staged

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = staged(rows.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(2**33 - 1)))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_start")))
    return rows.join(starts, "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def checkpoints(df: DataFrame, by: Sequence[str], no: str, stride: int, aggs: Sequence[Column]) -> DataFrame:
    """State of every prefix that ends at a multiple of ``stride``: rows are summed per block, and blocks run up.

    ``aggs`` are sums or counts with aliases. Prefixes are not collected. A last
    incomplete block has no checkpoint.
    """
    block = F.ceil(F.col(no) / stride).cast("long")
    sums = df.groupBy(*by, block.alias("block")).agg(*aggs, F.count(F.lit(1)).alias("_n"))
    names = [c for c in sums.columns if c not in (*by, "block", "_n")]
    run = W.partitionBy(*by).orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    out = sums.select(*by, (F.col("block") * stride).alias("checkpoint"), *[F.sum(c).over(run).alias(c) for c in names], "_n")
    return out.filter(F.col("_n") == stride).drop("_n")


def tumbling_blocks(df: DataFrame, by: Sequence[str], no: str, size: int) -> DataFrame:
    """Blocks of ``size`` rows: block, n, first and last number, and whether the block is whole and without gap."""
    out = df.groupBy(*by, F.ceil(F.col(no) / size).cast("long").alias("block")).agg(F.count(F.lit(1)).alias("n"), F.min(no).alias("first_no"), F.max(no).alias("last_no"))
    return out.withColumn("whole", (F.col("n") == size) & (F.col("last_no") - F.col("first_no") == size - 1))


def exact_windows(df: DataFrame, by: Sequence[str], window: str, position: str, size: int, target: Column, key: str) -> DataFrame:
    """Windows that hold each position 1..size once, and one target: by, window, target (its ``key``), last (the key at the last position).

    A window with other positions, or with no target or several, raises; nothing
    is gathered to find out.
    """
    wrong = F.raise_error(F.concat(F.lit(f"not positions 1 to {size} with one target: "), F.to_json(F.struct(*by, window)))).cast("boolean")
    hit = F.coalesce(target, F.lit(False))
    sums = df.groupBy(*by, window).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(position).alias("n_distinct"), F.min(position).alias("low"), F.max(position).alias("high"), F.count_if(hit).alias("n_targets"),
        F.max(F.when(hit, F.col(key))).alias("target"), F.max_by(key, position).alias("last"),
    )
    fine = (F.col("n") == size) & (F.col("n_distinct") == size) & (F.col("low") == 1) & (F.col("high") == size) & (F.col("n_targets") == 1)
    return sums.filter(F.when(F.coalesce(fine, F.lit(False)), True).otherwise(wrong)).select(*by, window, "target", "last")


def carry_forward(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], repeats: str) -> DataFrame:
    """Fills ``columns`` of rows flagged ``repeats`` from the last row that is not flagged."""
    run = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    held = F.last(F.when(~F.coalesce(F.col(repeats), F.lit(False)), F.struct(*columns)), ignorenulls=True).over(run)
    h = free("held", df)
    return df.withColumn(h, held).withColumns({c: F.col(f"{h}.{c}") for c in columns}).drop(h)


def flag_repeats(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The inverse: blanks ``columns`` and sets ``repeats`` where they equal those of the row before."""
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    d = free("digest", df)
    out = df.withColumn(d, digest).withColumn("repeats", F.coalesce(F.col(d) == F.lag(d).over(W.partitionBy(*by).orderBy(*order)), F.lit(False)))
    return out.withColumns({c: F.when(~F.col("repeats"), F.col(c)) for c in columns}).drop(d)


def latest_at(df: DataFrame, by: Sequence[str], within: Sequence[str], no: str, stride: int, value: str) -> DataFrame:
    """Value of the last row of each ``by`` at every checkpoint of its ``within``: rows are intervals [checkpoint, next)."""
    cp = (F.ceil(F.col(no) / stride) * stride).cast("long")
    last = df.groupBy(*by, cp.alias("checkpoint")).agg(F.max_by(value, no).alias(value))
    ends = df.groupBy(*within).agg((F.floor(F.max(no) / stride) * stride).cast("long").alias("_end"))
    nxt = F.lead("checkpoint").over(W.partitionBy(*by).orderBy("checkpoint"))
    spans = last.withColumn("_to", nxt).join(ends, list(within)).filter("checkpoint <= _end")
    upto = F.coalesce(F.col("_to") - stride, F.col("_end"))
    return spans.withColumn("checkpoint", F.explode(F.sequence("checkpoint", F.least(upto, F.col("_end")), F.lit(stride).cast("long")))).drop("_to", "_end")


def newly_seen(df: DataFrame, by: Sequence[str], order: str, items: str) -> DataFrame:
    """Items of each row's set that the row before did not have, and those that went."""
    before = F.coalesce(F.lag(items).over(W.partitionBy(*by).orderBy(order)), F.expr(f"filter({items}, x -> false)"))
    b = free("before", df)
    return df.withColumn(b, before).withColumn("came", F.array_sort(F.array_except(items, b))).withColumn("went", F.array_sort(F.array_except(b, items))).drop(b)


def regressions(df: DataFrame, by: Sequence[str], order: Sequence[str], rank: Column) -> DataFrame:
    """Rows whose rank is below that of the row before; ``rank`` null rows are left out."""
    ranked = df.withColumn("rank", rank).filter("rank is not null")
    w = W.partitionBy(*by).orderBy(*order)
    return ranked.withColumn("rank_before", F.lag("rank").over(w)).filter("rank < rank_before")


def drift(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, hit: Column) -> DataFrame:
    """First and last value among hits, their difference, place of the first hit (from 0) and the share of hits after it."""
    at = F.struct(*order)
    n = F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1
    rows = df.withColumn("_n", n).withColumn("_hit", hit)
    out = rows.groupBy(*by).agg(
        F.min(F.when(F.col("_hit"), F.col("_n"))).cast("long").alias("lag"), F.min_by(value, F.when(F.col("_hit"), at)).alias("first_value"), F.max_by(value, F.when(F.col("_hit"), at)).alias("last_value"),
        F.count_if("_hit").alias("hits"), F.count(F.lit(1)).alias("n"),
    )
    after = F.col("n") - F.col("lag")
    return out.withColumn("drift", F.col("last_value") - F.col("first_value")).withColumn("retention", F.when(F.col("lag").isNotNull(), F.col("hits") / after))


def lag_bucket(lag: Column) -> Column:
    """Eight buckets of a distance in sessions."""
    edges = ((0, "0"), (15, "1-15"), (30, "16-30"), (60, "31-60"), (120, "61-120"), (180, "121-180"), (240, "181-240"))
    out = F.when(lag <= edges[0][0], edges[0][1])
    for hi, name in edges[1:]:
        out = out.when(lag <= hi, name)
    return out.otherwise("241+")


def spread_slot(place: Column, count: Column, most: int, draw: Column) -> Column:
    """A slot in the ``place``-th (from 0) of ``count`` equal stretches of 1..most; ``draw`` (0 or more) picks it, modulo the stretch's width. Null where the stretch holds no slot, as with more rows than slots."""
    low = F.floor(place * most / count) + 1
    width = F.floor((place + 1) * most / count) - low + 1
    return F.when(width > 0, low + F.pmod(draw, F.greatest(width, F.lit(1)))).cast("int")


def increasing_slots(df: DataFrame, by: Sequence[str], order: Sequence[str], wanted: str, most: int, earliest: str | None = None, crowded: bool = False) -> DataFrame:
    """Slots in 1..most in the order of a key's rows: adds slot, shifted (not the wanted one; null without a wish) and tied (the slot of the row before).

    A row takes the latest of its wish, its ``earliest`` slot (null: none) and
    the slot after the one before it, as long as that leaves a slot for each row
    to come. Where it does not, the row keeps its wish and its floor, and may
    share the slot before it, but never passes ``most``. A key with more than
    ``most`` rows raises; with ``crowded`` its rows share slots by the same rule.
    Rows go by in order, so a key of any size needs one slot of memory.
    """
    w = W.partitionBy(*by).orderBy(*order)
    n, ahead, floor, wish = (free(c, df) for c in ("n", "ahead", "floor", "wish_"))
    size = F.count(F.lit(1)).over(W.partitionBy(*by)).cast("int")
    too_many = F.raise_error(F.concat(F.lit(f"more than {most} rows of a key: "), F.to_json(F.struct(*by)))).cast("int")
    total = size if crowded else F.when(size > most, too_many).otherwise(size)
    least = F.greatest(F.col(wanted), F.coalesce(F.col(earliest), F.lit(1)) if earliest else F.lit(1)).cast("int")
    rows = df.select(*df.columns, F.row_number().over(w).alias(n), total.alias(ahead), least.alias(floor), F.col(wanted).cast("int").alias(wish))
    rows = rows.withColumn(ahead, F.col(ahead) - F.col(n)).sortWithinPartitions(*by, n)
    kept = len(df.columns)
    schema = StructType([*df.schema.fields, StructField("slot", IntegerType()), StructField("shifted", BooleanType()), StructField("tied", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0
        for batch in batches:
            out = []
            for place, behind, low, hoped in zip(*(batch.column(kept + k).to_pylist() for k in range(4))):
                last = 0 if place == 1 else last
                slot = max(low, last + 1)
                fits = slot <= most - behind
                slot = slot if fits else min(max(low, last), most)
                out.append((slot, None if hoped is None else slot != hoped, not fits and slot == last))
                last = slot
            made = zip(*out) if out else ((), (), ())
            arrays = [pa.array(c, t) for c, t in zip(made, (pa.int32(), pa.bool_(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *arrays], names=schema.names)

    return rows.mapInArrow(run, schema)


def not_increasing(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, gap: int = 0) -> DataFrame:
    """Rows whose value is not at least ``gap`` above that of the row before."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("before", F.lag(value).over(w)).filter(F.col(value) - F.col("before") < gap)
