"""Structured Streaming forms of the event operators; the transformations also take a batch table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared ``spark.checkpoint.dir``; a temporary one where that is unset and Spark runs on this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: executors and driver need a shared folder")
    base = base or tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def source(folder: str, name: str) -> str:
    """A path for ``readStream`` that may be a file or a folder: written as a pattern, it is not taken for a folder."""
    return f"{folder}/{name[:-1]}[{name[-1]}]"


def with_event_time(df: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """``ts`` as a timestamp with time zone, which a stream's watermark needs, and the watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(df: DataFrame, width: str, by: Sequence[str], aggs: Sequence[Column], ts: str = "ts", slide: str | None = None) -> DataFrame:
    """Aggregates by tumbling windows, or sliding ones with ``slide``."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return _bounds(df.groupBy(w.alias("w"), *by).agg(*aggs))


def sessions(df: DataFrame, gap: str, by: Sequence[str], aggs: Sequence[Column], ts: str = "ts") -> DataFrame:
    """Aggregates by sessions that end after ``gap`` without a row."""
    return _bounds(df.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(*aggs))


def _bounds(out: DataFrame) -> DataFrame:
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c != "w"])


def deduplicated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each key within the watermark; in batch, one row for each key."""
    return df.dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))


def write_available(spark: SparkSession, make: Callable[[DataFrame], DataFrame], source: str, schema: StructType, target: str, checkpoint: str) -> None:
    """Stream the Parquet files of ``source`` through ``make`` into a Parquet table: exactly once, and a later run goes on where this one ended."""
    stream = spark.readStream.schema(schema).parquet(source)
    make(stream).writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def totals_available(spark: SparkSession, make: Callable[[DataFrame], DataFrame], source: str, schema: StructType, target: str, checkpoint: str) -> DataFrame:
    """The same for aggregates: each batch writes the complete totals so far into a folder of its own, the last one is returned."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    stream = make(spark.readStream.schema(schema).parquet(source))
    stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    every = spark.read.schema(f"batch long, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}").option("basePath", target).parquet(target)
    return every.join(every.agg(F.max("batch").alias("batch")), "batch", "left_semi").drop("batch")
