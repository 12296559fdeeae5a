"""The fold of changes as a stream: the state of every path lives in Spark's state store, by entity, and outlives restarts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidemark.operators.memory import Cell, apply_change

CELLS = "entity string, path string, version long, seq int, value string, status string, confidence double, valid_from int, valid_until int, last_confirmed_at int, source string, evidence array<string>, provenance string"
_PATHS = "array<struct<path: string, version: bigint, cells: array<struct<value: string, status: string, confidence: double, valid_from: int, valid_until: int, last_confirmed_at: int, source: string, evidence: array<string>, provenance: string>>>>"


def fold_stream(changes: DataFrame) -> DataFrame:
    """All cells of each (entity, path) that a micro-batch touches, after its changes: columns of CELLS.

    ``changes``: entity, path, op, value, month, seq, source. Within a
    micro-batch rows are folded by month and seq; a row that comes in a later one
    is applied after it. ``version`` counts the changes of the path so far, so
    the rows with the highest version are its state. Asking for the state reads
    what was written and changes nothing. State is kept for each entity, as what
    a group costs is far more than what a change does, and leaves Python as one
    text for each group.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        paths = {p: (n, [Cell(*c[:7], tuple(c[7]), c[8]) for c in cells]) for p, n, cells in json.loads(state.get[0])} if state.exists else {}
        touched = folded(paths, batches)
        state.update((json.dumps([(p, n, cells) for p, (n, cells) in paths.items()]),))
        shown = [{"path": p, "version": paths[p][0], "cells": [c._asdict() for c in paths[p][1]]} for p in touched]
        yield pd.DataFrame({"entity": [key[0]], "paths": [json.dumps(shown)]})

    out = changes.groupBy("entity").applyInPandasWithState(run, "entity string, paths string", "paths string", "update", GroupStateTimeout.NoTimeout)
    each = out.select("entity", F.explode(F.from_json("paths", _PATHS)).alias("p"))
    return each.select("entity", "p.path", "p.version", F.posexplode("p.cells").alias("seq", "c")).select("entity", "path", "version", "seq", "c.*")


def folded(paths: dict[str | None, tuple[int, list[Cell]]], batches: Iterator[pd.DataFrame]) -> dict[str | None, None]:
    """Applies the changes of one entity in one micro-batch, by month and seq, to ``paths`` (path: changes so far, cells); the paths that they touch."""
    plain = lambda v: None if v is None or v != v else v
    rows = [r for df in batches for r in zip(*(df[c].tolist() for c in ("month", "seq", "path", "op", "value", "source")))]
    rows.sort(key=lambda r: (r[0], r[1] != r[1], r[1]))  # a null seq is NaN and comes last
    touched = {}
    for month, _, path, op, value, source in rows:
        path = plain(path)
        n, cells = paths.get(path, (0, []))
        paths[path] = n + 1, apply_change(cells, op, plain(value), int(month), plain(source))
        touched[path] = None
    return touched


def fold_available(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, files_at_once: int = 1_000) -> DataFrame:
    """Fold what is new in the Parquet files of ``source`` and return the state of every path; a later run goes on from this one."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/batch={batch}")  # a batch that is repeated replaces itself

    fold_stream(stream).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    every = spark.read.schema(CELLS).option("basePath", target).parquet(target)
    newest = F.max("version").over(W.partitionBy("entity", "path"))
    return every.withColumn("_v", newest).filter(F.col("version") == F.col("_v")).drop("_v")
