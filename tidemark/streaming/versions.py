"""The fold of changes as a stream over typed state, and answers from its stored state.

Cells live in one value state for each entity, by path, beside a counter of the path's
changes: a group is asked for its state once and gives it back once, which is what it costs.
Answers at a checkpoint are read from the state store as it was after a batch:
reading takes nothing in and changes nothing, so the stream can go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.operators.memory import Cell
from tidemark.streaming.state import folded

_CELL = "value: string, status: string, confidence: double, valid_from: int, valid_until: int, last_confirmed_at: int, source: string, evidence: array<string>, provenance: string"
_STATE = f"paths array<struct<path: string, n_changes: bigint, cells: array<struct<{_CELL}>>>>"
TAKEN = "entity string, path string, n_changes long"
#: Typed state needs this state store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Fold(StatefulProcessor):
    """Folds the changes of one entity; its state is each path's cells and how many changes they have seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.paths = handle.getValueState("paths", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        stored = self.paths.get()
        paths = {p: (n, [Cell(*c[:7], tuple(c[7] or ()), c[8]) for c in cells]) for p, n, cells in (stored[0] if stored else ())}
        touched = folded(paths, rows)
        self.paths.update(([(p, n, [(*c[:7], list(c.evidence), c.provenance) for c in cells]) for p, (n, cells) in paths.items()],))
        yield pd.DataFrame({"entity": [key[0]] * len(touched), "path": [*touched], "n_changes": [paths[p][0] for p in touched]})

    def close(self) -> None:
        pass


def fold_typed(changes: DataFrame) -> DataFrame:
    """What was taken in: a row for each path that a batch touches, with its number of changes so far."""
    return changes.groupBy("entity").transformWithStateInPandas(Fold(), TAKEN, "update", "none")


def take_in(spark: SparkSession, source: str, schema: StructType, checkpoint: str, target: str, files_at_once: int = 1_000) -> None:
    """Fold what is new in the Parquet files of ``source``; a later call goes on from this one."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)
        put = lambda df, batch: df.write.mode("overwrite").parquet(f"{target}/batch={batch}")
        fold_typed(stream).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cells_at(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """The stored cells after a batch (null: the last): entity, path, seq, and the cell's fields."""
    reader = spark.read.format("statestore").option("stateVarName", "paths")
    state = (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)
    paths = state.select(F.col("key.entity").alias("entity"), F.explode("value.paths").alias("p"))
    return paths.select("entity", "p.path", F.posexplode("p.cells").alias("seq", "cell")).select("entity", "path", "seq", "cell.*")
