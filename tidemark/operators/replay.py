"""Stored snapshots against the state that the changes lead to."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.operators._stage import dealt
from tidemark.operators.memory import NOT_COMMITTED, Cell, apply_change

FOUND = "entity string, path string, month int, code string"
_FOUND = pa.schema([("entity", pa.string()), ("path", pa.string()), ("month", pa.int32()), ("code", pa.string())])


def effective_cell(cells: Sequence[Cell]) -> Cell | None:
    """The cell that counts: the last committed one, else the last that is not pending or cancelled."""
    committed = [c for c in cells if c.status not in NOT_COMMITTED]
    usable = committed or [c for c in cells if c.status not in ("pending", "cancelled")]
    return usable[-1] if usable else None


def snapshot_differences(changes: DataFrame, snapshots: DataFrame, order: Sequence[str] = ("month", "seq"), taken: DataFrame | None = None) -> DataFrame:
    """Where snapshots differ from the state at the end of their month: entity, path, month, code.

    ``snapshots``: entity, month, path, value, status. An entity has a snapshot
    in each month of its rows and in those that ``taken`` names (entity, month; a
    snapshot that lost all of its rows is known from there only), and it holds all
    paths that have a value that counts. Codes: unknown_path (no such state), missing_in_snapshot,
    status_differs, value_differs; one for each path and month. Changes and
    snapshots go by in one pass, merged by month, so no month is folded twice;
    an entity and path is one task's. Rows without entity or path are left out.
    """
    months = snapshots.select("entity", F.col("month").cast("int").alias("month"))
    months = (months if taken is None else months.union(taken.select("entity", F.col("month").cast("int")))).distinct()
    paths = changes.select("entity", "path").union(snapshots.select("entity", "path")).filter("path is not null").distinct()
    held = snapshots.select("entity", "path", F.col("month").cast("int").alias("month"), F.struct("value", "status").alias("held"))
    asked = months.join(paths, "entity").join(held, ["entity", "path", "month"], "left")
    at = F.struct(*[F.col(c).cast("long") for c in order if c != "month"])
    change = F.struct("op", "value", "source").alias("change")
    rows = changes.select("entity", "path", F.col("month").cast("int").alias("month"), F.lit(0).alias("side"), at.alias("at"), change).unionByName(asked.withColumn("side", F.lit(1)), allowMissingColumns=True)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, cells = None, []
        for batch in batches:
            out = []
            for entity, path, month, side, change, held in zip(*(c.to_pylist() for c in batch.columns)):
                if (entity, path) != group:
                    group, cells = (entity, path), []
                if not side:
                    cells = apply_change(cells, change["op"], change["value"], month, change["source"])
                    continue
                now = effective_cell(cells)
                value = None if now is None or now.status in ("not_applicable", "unknown") else now.value
                code = None
                if now is None or held is None:
                    code = "unknown_path" if held else "missing_in_snapshot" if now else None
                elif held["status"] != now.status:
                    code = "status_differs"
                elif held["value"] != value:
                    code = "value_differs"
                if code:
                    out.append((entity, path, month, code))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, _FOUND.types)], schema=_FOUND)

    ordered = dealt(rows.filter("entity is not null and path is not null"), ["entity", "path"], ["month", "side", "at"])
    return ordered.select("entity", "path", "month", "side", "change", "held").mapInArrow(merge, FOUND)


def orphans(changes: DataFrame, instances: DataFrame, code: str) -> DataFrame:
    """Changes whose source is no instance of their entity: entity, path, month, code."""
    known = instances.select("entity", "source").distinct()
    lost = changes.filter("entity is not null and source is not null").join(known, ["entity", "source"], "left_anti")
    return lost.select("entity", "path", F.col("month").cast("int").alias("month"), F.lit(code).alias("code"))


def replay_audit(changes: DataFrame, snapshots: DataFrame, instances: DataFrame, order: Sequence[str] = ("month", "seq"), taken: DataFrame | None = None) -> DataFrame:
    """All that a replay finds: differences of snapshots, and orphan_update for changes of no instance."""
    return snapshot_differences(changes, snapshots, order, taken).unionByName(orphans(changes, instances, "orphan_update"))
