"""Versioned state: an ordered fold of change events per key path, and queries on its versions.

One path never reads another, so a history is folded per (entity, path) and
spreads over as many groups as there are paths. The fold returns cell versions
as intervals, so the state at any point is a filter and not a replay. Rows are
sorted by Spark and folded as they pass; a task holds the cells of one history.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators._stage import dealt

#: Operations that each lifecycle status allows.
ALLOWED = {
    "weak_signal": ("set_pending", "needs_verification", "no_update"),
    "upcoming": ("set_pending", "needs_verification", "no_update"),
    "occurred": ("create", "update", "mark_stale", "archive", "needs_verification", "reactivate", "set_not_applicable", "no_update"),
    "cancelled": ("clear_pending", "no_update"),
    "no_event": ("no_update",),
}
#: Statuses that a new value closes, and those that do not count as committed.
OPEN = ("current", "needs_verification", "stale", "not_applicable", "unknown")
NOT_COMMITTED = ("pending", "cancelled", "historical")
#: Fixed value: a path whose equal values are separate facts.
REPEATABLE = ("cashflow.recent_one_off_expense",)

CELLS = "entity string, path string, seq int, value string, status string, confidence double, valid_from int, valid_until int, last_confirmed_at int, source string, evidence array<string>, provenance string"
APPLIED = "entity string, path string, op string, value string, month int, source string, old_value string, is_noop boolean, n_cells int"


class Cell(NamedTuple):
    value: str | None
    status: str
    confidence: float
    valid_from: int
    valid_until: int | None
    last_confirmed_at: int | None
    source: str | None
    evidence: tuple[str, ...] = ()
    provenance: str = "event_delta"


def _committed(cells: list[Cell]) -> int | None:
    return next((i for i in range(len(cells) - 1, -1, -1) if cells[i].status not in NOT_COMMITTED), None)


def apply_change(cells: list[Cell], op: str, value: str | None, month: int, source: str | None, evidence: Sequence[str] = ()) -> list[Cell]:
    """The versions of one path after one operation. An operation that is not known raises."""
    close = lambda cs: [c._replace(status="historical", valid_until=month) if c.status in OPEN else c for c in cs]
    own = [i for i, c in enumerate(cells) if c.status == "pending" and c.source == source]
    at = _committed(cells)
    put = lambda i, **kw: [c._replace(**kw) if k == i else c for k, c in enumerate(cells)]
    fresh = lambda v, status, conf: Cell(v, status, conf, month, None, None, source, tuple(evidence))
    match op:
        case "no_update":
            return cells
        case "set_initial":
            return [*cells, Cell(value, "current", 1.0, month, None, month, None, (), "initial")]
        case "create" | "update":
            if not own:
                return [*close(cells), fresh(value, "current", 1.0)]
            out = close(cells)
            for i in own[:-1]:
                out[i] = out[i]._replace(status="cancelled", valid_until=month)
            out[own[-1]] = fresh(value, "current", 1.0)._replace(last_confirmed_at=out[own[-1]].last_confirmed_at)
            return out
        case "mark_stale":
            return cells if at is None else put(at, status="stale", confidence=min(cells[at].confidence, 0.4))
        case "archive":
            return cells if at is None else put(at, status="historical", valid_until=month)
        case "needs_verification":
            return [*cells, fresh(None, "needs_verification", 0.3)] if at is None else put(at, status="needs_verification", confidence=min(cells[at].confidence, 0.6))
        case "set_pending":
            out = [c._replace(status="cancelled", valid_until=month) if c.status == "pending" and c.source != source else c for c in cells]
            if own:
                out[own[-1]] = out[own[-1]]._replace(value=value, valid_from=month, evidence=tuple(evidence))
                return out
            return [*out, fresh(value, "pending", 0.5)]
        case "clear_pending":
            out = [c._replace(status="cancelled", valid_until=month) if i in own else c for i, c in enumerate(cells)]
            return [c._replace(status="current", confidence=1.0) if c.status == "needs_verification" and c.source == source else c for c in out]
        case "reactivate":
            past = next((i for i in range(len(cells) - 1, -1, -1) if cells[i].status == "historical"), None)
            if past is None:
                return cells
            out = close(cells)
            out[past] = out[past]._replace(status="current", valid_from=month, valid_until=None)
            return out
        case "set_not_applicable":
            out = [c._replace(status="cancelled", valid_until=month) if i in own else c for i, c in enumerate(cells)]
            return [*close(out), fresh(None, "not_applicable", 1.0)]
    raise ValueError(f"not a memory operation: {op}")


def is_noop(cells: list[Cell], path: str, op: str, value: str | None, source: str | None) -> bool:
    """Whether an update engine leaves the change out because the state already says so."""
    at = _committed(cells)
    now = None if at is None else cells[at]
    mine = [c for c in cells if c.source == source]
    own = [c for c in mine if c.status == "pending"]
    match op:
        case "create" | "update":
            return path not in REPEATABLE and not own and now is not None and now.status == "current" and now.value == value
        case "mark_stale":
            return now is None or now.status == "stale"
        case "needs_verification":
            return now is not None and now.status == "needs_verification"
        case "archive":
            return now is None or now.status == "not_applicable"
        case "set_not_applicable":
            return not own and now is not None and now.status == "not_applicable"
        case "set_pending":
            return bool(own) and own[-1].value == value
        case "clear_pending":
            return not any(c.status in ("pending", "needs_verification") for c in mine)
    return False


def _ordered(changes: DataFrame, order: Sequence[str]) -> DataFrame:
    evidence = F.col("evidence") if "evidence" in changes.columns else F.expr("cast(array() as array<string>)")
    asked = F.col("old_value") if "old_value" in changes.columns else F.lit(None).cast("string")
    cols = ["entity", "path", "op", "value", F.col("month").cast("int").alias("month"), "source", evidence.alias("evidence"), asked.alias("old_value")]
    # a path is folded by one task: its changes depend on each other
    return dealt(changes, ["entity", "path"], order).select(*cols)


def fold(changes: DataFrame, order: Sequence[str] = ("month", "seq"), skip_noops: bool = False) -> DataFrame:
    """All cell versions after all changes: columns of CELLS.

    ``changes``: entity, path, op, value, month, source, maybe evidence (array of
    text), and the columns of ``order``. Rows are folded in that order within
    each entity and path; what they say of equal order is up to further columns
    of ``order``. ``skip_noops`` leaves out changes that ``is_noop``. A path
    without any cell has no row. An unknown operation raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cells, out = None, [], []
        for batch in batches:
            for entity, path, op, value, month, source, evidence in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if (entity, path) != key:
                    out += [(*key, i, *c) for i, c in enumerate(cells)] if key else []
                    key, cells = (entity, path), []
                    if len(out) > 20_000:
                        yield _rows(out, CELL_SCHEMA)
                        out = []
                if not (skip_noops and is_noop(cells, path, op, value, source)):
                    cells = apply_change(cells, op, value, month, source, evidence or ())
        out += [(*key, i, *c) for i, c in enumerate(cells)] if key else []
        if out:
            yield _rows(out, CELL_SCHEMA)

    return _ordered(changes, order).mapInArrow(run, CELLS)


def applied(changes: DataFrame, order: Sequence[str] = ("month", "seq")) -> DataFrame:
    """Each change with what the state held before it: columns of APPLIED.

    ``old_value`` is the committed value unless the change names one itself;
    ``is_noop`` whether an update engine would leave it out. Changes that are
    no-ops are not applied here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cells = None, []
        for batch in batches:
            out = []
            for entity, path, op, value, month, source, evidence, asked in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if (entity, path) != key:
                    key, cells = (entity, path), []
                at, skip = _committed(cells), is_noop(cells, path, op, value, source)
                old = asked if asked is not None or at is None else cells[at].value
                cells = cells if skip else apply_change(cells, op, value, month, source, evidence or ())
                out.append((entity, path, op, value, month, source, old, skip, len(cells)))
            yield _rows(out, APPLIED_SCHEMA)

    return _ordered(changes, order).mapInArrow(run, APPLIED)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


_TEXT, _INT = pa.string(), pa.int32()
CELL_SCHEMA = pa.schema([("entity", _TEXT), ("path", _TEXT), ("seq", _INT), ("value", _TEXT), ("status", _TEXT), ("confidence", pa.float64()), ("valid_from", _INT), ("valid_until", _INT), ("last_confirmed_at", _INT), ("source", _TEXT), ("evidence", pa.list_(_TEXT)), ("provenance", _TEXT)])
APPLIED_SCHEMA = pa.schema([("entity", _TEXT), ("path", _TEXT), ("op", _TEXT), ("value", _TEXT), ("month", _INT), ("source", _TEXT), ("old_value", _TEXT), ("is_noop", pa.bool_()), ("n_cells", _INT)])


def effective(cells: DataFrame) -> DataFrame:
    """The value that counts of each path: the last committed cell, else the last one that is not pending or cancelled; plus the live proposals."""
    committed = ~F.col("status").isin(*NOT_COMMITTED)
    usable = ~F.col("status").isin("pending", "cancelled")
    cell = F.struct("value", "status", "source")
    out = cells.groupBy("entity", "path").agg(
        F.max_by(cell, F.when(committed, F.col("seq"))).alias("c"), F.max_by(cell, F.when(usable, F.col("seq"))).alias("u"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "pending", F.col("value")))).alias("pending"), F.count_if(F.col("status") == "historical").alias("n_historical"),
    )
    e = F.coalesce("c", "u")
    shown = F.when(e["status"].isin("not_applicable", "unknown"), None).otherwise(e["value"])
    return out.select("entity", "path", shown.alias("value"), e["status"].alias("status"), e["source"].alias("source"), "pending", "n_historical")


def with_all_paths(states: DataFrame, paths: Sequence[str], entities: DataFrame | None = None) -> DataFrame:
    """``states`` (of ``effective``) with a row for each stated path of each entity: a path that has none has status unknown and no value.

    ``entities`` (entity) adds those without any state. Paths that are not stated
    are left out.
    """
    every = states.select("entity") if entities is None else states.select("entity").union(entities.select("entity"))
    grid = every.distinct().select("entity", F.explode(F.array(*map(F.lit, paths))).alias("path"))
    return grid.join(states, ["entity", "path"], "left").withColumn("status", F.coalesce("status", F.lit("unknown")))


def update_intervals(updates: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The fold of plain updates: each holds from its number until the next one's (null: still)."""
    w = W.partitionBy(*by).orderBy(*order)
    return updates.withColumn("version", F.row_number().over(w).cast("long")).withColumn("until", F.lead(order[0]).over(w))


def forbidden_operations(changes: DataFrame, status: str = "status", op: str = "op") -> DataFrame:
    """Changes that their lifecycle status does not allow; an unknown status allows nothing."""
    allowed = F.lit(False)
    for s, ops in ALLOWED.items():
        allowed = F.when(F.col(status) == s, F.col(op).isin(*ops)).otherwise(allowed)
    return changes.filter(~F.coalesce(allowed, F.lit(False)))


def dedupe_replay(changes: DataFrame, key: Sequence[str], order: Sequence[str], evidence: str) -> DataFrame:
    """First row of each replayed change, with the evidence of all its repeats."""
    out = changes.groupBy(*key).agg(F.min_by(F.struct(*[c for c in changes.columns if c not in key and c != evidence]), F.struct(*order)).alias("_f"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(evidence)))).alias(evidence))
    return out.select(*key, "_f.*", evidence)


def serialized(cells: DataFrame) -> DataFrame:
    """Every path's effective cell with its historical values (oldest first, nulls left out) and live proposals, for an export."""
    past = F.transform(F.array_sort(F.filter(F.collect_list(F.when((F.col("status") == "historical") & F.col("value").isNotNull(), F.struct("seq", "value"))), lambda x: x.isNotNull())), lambda x: x["value"])
    return effective(cells).join(cells.groupBy("entity", "path").agg(past.alias("historical_values")), ["entity", "path"])


def condition(when: dict[str, object], params: str) -> Column:
    """Whether a map of event parameters fulfils all of ``when``: a value to equal or a list to be in. A missing parameter is null, which equals only null."""
    out = F.lit(True)
    for name, wanted in when.items():
        have = F.col(params)[name]
        one = lambda w, have=have: have.eqNullSafe(F.lit(None if w is None else str(w)))
        options = wanted if isinstance(wanted, list) else [wanted]
        hit = F.lit(False)
        for w in options:
            hit = hit | one(w)
        out = out & hit
    return out


def template_changes(transitions: DataFrame, specs: DataFrame) -> DataFrame:
    """Changes that transitions cause by their templates, one row for each spec whose conditions hold.

    ``transitions``: entity, event, hook, status, params map<string,string>, month,
    instance, order. ``specs`` (a registry): event, hook, spec_no, path, op,
    value_from (``literal:x``, a parameter ``param:x``, or a plain value), wanted
    map<string,array<string>> (parameter to allowed values; an empty map always
    holds). A status that does not allow the operation raises.
    """
    hits = transitions.join(specs, ["event", "hook"])
    holds = F.forall(F.map_entries("wanted"), lambda e: F.coalesce(F.array_contains(e["value"], F.coalesce(F.try_element_at("params", e["key"]), F.lit("\0"))), F.lit(False)))
    allowed = F.lit(False)
    for s, ops in ALLOWED.items():
        allowed = F.when(F.col("status") == s, F.col("op").isin(*ops)).otherwise(allowed)
    bad = F.raise_error(F.concat_ws(" ", F.lit("operation not allowed:"), "event", "hook", "op", "status")).cast("string")
    source = F.col("value_from")
    value = F.when(source.startswith("literal:"), F.expr("substring(value_from, 9)")).when(source.startswith("param:"), F.try_element_at("params", F.expr("substring(value_from, 7)"))).otherwise(source)
    out = hits.filter(holds).withColumn("op", F.when(allowed, F.col("op")).otherwise(bad))
    return out.select("entity", "path", "op", value.alias("value"), "month", F.col("instance").alias("source"), "status", F.col("order"), "spec_no")
