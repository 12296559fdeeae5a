"""Runs that share prefixes: state is worked out once for each node of their prefix tree and handed to its children.

A run is one variant of an entity's history, an ordered list of changes. Equal
beginnings of an entity's runs are the same nodes, told by a sum of 128 bits over
(place, change), so no run is gathered to find them. A change only reads its own
path, so a node needs no more than the state of the nearest node above it that
touches the same path. Nodes are dealt by entity and path and come by depth; a
state is kept until the last node that starts from it has come. Cells are never
changed in place, so handing a state to several children is no copy.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators._stage import dealt, free, tasks_for
from tidemark.operators.memory import CELL_SCHEMA, CELLS, Cell, _rows, apply_change

_CHANGE = ["op", "value", "month", "source"]
_LOW = (1 << 32) - 1


def prefix_nodes(changes: DataFrame, run: Sequence[str], order: Sequence[Column | str], content: Sequence[str]) -> DataFrame:
    """``changes`` with ``depth`` (place in the run, from 1) and ``na``, ``nb``, which name the run's rows up to this one.

    Rows of equal content in the same places are equal nodes, whatever the run.
    Contents are hashed before they are put in order, so that a caller who needs
    only the names sorts no more than these.
    """
    w = W.partitionBy(*run).orderBy(*order)
    a, b = free("one", changes), free("two", changes)
    rows = changes.withColumns({a: F.xxhash64(*content), b: F.xxhash64(F.lit(1), *content)}).withColumn("depth", F.row_number().over(w).cast("long"))
    one, two = F.xxhash64("depth", a), F.xxhash64(b, "depth")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    part = lambda c: F.sum(c).over(upto).bitwiseAND(F.lit(_LOW))
    name = lambda c: F.shiftleft(part(F.shiftrightunsigned(c, 32)), 32).bitwiseOR(part(c.bitwiseAND(F.lit(_LOW))))
    return rows.withColumns({"na": name(one), "nb": name(two)}).drop(a, b)


def shared_work(nodes: DataFrame, by: Sequence[str], run: Sequence[str]) -> DataFrame:
    """Of each ``by``: n_changes (all rows of all runs), n_nodes (what has to be worked out), n_clones (children of nodes with several)."""
    w = W.partitionBy(*run).orderBy("depth")
    kids = nodes.withColumns({"pa": F.coalesce(F.lag("na").over(w), F.lit(0)), "pb": F.coalesce(F.lag("nb").over(w), F.lit(0))})
    # a run has a node once: to count before they are dealt would hold them all and save nothing
    tasks = tasks_for(nodes)
    each = kids.select(*by, "na", "nb", "pa", "pb").repartition(tasks, "na", "nb").groupBy(*by, "na", "nb").agg(F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.count(F.lit(1)).alias("n"))
    above = each.repartition(tasks, "pa", "pb").groupBy(*by, "pa", "pb").agg(F.count(F.lit(1)).alias("kids"), F.sum("n").alias("n"))
    return above.groupBy(*by).agg(F.sum("n").alias("n_changes"), F.sum("kids").alias("n_nodes"), F.coalesce(F.sum(F.when(F.col("kids") > 1, F.col("kids"))), F.lit(0)).alias("n_clones"))


def forked_fold(changes: DataFrame, run: str = "run", order: Sequence[Column | str] = ("month", "seq")) -> DataFrame:
    """The cells of every run's paths after all of its changes: ``run`` and the columns of CELLS.

    ``changes``: entity, ``run``, path, op, value, month, source, maybe evidence,
    and the columns of ``order``, which must order a run's rows. The result is
    that of folding each run from scratch; shared beginnings are folded once.
    An entity and path with very many nodes is one task, as in ``memory.fold``.
    """
    tasks = tasks_for(changes)
    if "evidence" not in changes.columns:
        changes = changes.withColumn("evidence", F.expr("cast(array() as array<string>)"))
    content = [*_CHANGE, "evidence"]
    rows = prefix_nodes(changes.select("entity", run, "path", *content, *[c for c in order if isinstance(c, str) and c not in content]), ["entity", run], order, ["entity", "path", *content])
    own = W.partitionBy("entity", run, "path").orderBy("depth")
    rows = rows.withColumns({"pa": F.lag("na").over(own), "pb": F.lag("nb").over(own), "last": F.lead("na").over(own).isNull()})
    key = ["na", "nb"]  # of one entity and path
    nodes = rows.repartition(tasks, *key).groupBy(*key).agg(*[F.first(c).alias(c) for c in ("entity", "path", "depth")], F.first(F.struct("pa", "pb")).alias("p"), F.max("last").alias("ends"), F.first(F.struct(*content)).alias("c"))
    starts = nodes.select("p.pa", "p.pb").repartition(tasks, "pa", "pb").groupBy(F.col("pa").alias("na"), F.col("pb").alias("nb")).agg(F.count(F.lit(1)).alias("n_next"))
    nodes = nodes.join(starts, key, "left").fillna(0, ["n_next"])
    flat = ["entity", "path", *key, "depth", "p.pa", "p.pb", "n_next", "ends", "c.op", "c.value", F.col("c.month").cast("int").alias("month"), "c.source", "c.evidence"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, states = None, {}
        for batch in batches:
            out = []
            for entity, path, na, nb, _, ua, ub, n_next, ends, op, value, month, source, evidence in zip(*(c.to_pylist() for c in batch.columns)):
                if (entity, path) != group:
                    group, states = (entity, path), {}
                cells = []
                if ua is not None:
                    held = states[ua, ub]
                    cells, held[1] = held[0], held[1] - 1
                    if not held[1]:
                        del states[ua, ub]
                cells = apply_change(cells, op, value, month, source, evidence or ())
                if n_next:
                    states[na, nb] = [cells, n_next]
                if ends:
                    out += [(na, nb, entity, path, i, *c) for i, c in enumerate(cells)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(_NODE_CELLS), _NODE_CELLS.types)], schema=_NODE_CELLS)

    cells = dealt(nodes.select(*flat), ["entity", "path"], ["depth"], tasks).mapInArrow(fold, f"na long, nb long, {CELLS}")
    return rows.filter("last").select(run, *key).repartition(tasks, *key).join(cells, key).select(run, *[f.name for f in CELL_SCHEMA])


_NODE_CELLS = pa.schema([("na", pa.int64()), ("nb", pa.int64()), *CELL_SCHEMA])


def resumed_fold(snapshot: DataFrame, changes: DataFrame, order: Sequence[str] = ("month", "seq")) -> DataFrame:
    """The fold of ``changes`` that goes on from ``snapshot``, cells of an earlier fold: columns of CELLS.

    Paths without a change keep their cells and do not go through Python.
    """
    names = [f.name for f in CELL_SCHEMA]
    touched = changes.select("entity", "path").distinct()
    rest = snapshot.select(names).join(touched, ["entity", "path"], "left_anti")
    before = snapshot.join(touched, ["entity", "path"], "left_semi").select("entity", "path", F.lit(0).alias("side"), F.col("seq").cast("long").alias("at"), F.struct(*names[2:]).alias("cell"))
    evidence = F.col("evidence") if "evidence" in changes.columns else F.expr("cast(array() as array<string>)")
    change = F.struct("op", "value", F.col("month").cast("int").alias("month"), "source", evidence.alias("evidence")).alias("change")
    place = F.row_number().over(W.partitionBy("entity", "path").orderBy(*order)).cast("long")
    after = changes.select("entity", "path", F.lit(1).alias("side"), place.alias("at"), change)
    rows = before.unionByName(after, allowMissingColumns=True).select("entity", "path", "side", "at", "cell", "change")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, cells, out = None, [], []
        schema = CELL_SCHEMA
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(schema), schema.types)], schema=schema)
        for batch in batches:
            for entity, path, side, _, cell, change in zip(*(c.to_pylist() for c in batch.columns)):
                if (entity, path) != group:
                    out += [(*group, i, *c) for i, c in enumerate(cells)] if group else []
                    group, cells = (entity, path), []
                if side:
                    cells = apply_change(cells, change["op"], change["value"], change["month"], change["source"], change["evidence"] or ())
                else:
                    cells.append(Cell(**{k: tuple(v) if k == "evidence" else v for k, v in cell.items() if k != "seq"}))
            yield table(out)
            out = []
        yield table([(*group, i, *c) for i, c in enumerate(cells)] if group else [])

    folded = dealt(rows, ["entity", "path"], ["side", "at"]).mapInArrow(fold, CELLS)
    return rest.unionByName(folded.select(names))


def masked_runs(changes: DataFrame, levels: Mapping[str, Sequence[str]], terminal: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Counterfactual runs of each case, a row for each change that stays: ``changes`` with event, level and run.

    ``changes``: entity, path, op, value, month, source (the event instance),
    kind (session type), columns of ``order``; rows without entity, path or
    source are of no case. A case is an event with a session
    of a ``terminal`` kind; it is looked at where its last session stands. Each
    of ``levels`` names the kinds of the event's sessions that are masked. A path
    that the event does not touch is the same at all levels and is left out, so
    what is folded again is the paths that can change, from the first masked
    change on; what stands before it is one prefix of all levels.
    """
    at = F.struct(*order)
    cases = changes.groupBy("entity", F.col("source").alias("event")).agg(F.max(at).alias("until"), F.count_if(F.col("kind").isin(*terminal)).alias("n")).filter("n > 0 and event is not null")
    touched = changes.filter("op <> 'no_update'").select("entity", F.col("source").alias("event"), "path").distinct()
    rows = changes.join(touched.join(cases.drop("n"), ["entity", "event"]), ["entity", "path"]).filter(at <= F.col("until")).drop("until")
    kinds = F.lit(None).cast("array<string>")
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), (F.array(*map(F.lit, v)) if v else kinds).alias("masked")) for k, v in levels.items()]))
    rows = rows.select("*", named.alias("_level")).select(*rows.columns, F.col("_level.level").alias("level"), F.col("_level.masked").alias("_masked"))
    gone = (F.col("source") == F.col("event")) & F.coalesce(F.array_contains("_masked", F.col("kind")), F.lit(False))
    return rows.filter(~F.coalesce(gone, F.lit(False))).drop("_masked").withColumn("run", F.struct("event", "level"))


def counterfactual_states(changes: DataFrame, levels: Mapping[str, Sequence[str]], terminal: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The touched paths' cells at every level of every case: event, level and the columns of CELLS. A path that a mask empties has no row.

    These are the folds of ``masked_runs``, which are not written out: a path's
    changes pass once, and runs whose rows were the same so far are one state.
    A level leaves the path's own state with the first row that it masks; levels
    that mask the same rows go on together, until the case's last session.
    """
    at = F.struct(*order)
    if "evidence" not in changes.columns:
        changes = changes.withColumn("evidence", F.expr("cast(array() as array<string>)"))
    cases = changes.groupBy("entity", F.col("source").alias("event")).agg(F.max(at).alias("until"), F.count_if(F.col("kind").isin(*terminal)).alias("n")).filter("n > 0 and event is not null and entity is not null").select("entity", "event", "until")
    rows = changes.filter("entity is not null and path is not null").select("entity", "path", *_CHANGE, "evidence", "kind", at.alias("at"))
    # a case's own rows tell the path when it ends
    rows = rows.join(cases.withColumnRenamed("event", "source"), ["entity", "source"], "left")
    rows = rows.select("entity", "path", "at", "until", "op", "value", F.col("month").cast("int").alias("month"), "source", "evidence", "kind")
    masks = [(level, frozenset(kinds)) for level, kinds in levels.items()]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, trunk, out = None, [], []
        cases: dict[str, _Case] = {}

        def end(done: list[str]) -> None:
            for event in done:
                case = cases.pop(event)
                if case.touched:
                    for cells, names in [(trunk, case.whole), *case.forks]:
                        out.extend((event, level, *key, i, *c) for level in names for i, c in enumerate(cells))

        for batch in batches:
            for entity, path, here, until, op, value, month, source, evidence, kind in zip(*(c.to_pylist() for c in batch.columns)):
                if (entity, path) != key:
                    end([*cases])
                    key, trunk = (entity, path), []
                here = _placed(here)
                end([e for e, case in cases.items() if case.until < here])
                if until is not None and source not in cases:
                    cases[source] = _Case(_placed(until), [level for level, _ in masks], [])
                change = lambda cells: apply_change(cells, op, value, month, source, evidence or ())  # noqa: E731, B023
                for event, case in cases.items():
                    if event == source:
                        gone = {level for level, kinds in masks if kind in kinds}
                        case.split(trunk, gone)
                        case.touched = case.touched or op != "no_update"
                        case.forks = [(cells if names[0] in gone else change(cells), names) for cells, names in case.forks]
                    else:
                        case.forks = [(change(cells), names) for cells, names in case.forks]
                trunk = change(trunk)
                if len(out) > 20_000:
                    yield _rows(out, _CASE_CELLS)
                    out.clear()
        end([*cases])
        if out:
            yield _rows(out, _CASE_CELLS)

    return dealt(rows, ["entity", "path"], ["at"]).mapInArrow(fold, f"event string, level string, {CELLS}")


def _placed(at: dict) -> tuple:
    """A place in the order that compares as Spark's structs do: null first."""
    return tuple((v is not None, v) for v in at.values())


_CASE_CELLS = pa.schema([("event", pa.string()), ("level", pa.string()), *CELL_SCHEMA])


@dataclass
class _Case:
    """A case as a path's changes pass: when it ends, the levels that are still as the path itself, and the states that others have in common."""

    until: tuple
    whole: list[str]
    forks: list[tuple[list[Cell], list[str]]]
    touched: bool = False

    def split(self, trunk: list[Cell], gone: set[str]) -> None:
        """Parts the levels of every state into those that mask a row and those that do not."""
        states = [(trunk, [n for n in self.whole if n in gone])]
        self.whole = [n for n in self.whole if n not in gone]
        for cells, names in self.forks:
            states += [(cells, [n for n in names if n in gone]), (cells, [n for n in names if n not in gone])]
        self.forks = [(cells, names) for cells, names in states if names]


def counterfactual_verdicts(states: DataFrame, full: str, last: str) -> DataFrame:
    """Of each case: whether the event's own cells are all gone at level ``last`` (target_gone), how many it had at ``full``, and how many cells of others differ between them (n_moved)."""
    mine = F.coalesce(F.col("source") == F.col("event"), F.lit(False))
    sides = F.when(F.col("level") == full, 1).otherwise(-1)
    # a cell of one source is the event's own on both sides or on none
    cells = states.filter(F.col("level").isin(full, last)).groupBy("entity", "event", "path", "value", "status", "confidence", "valid_from", "valid_until", "source")
    cells = cells.agg(F.count_if(F.col("level") == full).alias("n"), F.count_if(F.col("level") == last).alias("n_last"), F.sum(sides).alias("d"))
    total = lambda n, of: F.coalesce(F.sum(F.when(of, n)), F.lit(0))
    out = cells.groupBy("entity", "event").agg(total(F.col("n"), mine).alias("n_own"), (total(F.col("n_last"), mine) == 0).alias("target_gone"), total(F.abs("d"), ~mine).alias("n_moved"))
    return out.select("entity", "event", "n_own", "target_gone", "n_moved")
