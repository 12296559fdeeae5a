"""Counterfactual variants of a history: nested mask levels and donor assignment."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators._stage import dealt

_TERMINAL = ("occurred_evidence", "cancellation_evidence", "consequence_session", "stale_recall_session")
#: Nested mask levels and the types of session that each one replaces.
LEVELS = {"full": (), "mask_terminal": _TERMINAL, "mask_upcoming": (*_TERMINAL, "upcoming_evidence"), "mask_all": (*_TERMINAL, "upcoming_evidence", "weak_signal_evidence")}
#: The only cue of a session that may stand in for another.
NEUTRAL_CUES = ("task_intent",)


def is_neutral(kind: Column, linked: Column, task: Column, safe_tasks: Sequence[str], cue_types: Column, n_turns: Column) -> Column:
    """Whether a session may be a donor: routine, linked to no event, of a safe task, with no cue but neutral ones, and not empty."""
    only = F.size(F.array_except(F.coalesce(cue_types, F.expr("cast(array() as array<string>)")), F.array(*map(F.lit, NEUTRAL_CUES)))) == 0
    plain = kind.eqNullSafe(F.lit("routine_financial")) & (F.coalesce(linked, F.lit("")) == "")
    return plain & F.coalesce(task.isin(*safe_tasks), F.lit(False)) & only & (F.coalesce(n_turns, F.lit(0)) > 0)


def ladder(rows: DataFrame, kind: str, blank: Sequence[str]) -> DataFrame:
    """Every row at every mask level: level, masked, and ``blank`` columns nulled where masked."""
    hit = F.lit(False)
    for level, kinds in LEVELS.items():
        hit = F.when(F.col("level") == level, F.col(kind).isin(*kinds)).otherwise(hit) if kinds else hit
    out = rows.withColumn("level", F.explode(F.array(*map(F.lit, LEVELS)))).withColumn("masked", F.coalesce(hit, F.lit(False)))
    return out.withColumns({c: F.when(~F.col("masked"), F.col(c)) for c in blank})


def replace_slots(rows: DataFrame, donors: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows with ``columns`` taken from the donor of their slot, where there is one."""
    d = donors.select(*on, F.struct(*columns).alias("_d"), F.lit(True).alias("_hit"))
    out = rows.join(d, list(on), "left")
    return out.withColumns({c: F.when(F.col("_hit"), F.col(f"_d.{c}")).otherwise(F.col(c)) for c in columns}).withColumn("replaced", F.coalesce("_hit", F.lit(False))).drop("_d", "_hit")


class _Nearest:
    """Donors with a month, taken one by one: the nearest month, ties to the smaller id."""

    def __init__(self, donors: list[tuple[int, object]]):
        self.ids: dict[int, list] = {}
        for month, donor in sorted(donors, reverse=True):
            self.ids.setdefault(month, []).append(donor)  # the smallest id is at the end
        self.months = sorted(self.ids)

    def take(self, month: int):
        k = bisect_left(self.months, month)
        near = [(abs(m - month), self.ids[m][-1], m) for m in self.months[max(0, k - 1) : k + 1]]
        _, donor, m = min(near)
        self.ids[m].pop()
        if not self.ids[m]:
            del self.ids[m]
            self.months.remove(m)
        return donor


def assign_donors(slots: DataFrame, donors: DataFrame, by: Sequence[str], order: Sequence[str], seed: str = "") -> DataFrame:
    """Greedy donors without replacement: the columns of ``by``, slot, donor.

    ``slots`` (by, slot, month, columns of ``order``) are served in order; each
    takes the free donor of its ``by`` with the least score. ``donors``: by,
    donor, month. A donor with a month scores (0, distance, id), one without
    (1, sha256 of seed, slot and donor, id), ids compared in their own type.
    Slots that find no donor raise. A task holds the free donors of one ``by``.
    """
    kind = slots.schema["slot"].dataType
    if donors.schema["donor"].dataType != kind:
        raise ValueError("slots and donors have ids of different types")
    rows = slots.select(*by, F.lit(1).alias("side"), F.struct(*order).alias("at"), F.col("slot").alias("id"), F.col("month").cast("long").alias("month"))
    none = F.lit(None).cast(rows.schema["at"].dataType)
    rows = rows.unionAll(donors.select(*by, F.lit(0), none, F.col("donor"), F.col("month").cast("long")))
    schema = ", ".join([*(f"`{c}` {slots.schema[c].dataType.simpleString()}" for c in by), f"slot {kind.simpleString()}", f"donor {kind.simpleString()}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, timed, timeless, ready = None, [], [], None
        for batch in batches:
            n = len(by)
            where, picked = [], []
            sides, ids, months = (batch.column(n + k).to_pylist() for k in (0, 2, 3))
            for row, name in enumerate(zip(*(batch.column(k).to_pylist() for k in range(n)))):
                if name != key:
                    key, timed, timeless, ready = name, [], [], None
                if not sides[row]:
                    (timeless if months[row] is None else timed).append(ids[row] if months[row] is None else (months[row], ids[row]))
                    continue
                ready = ready or _Nearest(timed)
                if ready.months and months[row] is not None:
                    donor = ready.take(months[row])
                elif timeless:
                    rank = lambda d: (hashlib.sha256(f"{seed}:{ids[row]}:{d}".encode()).hexdigest(), d)  # noqa: B023, E731
                    timeless.remove(donor := min(timeless, key=rank))
                else:
                    raise ValueError(f"no unused donor for slot {ids[row]!r} of {key!r}")
                where.append(row)
                picked.append(donor)
            if where:
                at = pa.array(where)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(n)), batch.column(n + 2).take(at), pa.array(picked, batch.schema.types[n + 2])], names=[*by, "slot", "donor"])

    return dealt(rows, by, ["side", "at"]).mapInArrow(run, schema)


def unseen_donors(cases: DataFrame, donors: DataFrame, by: Sequence[str], until: str, place: str) -> DataFrame:
    """The donors that each case may use: those of its ``by`` that stand behind the case's ``until``, so none of what the case has read, and those without a place.

    ``cases`` has by, further columns that name the case, and ``until``.
    """
    return cases.join(donors, list(by)).filter(F.col(place).isNull() | (F.col(place) > F.col(until))).drop(until)


def placebo_slots(targets: DataFrame, rows: DataFrame, by: Sequence[str], place: str, key: str) -> DataFrame:
    """For each target the nearest free row by place, in the order of the targets: by, slot, donor.

    ``targets`` and ``rows`` have by, ``place`` and ``key``; a row is taken once,
    ties go to the smaller key. Where a key has more targets than rows it raises.
    """
    slots = targets.select(*by, F.col(key).alias("slot"), F.col(place).alias("month"))
    donors = rows.filter(F.col(place).isNotNull()).select(*by, F.col(key).alias("donor"), F.col(place).alias("month"))
    return assign_donors(slots, donors, by, ["month", "slot"])


def neutral(rows: DataFrame, donors: DataFrame, on: Sequence[str], keep: Sequence[str], reset: Mapping[str, object]) -> DataFrame:
    """Rows whose slot has a donor take its columns and lose their own identity as evidence.

    Columns of ``keep`` stay as they are, those of ``reset`` get the stated value,
    all others come from the donor (null where the donor has no such column).
    """
    have = [c for c in donors.columns if c not in on]
    d = donors.select(*on, F.struct(*have).alias("_d"))
    out = rows.join(d, list(on), "left")

    def column(c: str) -> Column:
        if c in keep or c in on:
            return F.col(c)
        kind = rows.schema[c].dataType
        new = F.lit(reset[c]).cast(kind) if c in reset else F.col(f"_d.{c}").cast(kind) if c in have else F.lit(None).cast(kind)
        return F.when(F.col("_d").isNotNull(), new).otherwise(F.col(c)).alias(c)

    return out.select(*map(column, rows.columns), F.col("_d").isNotNull().alias("replaced"))


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, as a multiset: its columns and ``side``. A placebo or sham must give none."""
    return before.exceptAll(after).withColumn("side", F.lit("before")).unionAll(after.exceptAll(before).withColumn("side", F.lit("after")))


def target_retracted(full: DataFrame, masked: DataFrame, target: Column) -> DataFrame:
    """Violations of a counterfactual: rows of the target that stay (``target_remains``), other rows that go or come (``drift``)."""
    kept = masked.filter(target).withColumn("code", F.lit("target_remains"))
    drift = changed_rows(full.filter(~F.coalesce(target, F.lit(False))), masked.filter(~F.coalesce(target, F.lit(False)))).withColumn("code", F.lit("drift"))
    return kept.unionByName(drift.drop("side"))


def verdict(retractable: Column, terminal: Column, every: Column) -> Column:
    """What a masked pair shows, from whether its label persists under the terminal and the full mask."""
    return F.when(~retractable, "no_retraction_opportunity").when(~terminal & ~every, "evidence_dependent").when(terminal & ~every, "commits_from_pre_occurrence_evidence").when(terminal & every, "structural_or_unsupported_persistence").otherwise("inconsistent_persistence")
