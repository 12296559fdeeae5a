"""Scores of predicted ledgers, pairs and state cells, from the single item up to macro means.

Every function works on long tables (a row for each cell, entry or atom), so
that scores are sums over groups and nothing is gathered but short sequences.
Three zero rules occur and are kept apart: ``prf`` gives 1 for nothing against
nothing, ``ratio`` null for a zero denominator, and the precision of changes 0
where no change was said.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.text import sequence_distance, sequence_lcs
from tidemark.operators.aggregates import f1, prf, ratio
from tidemark.operators.align import align_ledgers

#: Classes of a cell, statuses of an event, kinds of session that a wrong pair points at.
CLASSES = ("tn", "fp", "fn", "tp_correct", "tp_wrong_value")
STATUSES = ("weak_signal", "upcoming", "occurred", "cancelled", "no_event")
CANCELLATION, HARD_NEGATIVE, OCCURRED = "cancellation_evidence", "hard_negative", "occurred_evidence"

_n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))


# -- state cells ----------------------------------------------------------------


def cell_outcomes(cells: DataFrame) -> DataFrame:
    """Adds gold_changed, predicted_changed, cell_correct and classification to each cell.

    ``cells``: initial, gold and predicted as columns of one type (a struct of
    normalised value and status, say), and is_predicted. Nulls are equal to
    nulls; what was not predicted has not changed and is not correct.
    """
    changed = ~F.col("gold").eqNullSafe(F.col("initial"))
    said = F.col("is_predicted") & ~F.col("predicted").eqNullSafe(F.col("initial"))
    right = F.col("is_predicted") & F.col("predicted").eqNullSafe(F.col("gold"))
    kind = F.when(changed & said & right, "tp_correct").when(changed & said, "tp_wrong_value").when(changed, "fn").when(said, "fp").otherwise("tn")
    return cells.withColumns({"gold_changed": changed, "predicted_changed": said, "cell_correct": right, "classification": kind})


def change_metrics(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and F1 of detected and of correct changes to counts of CLASSES."""
    detected = F.col("tp_correct") + F.col("tp_wrong_value")
    zero = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)
    dp, dr = zero(detected, detected + F.col("fp")), ratio(detected, detected + F.col("fn"))
    cp, cr = zero(F.col("tp_correct"), detected + F.col("fp")), ratio(F.col("tp_correct"), detected + F.col("fn"))
    return counts.withColumns({"change_detection_precision": dp, "change_detection_recall": dr, "change_detection_f1": f1(dp, dr), "correct_change_precision": cp, "correct_change_recall": cr, "correct_change_f1": f1(cp, cr)})


def cell_scores(outcomes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Scores of each item from ``cell_outcomes`` (with dynamic boolean, gold_evidence and predicted_evidence arrays)."""
    cited = F.size(F.array_distinct(F.coalesce("predicted_evidence", F.expr("cast(array() as array<string>)"))))
    valid = F.coalesce(F.size(F.array_intersect("gold_evidence", "predicted_evidence")), F.lit(0))
    changed = F.col("gold_changed")
    sums = outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells"), _n(F.col("cell_correct")).alias("correct_cell_count"), _n(F.col("dynamic")).alias("dynamic_path_count"), _n(F.col("dynamic") & F.col("cell_correct")).alias("_dc"),
        _n(changed).alias("changed_path_count"), _n(~changed).alias("unchanged_path_count"), _n(~changed & ~F.col("predicted_changed") & F.col("cell_correct")).alias("_uc"),
        _n(changed & (valid > 0)).alias("_hits"), F.coalesce(F.sum(F.when(changed, valid)), F.lit(0)).alias("_valid"), F.coalesce(F.sum(F.when(changed, cited)), F.lit(0)).alias("_cited"),
        *[_n(F.col("classification") == k).alias(k) for k in CLASSES],
    )
    c = F.col
    out = change_metrics(sums).withColumns({
        "final_state_accuracy": c("correct_cell_count") / c("cells"), "dynamic_path_final_state_accuracy": ratio(c("_dc"), c("dynamic_path_count")),
        "changed_state_accuracy": ratio(c("tp_correct"), c("changed_path_count")), "unchanged_state_accuracy": ratio(c("_uc"), c("unchanged_path_count")),
        "exact_state_match": c("correct_cell_count") == c("cells"), "evidence_hit_rate": ratio(c("_hits"), c("changed_path_count")), "evidence_citation_precision": ratio(c("_valid"), c("_cited")),
    })
    return out.drop("_dc", "_uc", "_hits", "_valid", "_cited")


def status_confusion(cells: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Counts of gold by predicted status; what was not predicted is ``invalid/missing``."""
    return cells.groupBy(F.col(gold).alias("gold_status"), F.coalesce(predicted, F.lit("invalid/missing")).alias("predicted_status")).agg(F.count(F.lit(1)).alias("n"))


def summarized(rows: DataFrame, trajectory: str, metrics: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """One row: macro means over trajectories of means over checkpoints (nulls left out), and sums of counts."""
    each = rows.groupBy(trajectory).agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in metrics], *[F.sum(k).alias(k) for k in counts], F.count(F.lit(1)).alias("items"))
    return each.agg(*[F.avg(m).alias(m) for m in metrics], *[F.sum(k).alias(k) for k in counts], F.sum("items").alias("items"), F.count(F.lit(1)).alias("trajectories"))


def _by_event(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each update event under ``keys``: whether its first checkpoint was right, and the share of right checkpoints."""
    rows = outcomes.filter("gold_changed").select(*keys, "checkpoint", "cell_correct", F.explode("gold_events").alias("event"))
    first = F.min(F.struct("checkpoint", "cell_correct"))["cell_correct"]
    return rows.groupBy(*keys, "event").agg(first.cast("double").alias("updated"), F.avg(F.col("cell_correct").cast("double")).alias("kept"))


def path_trajectories(outcomes: DataFrame) -> DataFrame:
    """Scores of each path of each trajectory over its checkpoints.

    ``outcomes``: trajectory, checkpoint, path, classification, cell_correct,
    gold_changed, gold_events. A path is eligible where it has an update event.
    """
    keys = ["trajectory", "path"]
    sums = outcomes.groupBy(*keys).agg(F.count(F.lit(1)).alias("checkpoints"), F.avg(F.col("cell_correct").cast("double")).alias("final_state_accuracy"), *[_n(F.col("classification") == k).alias(k) for k in CLASSES])
    events = _by_event(outcomes, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("update_events"), F.avg("updated").alias("event_macro_update_accuracy"), F.avg("kept").alias("retention_after_update"))
    return change_metrics(sums).join(events, keys, "left").withColumn("eligible", F.col("update_events").isNotNull())


def path_macro(outcomes: DataFrame) -> DataFrame:
    """Scores of each path: means over trajectories, changes over those with an update event only."""
    t = path_trajectories(outcomes)
    of = lambda m: F.avg(F.when(F.col("eligible"), F.col(m))).alias(m)
    return t.groupBy("path").agg(
        _n(F.col("eligible")).alias("eligible_trajectories"), F.count(F.lit(1)).alias("reported_trajectories"), F.coalesce(F.sum("update_events"), F.lit(0)).alias("update_events"), F.avg("final_state_accuracy").alias("final_state_accuracy"),
        *map(of, ("correct_change_precision", "correct_change_recall", "correct_change_f1", "event_macro_update_accuracy", "retention_after_update")), *[F.sum(k).alias(k) for k in CLASSES],
    )


def update_events(outcomes: DataFrame) -> DataFrame:
    """Of each update event at each checkpoint from its own on: score over its paths, lag. An event behind its checkpoint raises."""
    number = F.regexp_extract("event", "([0-9]+)$", 1).cast("int")
    rows = outcomes.filter("gold_changed").select("trajectory", "checkpoint", "cell_correct", F.explode("gold_events").alias("event")).withColumn("lag", F.col("checkpoint") - number)
    late = F.raise_error(F.concat(F.lit("future update event: "), F.col("event"))).cast("int")
    rows = rows.withColumn("lag", F.when(F.col("lag") < 0, late).otherwise(F.col("lag")))
    return rows.groupBy("trajectory", "event", "checkpoint", "lag").agg(F.avg(F.col("cell_correct").cast("double")).alias("score"), F.bool_and("cell_correct").alias("exact"))


def event_macro(outcomes: DataFrame) -> DataFrame:
    """One row: update accuracy at the first checkpoint of an event, means over events and then trajectories, and mean retention."""
    e = update_events(outcomes).groupBy("trajectory", "event").agg(F.min_by("score", "checkpoint").alias("first"), F.min_by("exact", "checkpoint").cast("double").alias("exact"), F.min("lag").alias("lag"), F.avg("score").alias("kept"))
    t = e.groupBy("trajectory").agg(F.avg("first").alias("update_accuracy"), F.avg("exact").alias("exact_update_accuracy"), F.avg("kept").alias("retention"), F.count(F.lit(1)).alias("n"), F.sum("lag").alias("lags"))
    return t.agg(F.avg("update_accuracy").alias("update_accuracy"), F.avg("exact_update_accuracy").alias("exact_update_accuracy"), F.avg("retention").alias("retention"), F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.count(F.lit(1)).alias("trajectories"), (F.sum("lags") / F.sum("n")).alias("mean_first_lag"))


def retention_curve(outcomes: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Score by lag, or by a bucket of it: means over an event's checkpoints, then events, then trajectories."""
    rows = update_events(outcomes).withColumn("at", F.col("lag") if bucket is None else bucket)
    events = rows.groupBy("at", "trajectory", "event").agg(F.avg("score").alias("score"))
    t = events.groupBy("at", "trajectory").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("events"))
    return t.groupBy("at").agg(F.avg("score").alias("score"), F.sum("events").alias("events"), F.count(F.lit(1)).alias("trajectories"))


def hierarchical(rows: DataFrame, trajectory: str, target: Sequence[str], correct: str) -> DataFrame:
    """Accuracy of each trajectory: means over answers of a target (named by the first of ``target`` that is not null), then over targets; no answer counts as wrong."""
    key = F.coalesce(*[F.col(c).cast("string") for c in target])
    t = rows.groupBy(trajectory, key.alias("_t")).agg(F.coalesce(F.avg(F.coalesce(F.col(correct), F.lit(False)).cast("double")), F.lit(0.0)).alias("score"))
    return t.groupBy(trajectory).agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("targets"))


# -- ledgers ----------------------------------------------------------------------


def aligned_entries(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """A row for each matched pair and each entry without partner: item, distance, matched, g.*, p.* as structs.

    Both tables: item, ord, event, status, anchor int, core and supporting
    (arrays of sessions); ``predicted`` has confidence too.
    """
    side = lambda df, name: df.select("item", F.lit(name).alias("side"), F.col("ord").cast("int").alias("ord"), "event", F.col("anchor").cast("int").alias("anchor"), F.col("core").alias("evidence"))
    pairs = align_ledgers(side(gold, "gold").unionAll(side(predicted, "pred")))
    g = gold.select("item", F.col("ord").cast("int").alias("gold_ord"), F.struct("event", "status", "anchor", "core", "supporting").alias("g"))
    p = predicted.select("item", F.col("ord").cast("int").alias("pred_ord"), F.struct("event", "status", "anchor", "core", "supporting", "confidence").alias("p"))
    out = pairs.join(g, ["item", "gold_ord"], "left").join(p, ["item", "pred_ord"], "left")
    return out.withColumn("matched", F.col("gold_ord").isNotNull() & F.col("pred_ord").isNotNull())


def set_prf(found: Column, wanted: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two arrays as sets."""
    none = F.expr("cast(array() as array<string>)")
    a, b = F.array_distinct(F.coalesce(found, none)), F.array_distinct(F.coalesce(wanted, none))
    return prf(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def _sequences(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """The occurred events of each item in order, as two short lists."""
    rows = gold.select("item", F.lit(0).alias("s"), "ord", "event", "status").unionAll(predicted.select("item", F.lit(1), "ord", "event", "status"))
    seq = lambda s: F.transform(F.array_sort(F.filter(F.collect_list(F.when((F.col("s") == s) & (F.col("status") == "occurred"), F.struct("ord", "event"))), lambda x: x.isNotNull())), lambda x: x["event"])
    return rows.groupBy("item").agg(seq(0).alias("gold_seq"), seq(1).alias("pred_seq"))


def item_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """All scores of each item with an entry on either side: ledger, statuses, evidence, anchors, order, confidence.

    Evidence and anchor scores are means over matched pairs, null without one;
    the end-to-end evidence score counts unmatched gold as 0.
    """
    rows = aligned_entries(gold, predicted)
    c, m = F.col, F.col("matched")
    cp, cr, cf = set_prf(c("p.core"), c("g.core"))
    sf = set_prf(c("p.supporting"), c("g.supporting"))[2]
    gs = F.when(c("gold_ord").isNotNull(), c("g.status")).otherwise("no_event")
    ps = F.when(c("pred_ord").isNotNull(), c("p.status")).otherwise("no_event")
    conf = F.when(c("p.confidence").between(0.0, 1.0), c("p.confidence"))
    hit = (m & (gs == ps)).cast("double")
    of = lambda x: F.avg(F.when(m, x))
    tp = {s: _n((gs == s) & (ps == s)) for s in STATUSES}
    wrong = {s: _n((gs == s) != (ps == s)) for s in STATUSES}
    per_class = [F.when(tp[s] + wrong[s] > 0, 2 * tp[s] / (2 * tp[s] + wrong[s])) for s in STATUSES]
    agg = rows.groupBy("item").agg(
        F.count("gold_ord").alias("n_gold"), F.count("pred_ord").alias("n_pred"), _n(m).alias("n_matched"), F.array_compact(F.array(*per_class)).alias("_f1s"),
        of(cp).alias("core_evidence_precision"), of(cr).alias("core_evidence_recall"), of(cf).alias("core_evidence_f1"), F.sum(F.when(m, cf)).alias("_cf"), of(sf).alias("supporting_evidence_f1"),
        of((c("distance") == 0).cast("double")).alias("anchor_exact_accuracy"), of(c("distance")).alias("anchor_mean_absolute_error"), F.median(F.when(m, c("distance"))).alias("anchor_median_absolute_error"),
        of((c("distance") <= 1).cast("double")).alias("anchor_within_1_session"), of((c("distance") <= 3).cast("double")).alias("anchor_within_3_sessions"),
        F.avg(F.when(hit == 1, conf)).alias("mean_confidence_correct"), F.avg(F.when(hit == 0, conf)).alias("mean_confidence_incorrect"), F.avg(F.pow(conf - hit, 2)).alias("brier_score"),
    )
    p, r, f = prf(c("n_matched"), c("n_pred"), c("n_gold"))
    out = agg.withColumns({"full_ledger_event_precision": p, "full_ledger_event_recall": r, "full_ledger_event_f1": f})
    mean = F.when(F.size("_f1s") > 0, F.aggregate("_f1s", F.lit(0.0), lambda a, x: a + x) / F.size("_f1s"))
    out = out.withColumns({"status_macro_f1": mean, "core_evidence_f1_end_to_end": ratio(F.coalesce("_cf", F.lit(0.0)), c("n_gold")), "event_count_mae": F.abs(c("n_pred") - c("n_gold")).cast("double")})
    seq = _sequences(gold, predicted).withColumn("lcs", sequence_lcs("gold_seq", "pred_seq")).withColumn("edits", sequence_distance("gold_seq", "pred_seq"))
    p, r, f = prf(c("lcs"), F.size("pred_seq"), F.size("gold_seq"))
    longer = F.greatest(F.size("gold_seq"), F.size("pred_seq"))
    seq = seq.select("item", p.alias("ordered_occurred_event_precision"), r.alias("ordered_occurred_event_recall"), f.alias("ordered_occurred_event_f1"), (c("gold_seq") == c("pred_seq")).cast("double").alias("exact_occurred_trajectory_match"), F.when(longer > 0, c("edits") / longer).otherwise(0.0).alias("normalized_sequence_edit_distance"))
    return out.drop("_f1s", "_cf").join(seq, "item")


def distractor_flags(unmatched: DataFrame, entries: DataFrame, cases: DataFrame) -> DataFrame:
    """Of each case (item, near_miss, target): whether the near miss was hallucinated, the target cited, and how many unmatched predictions say occurred."""
    u = unmatched.join(cases, "item").groupBy("item").agg(F.bool_or(F.col("event") == F.col("near_miss")).alias("near_miss_hallucinated"), _n(F.col("status") == "occurred").alias("false_occurred_count"))
    cites = F.array_contains("core", F.col("target")) | F.array_contains("supporting", F.col("target"))
    e = entries.join(cases, "item").groupBy("item").agg(F.bool_or(F.coalesce(cites, F.lit(False))).alias("cited"))
    out = cases.join(u, "item", "left").join(e, "item", "left")
    return out.select("item", F.coalesce("near_miss_hallucinated", F.lit(False)).alias("near_miss_hallucinated"), F.coalesce("cited", F.lit(False)).alias("hard_negative_cited"), F.coalesce("false_occurred_count", F.lit(0)).alias("false_occurred_count"))


# -- pairs of event and session -----------------------------------------------------


def pair_counts(gold: DataFrame, predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Multiplicities g and p of each pair (event, session) under ``keys``."""
    atom = [*keys, "event", "session"]
    both = gold.select(*atom, F.lit(1).alias("g"), F.lit(0).alias("p")).unionAll(predicted.select(*atom, F.lit(0), F.lit(1)))
    return both.groupBy(*atom).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))


def pair_scores(gold: DataFrame, predicted: DataFrame, invalid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Strict scores of each item (``keys``): an invalid record is one false positive. ``invalid``: keys, n; a row for every item, with 0 too."""
    counts = pair_counts(gold, predicted, keys)
    strict = counts.groupBy(*keys).agg(F.sum(F.least("g", "p")).alias("tp"), F.sum("g").alias("n_gold"), F.sum("p").alias("n_valid"), F.count_if(F.col("p") > 0).alias("n_distinct"), F.bool_and(F.col("g") == F.col("p")).alias("_same"))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    out = invalid.select(*keys, F.col("n").alias("n_invalid")).join(strict, list(keys), "left").select(*keys, "n_invalid", *map(zero, ("tp", "n_gold", "n_valid", "n_distinct")), F.coalesce("_same", F.lit(True)).alias("_same"))
    for name in ("event", "session"):
        part = counts.groupBy(*keys, name).agg(F.sum("g").alias("g"), F.sum("p").alias("p")).groupBy(*keys).agg(F.sum(F.least("g", "p")).alias(f"{name}_tp"))
        out = out.join(part, list(keys), "left").withColumn(f"{name}_tp", F.coalesce(f"{name}_tp", F.lit(0)))
    n_pred = F.col("n_valid") + F.col("n_invalid")
    p, r, f = prf(F.col("tp"), n_pred, F.col("n_gold"))
    out = out.withColumns({"n_pred": n_pred, "precision": p, "recall": r, "f1": f, "false_positives": n_pred - F.col("tp"), "false_negatives": F.col("n_gold") - F.col("tp"), "count_bias": n_pred - F.col("n_gold"), "duplicates": F.col("n_valid") - F.col("n_distinct"), "exact": (F.col("_same") & (F.col("n_invalid") == 0)).cast("double")})
    for name in ("event", "session"):
        out = out.withColumn(f"{name}_f1", prf(F.col(f"{name}_tp"), F.col("n_valid"), F.col("n_gold"))[2])
    return out.drop("_same", "event_tp", "session_tp")


def pair_checkpoints(scores: DataFrame, checkpoint: str, metrics: Sequence[str]) -> DataFrame:
    """Of each checkpoint: means over its trajectories, and micro scores from its summed counts."""
    out = scores.groupBy(checkpoint).agg(F.count(F.lit(1)).alias("n_trajectories"), *[F.avg(m).alias(m) for m in metrics], *[F.sum(k).alias(f"sum_{k}") for k in ("tp", "n_pred", "n_gold")])
    p, r, f = prf(F.col("sum_tp"), F.col("sum_n_pred"), F.col("sum_n_gold"))
    return out.withColumns({"micro_precision": p, "micro_recall": r, "micro_f1": f})


def checkpoint_auc(per_checkpoint: DataFrame, checkpoint: str, metrics: Sequence[str]) -> DataFrame:
    """One row: the equal-weight mean over checkpoints of each metric, and its value at the last one."""
    last = [F.max_by(m, checkpoint).alias(f"final_{m}") for m in metrics]
    return per_checkpoint.agg(F.count(F.lit(1)).alias("n_checkpoints"), *[F.avg(m).alias(f"auc_{m}") for m in metrics], *last)


def pair_errors(gold: DataFrame, predicted: DataFrame, sessions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Surplus predicted pairs by kind of error: keys, event, session, category, n.

    ``sessions``: keys, session, type. Repeats of a pair come first; what is left
    is judged by its session (cancellation, hard negative), then by gold: another
    event at a gold session, a gold event at another occurred session, else other.
    """
    counts = pair_counts(gold, predicted, keys)
    surplus = counts.withColumn("s", F.col("p") - F.least("g", "p")).filter("s > 0").withColumn("dup", F.least(F.col("p") - 1, F.col("s")))
    at = gold.groupBy(*keys, "session").agg(F.min("event").alias("gold_event"))
    known = gold.select(*keys, "event").distinct().withColumn("is_gold", F.lit(True))
    rows = surplus.join(sessions.select(*keys, "session", "type"), [*keys, "session"], "left").join(at, [*keys, "session"], "left").join(known, [*keys, "event"], "left")
    kind = (
        F.when(F.col("type") == CANCELLATION, "prediction_at_cancellation_session")
        .when(F.col("type") == HARD_NEGATIVE, "prediction_at_hard_negative_session")
        .when(F.col("gold_event") != F.col("event"), "wrong_event_at_gold_occurred_session")
        .when(F.coalesce("is_gold", F.lit(False)) & (F.col("type") == OCCURRED), "correct_event_at_wrong_occurred_session")
        .otherwise("other")
    )
    both = F.array(F.struct(F.lit("duplicate_pair").alias("category"), F.col("dup").alias("n")), F.struct(kind.alias("category"), (F.col("s") - F.col("dup")).alias("n")))
    return rows.select(*keys, "event", "session", F.explode(both).alias("e")).select(*keys, "event", "session", "e.*").filter("n > 0")


# -- other summaries ------------------------------------------------------------------


def grouped_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, exact median and number of the values that are not null."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.count(value).alias("n"))


def arm_means(df: DataFrame, by: Sequence[str], correct: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.col(correct).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def usage_totals(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sums that stay null where every value is missing, and the number of rows that miss each."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(c) for c in columns], *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns])


def map_totals(df: DataFrame, by: Sequence[str], usage: str) -> DataFrame:
    """Sums of integer map values by key."""
    return df.select(*by, F.explode(usage).alias("key", "value")).groupBy(*by, "key").agg(F.sum("value").alias("total"))


def provider_usage(metadata: str, usage: str, names: dict[str, Sequence[str]]) -> dict[str, Column]:
    """Of each output name the first value that is not null over its alternative keys, in ``metadata`` and then ``usage`` (both maps); never 0 for missing."""
    return {out: F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in keys for m in (metadata, usage)]) for out, keys in names.items()}


def contract_reasons(rules: Sequence[tuple[str, Column, Column]]) -> tuple[Column, Column]:
    """(fatal, gaps): codes of the rules that hold, split by whether each is only a gap in the metadata."""
    codes = lambda gap: F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)) & (F.coalesce(is_gap, F.lit(False)) == F.lit(gap)), F.lit(code)) for code, cond, is_gap in rules]))
    return codes(False), codes(True)


def decades(df: DataFrame, age: str) -> DataFrame:
    """Number of rows by decade of age."""
    return df.groupBy((F.floor(F.col(age) / 10) * 10).cast("int").alias("decade")).agg(F.count(F.lit(1)).alias("n"))


def distinct_sets(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """The distinct values of each group in order; groups have few of them."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(column)).alias("values"))


def pass_rates(df: DataFrame, by: Sequence[str], checks: Sequence[str]) -> DataFrame:
    """Share of rows that pass each check and all of them; a missing verdict is a failure."""
    ok = {c: F.coalesce(F.col(c), F.lit(False)) for c in checks}
    every = F.lit(True)
    for c in checks:
        every = every & ok[c]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(x.cast("double")).alias(c) for c, x in ok.items()], F.avg(every.cast("double")).alias("all_pass"))


def last_status(df: DataFrame, by: Sequence[str], order: str, status: str) -> DataFrame:
    """The last status of each key and whether it was ever ``occurred``."""
    return df.groupBy(*by).agg(F.max_by(status, order).alias("last_status"), F.bool_or(F.col(status) == "occurred").alias("recovered"))


def frozen_targets(targets: DataFrame, checkpoints: DataFrame, by: Sequence[str], first: str, at: str) -> DataFrame:
    """Each target again at every checkpoint of its key from its first one on."""
    return targets.join(checkpoints.select(*by, at).distinct(), list(by)).filter(F.col(first) <= F.col(at))


def first_recoverable(sessions: DataFrame, by: Sequence[str], no: str, strong: Column, low: Column) -> DataFrame:
    """Where an instance can first be recovered: its first strong session, or the linked one after it if the plan says low; without one, its last session."""
    w = W.partitionBy(*by).orderBy(no)
    rows = sessions.withColumn("_next", F.lead(no).over(w)).withColumn("_strong", F.coalesce(strong, F.lit(False))).withColumn("_low", F.coalesce(low, F.lit(False)))
    first = F.min_by(F.struct(no, "_next", "_low"), F.when(F.col("_strong"), F.col(no)))
    out = rows.groupBy(*by).agg(first.alias("f"), F.max(no).alias("_last"))
    return out.select(*by, F.when(F.col("f._low"), F.coalesce("f._next", "_last")).otherwise(F.coalesce(F.col(f"f.{no}"), F.col("_last"))).alias("first_recoverable"))


def dynamic_paths(cells: DataFrame, by: Sequence[str], path: str, checkpoint: str, value: str) -> DataFrame:
    """Paths whose value differs from that of the checkpoint before anywhere; checkpoint 0 holds the initial state."""
    before = F.lag(F.struct(value)).over(W.partitionBy(*by, path).orderBy(checkpoint))
    return cells.withColumn("_b", before).filter(F.col("_b").isNotNull() & ~F.col(f"_b.{value}").eqNullSafe(F.col(value))).select(path).distinct()


def call_cost(tokens_in: Column, tokens_cached: Column, tokens_out: Column, prices: Mapping[str, float]) -> Column:
    """What a call costs: fresh and cached input and output tokens by their prices for a million (input, cached, output).

    Cached tokens are part of the input and never more than it; nulls are none.
    """
    n = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    cached = F.least(n(tokens_cached), n(tokens_in))
    return ((n(tokens_in) - cached) * prices["input"] + cached * prices["cached"] + n(tokens_out) * prices["output"]) / 1e6
