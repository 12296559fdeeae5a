"""Predictions in model output: tolerant JSON, entries checked one by one, reasons kept.

A broken answer gives a parse error, a broken entry a reason with its index; the
entries beside it count. All checks are expressions over variants and arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, functions as F

from tidemark.functions.answers import outer_object

#: Statuses that may be predicted, the form of a public session id, fields of a pair.
STATUSES = ("weak_signal", "upcoming", "occurred", "cancelled")
SESSION = "^D[0-9]{3}$"
PAIR_FIELDS = ("event_id", "evidence_session_id")

_NO_TEXT = "cast(array() as array<string>)"
_none = lambda: F.expr(_NO_TEXT)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unfenced(raw: Column) -> Column:
    """The answer without its lines of code fences, if it begins with one."""
    bare = F.trim(F.coalesce(raw, F.lit("")))
    return F.when(bare.startswith("```"), F.trim(F.regexp_replace(bare, r"(?m)^[ \t]*```.*$\n?", ""))).otherwise(bare)


def _kind(v: Column) -> Column:
    """OBJECT..., ARRAY..., STRING, BIGINT and the like; null where there is nothing, VOID for a JSON null."""
    return F.schema_of_variant(v)


def _field(entry: Column, name: str) -> Column:
    return F.try_variant_get(entry, f"$.{name}", "variant")


def _text(entry: Column, name: str) -> Column:
    """A field that is a JSON string; null for anything else."""
    v = _field(entry, name)
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _absent(entry: Column, name: str) -> Column:
    v = _field(entry, name)
    return v.isNull() | (_kind(v) == "VOID")


def _is(entry: Column, kind: str) -> Column:
    return F.coalesce(_kind(entry).startswith(kind), F.lit(False))


def _code(when: Column, code: str) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.array(F.lit(code))).otherwise(_none())


def _session_code(sid: Column, visible: Column, field: str) -> Column:
    """Why a session id is refused: it has another form, or was not shown; null if it is fine."""
    return F.when(F.coalesce(F.array_contains(F.map_keys(visible), sid), F.lit(False)), None).when(F.coalesce(sid.rlike(SESSION), F.lit(False)), f"{field}:not_visible").otherwise(f"{field}:malformed")


def _parsed(raw: Column) -> Column:
    """The answer as a variant, unfenced; else the object in it; else null."""
    return let(unfenced(raw), lambda text: F.coalesce(F.try_parse_json(text), F.try_parse_json(outer_object(text))))


def _entries(raw: Column, name: str, use: Callable[[Column, Column], Column]) -> Column:
    """``use(parse error, entries as variants)`` of an answer that should be an object with a list ``name``."""

    def of(whole: Column) -> Column:
        found = F.try_variant_get(whole, f"$.{name}", "variant")
        error = F.when(whole.isNull(), "invalid_json").when(~(_is(whole, "OBJECT") & _is(found, "ARRAY")), f"missing_{name}_list")
        both = F.struct(error.alias("error"), F.try_variant_get(found, "$", "array<variant>").alias("entries"))
        return let(both, lambda x: use(x["error"], F.when(x["error"].isNull(), x["entries"])))

    return let(_parsed(raw), of)


def _indexed(errors: Column, i: Column, name: str) -> Column:
    return F.transform(errors, lambda e: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]: "), e))


def _ordered(keys: Column) -> Column:
    return F.coalesce(keys == F.array_sort(keys), F.lit(True))


def ledger(raw: Column, visible: Column, taxonomy: Sequence[str]) -> Column:
    """A predicted ledger: struct(parse_error, events, errors, n_rejected).

    ``visible`` maps the public ids that were shown to canonical ones; the
    taxonomy is a short stated list. An event is rejected for an unknown id or
    status, an anchor or first session that is no id or was not shown, and lists
    that are none or hold such ids. A confidence outside of [0, 1] becomes null
    and is only noted, as is an order that is not that of the first evidence.
    """

    def sessions(e: Column, field: str) -> Column:
        """struct(errors, ids) of a list of sessions."""

        def of(v: Column) -> Column:
            absent = v.isNull() | (_kind(v) == "VOID")
            bad_list = ~absent & ~_is(v, "ARRAY")
            ids = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string")))

            def checked(ids: Column) -> Column:
                codes = F.filter(F.transform(ids, lambda s: _session_code(s, visible, field)), lambda c: c.isNotNull())
                return F.struct(F.concat(_code(bad_list, f"{field}:not_a_list"), codes).alias("errors"), F.array_distinct(F.transform(ids, lambda s: F.try_element_at(visible, s))).alias("ids"))

            return let(F.when(absent | bad_list, _none()).otherwise(ids), checked)

        return let(_field(e, field), of)

    names = ("event_id", "status", "first_evidence_session_id", "status_anchor_session_id")

    def entry(e: Column, i: Column) -> Column:
        read = F.struct(*[_text(e, f).alias(f) for f in names], sessions(e, "core_evidence_session_ids").alias("core"), sessions(e, "supporting_session_ids").alias("supporting"), _is(e, "OBJECT").alias("is_object"))
        return let(read, lambda x: judged(e, i, x))

    def judged(e: Column, i: Column, x: Column) -> Column:
        event, status, first, anchor = (x[f] for f in names)
        core_errors, core = x["core"]["errors"], x["core"]["ids"]
        supporting_errors, supporting = x["supporting"]["errors"], x["supporting"]["ids"]
        one = lambda sid, field: F.array_compact(F.array(_session_code(sid, visible, field)))
        number = F.when(_kind(_field(e, "confidence")).rlike("^(BIGINT|DECIMAL.*|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get(e, "$.confidence", "double"))
        confidence = F.when(number.between(0.0, 1.0), number)
        fatal = F.when(
            x["is_object"],
            F.concat(
                _code(~F.coalesce(event.isin(*taxonomy), F.lit(False)), "unknown_event_id"), _code(~F.coalesce(status.isin(*STATUSES), F.lit(False)), "invalid_status"),
                one(first, "first_evidence_session_id"), one(anchor, "status_anchor_session_id"), core_errors, supporting_errors,
            ),
        ).otherwise(F.array(F.lit("not_an_object")))
        noted = _code(x["is_object"] & confidence.isNull(), "invalid_confidence")
        name = F.coalesce(F.try_variant_get(e, "$.prediction_id", "string"), F.format_string("P%03d", i + 1))
        made = F.struct(
            name.alias("prediction_id"), event.alias("event_id"), status.alias("status"), F.try_element_at(visible, first).alias("first_evidence_session"), F.try_element_at(visible, anchor).alias("status_anchor_session"),
            core.alias("core_evidence_sessions"), supporting.alias("supporting_sessions"), confidence.alias("confidence"),
        )
        return let(fatal, lambda f: F.struct(F.size(f).alias("n_fatal"), _indexed(F.concat(noted, f), i, "events").alias("errors"), made.alias("made")))

    number = lambda x: F.regexp_extract(x["first_evidence_session"], "([0-9]+)$", 1).cast("int")

    def told(error: Column, checked: Column) -> Column:
        events = F.transform(F.filter(checked, lambda x: x["n_fatal"] == 0), lambda x: x["made"])
        late = _code(~_ordered(F.transform(events, number)), "events_not_ordered_by_first_evidence")
        rejected = F.size(F.filter(checked, lambda x: x["n_fatal"] > 0))
        return F.struct(error.alias("parse_error"), events.alias("events"), F.concat(F.flatten(F.transform(checked, lambda x: x["errors"])), late).alias("errors"), F.when(error.isNull(), rejected).otherwise(0).alias("n_rejected"))

    return _entries(raw, "events", lambda error, entries: let(F.transform(entries, entry), lambda checked: told(error, checked)))


def pairs(raw: Column, visible: Column, taxonomy: Sequence[str]) -> Column:
    """Predicted pairs: struct(parse_error, pairs, errors, n_invalid). ``visible`` is an array of the public ids that were shown.

    A record that is no object, or whose event or session is missing, malformed,
    unknown or not shown, is one invalid record. Further fields and a wrong order
    are only noted.
    """

    def named(e: Column, field: str, known: Column, form: str | None, unknown: str) -> Column:
        v = _text(e, field)
        bad_form = v.isNull() if form is None else v.isNull() | ~v.rlike(form)
        return F.when(_absent(e, field), f"missing_{field}").when(bad_form, f"malformed_{field}").when(~F.coalesce(known, F.lit(False)), unknown)

    def entry(e: Column, i: Column) -> Column:
        event, session = _text(e, "event_id"), _text(e, "evidence_session_id")
        wrong = F.array_compact(F.array(named(e, "event_id", event.isin(*taxonomy), None, "unknown_event_id"), named(e, "evidence_session_id", F.array_contains(visible, session), SESSION, "session_id_not_visible")))
        fatal = F.when(_is(e, "OBJECT"), wrong).otherwise(F.array(F.lit("not_an_object")))
        keys = F.json_object_keys(F.when(_is(e, "OBJECT"), F.to_json(e)))
        extra = F.array_sort(F.array_except(F.coalesce(keys, _none()), F.array(*map(F.lit, PAIR_FIELDS))))
        noted = F.transform(extra, lambda k: F.concat(F.lit("unexpected_field:"), k))
        made = F.struct(event.alias("event_id"), session.alias("evidence_session_id"))
        return let(fatal, lambda f: F.struct(F.size(f).alias("n_fatal"), _indexed(F.concat(noted, f), i, "pairs").alias("errors"), made.alias("made")))

    at = lambda x: F.struct(F.regexp_extract(x["evidence_session_id"], "([0-9]+)$", 1).cast("int").alias("n"), x["event_id"].alias("e"))

    def told(error: Column, checked: Column) -> Column:
        made = F.transform(F.filter(checked, lambda x: x["n_fatal"] == 0), lambda x: x["made"])
        late = _code(~_ordered(F.transform(made, at)), "pairs_not_ordered_by_evidence_session")
        invalid = F.size(F.filter(checked, lambda x: x["n_fatal"] > 0))
        return F.struct(error.alias("parse_error"), made.alias("pairs"), F.concat(F.flatten(F.transform(checked, lambda x: x["errors"])), late).alias("errors"), F.when(error.isNull(), invalid).otherwise(0).alias("n_invalid"))

    return _entries(raw, "pairs", lambda error, entries: let(F.transform(entries, entry), lambda checked: told(error, checked)))


def state(raw: Column, checkpoint: Column, version: str, paths: Sequence[str], statuses: Sequence[str], closed: Mapping[str, Sequence[str]] | None = None) -> Column:
    """A predicted state: struct(parse_error, cells, errors); cells: array of struct(path, value as JSON, status, evidence).

    ``{"schema_version": ..., "state": {path: {value, status, evidence_session_ids}}}``.
    A cell is left out, with a reason, if it is no object, its status is not
    allowed, its evidence is no list or holds anything but ids up to
    ``checkpoint``, or its value is not among the ``closed`` values of its path
    (every element of a list must be).
    """

    def cell(found: Column, path: str) -> Column:
        return let(F.try_variant_get(found, f"$['{path}']", "variant"), lambda c: judged(c, path))

    fine = lambda s: F.coalesce(s.rlike(SESSION) & (F.substring(s, 2, 9).cast("int") <= checkpoint), F.lit(False))

    def judged(c: Column, path: str) -> Column:
        status, proof, value = _text(c, "status"), _field(c, "evidence_session_ids"), _field(c, "value")
        ids = F.when(proof.isNull(), _none()).otherwise(F.transform(F.try_variant_get(proof, "$", "array<variant>"), lambda x: F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string"))))
        wrong_value = F.lit(False)
        if closed and path in closed:
            allowed = lambda x: F.coalesce(F.try_variant_get(x, "$", "string").isin(*closed[path]), F.lit(False))
            wrong_value = F.when(_is(value, "ARRAY"), F.exists(F.try_variant_get(value, "$", "array<variant>"), lambda x: ~allowed(x))).otherwise(~allowed(value))
        reason = (
            F.when(~_is(c, "OBJECT"), "missing_or_invalid_cell")
            .when(~F.coalesce(status.isin(*statuses), F.lit(False)), "invalid_status")
            .when(proof.isNotNull() & ~_is(proof, "ARRAY"), "evidence_not_list")
            .when(F.exists(ids, lambda s: ~fine(s)), "invalid_or_future_evidence")
            .when(wrong_value, "invalid_closed_value")
        )
        return F.struct(F.lit(path).alias("path"), reason.alias("reason"), F.to_json(value).alias("value"), status.alias("status"), F.array_distinct(ids).alias("evidence"))

    def told(error: Column, extras: Column, cells: Column) -> Column:
        good = F.transform(F.filter(cells, lambda c: c["reason"].isNull()), lambda c: F.struct(c["path"], c["value"], c["status"], c["evidence"]))
        bad = F.transform(F.filter(cells, lambda c: c["reason"].isNotNull()), lambda c: F.concat_ws(":", c["path"], c["reason"]))
        return F.struct(error.alias("parse_error"), good.alias("cells"), F.when(error.isNull(), F.concat(extras, bad)).alias("errors"))

    def of(whole: Column) -> Column:
        found = _field(whole, "state")
        error = F.when(~(_is(whole, "OBJECT") & _is(found, "OBJECT")), "invalid_json_or_missing_state").when(~F.coalesce(_text(whole, "schema_version") == version, F.lit(False)), "schema_version_mismatch")
        keys = F.coalesce(F.json_object_keys(F.to_json(F.when(_is(found, "OBJECT"), found))), _none())
        extras = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, paths)))), lambda k: F.concat(F.lit("unknown_path:"), k))
        read = F.struct(error.alias("error"), extras.alias("extras"), F.when(error.isNull(), F.array(*[cell(found, p) for p in paths])).alias("cells"))
        return let(read, lambda x: told(x["error"], x["extras"], x["cells"]))

    return let(_parsed(raw), of)
