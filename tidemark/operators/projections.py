"""Projections and predicates over nested state: properties, targets, selectors, visibility, registry conditions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators._stage import free, staged

#: The observable fields of a property.
PROPERTY_FIELDS = ("address", "ownership_status", "mortgage_status", "role")
PRIMARY, SECONDARY = "primary_residence", "secondary_property"
#: Levels of nested texts that are taken apart in one go.
LEVELS = 16

_strings = lambda: F.expr("cast(array() as array<string>)")


# -- state ------------------------------------------------------------------------


def observable(p: Column, role: Column | None = None) -> Column:
    """The observable fields of a property, its role replaced where one is given; null for null."""
    fields = [(role if f == "role" and role is not None else p[f]).alias(f) for f in PROPERTY_FIELDS]
    return F.when(p.isNotNull(), F.struct(*fields))


def projected_properties(properties: Column, primary_id: Column) -> Column:
    """Observable properties in order of address, role and ownership.

    The property that ``primary_id`` names is the primary residence; another
    owned one that claims to be becomes secondary.
    """
    shown = lambda c: F.coalesce(c, F.lit("None"))

    def one(p: Column) -> Column:
        claims = (p["ownership_status"] == "owned") & (p["role"] == PRIMARY)
        role = F.when(p["property_id"].eqNullSafe(primary_id), PRIMARY).when(claims, SECONDARY).otherwise(p["role"])
        return F.struct(shown(p["address"]).alias("a"), shown(role).alias("r"), shown(p["ownership_status"]).alias("o"), observable(p, role).alias("p"))

    rows = F.transform(F.filter(properties, lambda p: p.isNotNull()), one)
    return F.transform(F.array_sort(rows, lambda x, y: _compare((x["a"], y["a"]), (x["r"], y["r"]), (x["o"], y["o"]))), lambda x: x["p"])


def _compare(*pairs: tuple[Column, Column]) -> Column:
    out = F.lit(0)
    for a, b in reversed(pairs):
        out = F.when(a < b, -1).when(a > b, 1).otherwise(out)
    return out


def primary_property(properties: Column, primary_id: Column) -> Column:
    """The observable form of the property that the pointer names; null if there is none."""
    hit = F.get(F.filter(properties, lambda p: p["property_id"] == primary_id), F.lit(0))
    return observable(hit, F.lit(PRIMARY))


def property_errors(properties: Column, primary: Column) -> Column:
    """What is inconsistent between projected properties and the primary one."""
    owned = F.filter(properties, lambda p: (p["ownership_status"] == "owned") & (p["role"] == PRIMARY))
    n = F.size(owned)
    codes = [
        F.when(properties.isNull(), "not_list"),
        F.when(n > 1, "multiple_owned_primary_residences"),
        F.when(primary.isNull() & (n > 0), "missing_pointer"),
        F.when(primary.isNotNull() & ~((n == 1) & F.get(owned, F.lit(0)).eqNullSafe(primary)), "pointer_collection_mismatch"),
    ]
    return F.array_compact(F.array(*codes))


def closed_value_errors(value: Column, allowed: Sequence[str]) -> Column:
    """Elements of a list that are not allowed, with ``not_list`` for a null list."""
    bad = F.transform(F.filter(value, lambda x: ~F.coalesce(x.isin(*allowed), F.lit(False))), lambda x: F.concat(F.lit("invalid_closed_element:"), F.coalesce(x, F.lit("null"))))
    return F.when(value.isNull(), F.array(F.lit("closed_collection_not_list"))).otherwise(bad)


def target_value(value: Column, selector: str, key: str | None = None, properties: Column | None = None, entity: Column | None = None) -> Column:
    """What a question asks of a JSON value, as text (lists as JSON): one of seven selectors.

    ``properties`` is the JSON list of properties for the two selectors that look
    a property up by ``entity`` or by the value itself. An unknown selector raises.
    """
    v = F.try_parse_json(value)
    items = F.try_variant_get(v, "$", "array<variant>")

    def field_of(pid: Column, field: str) -> Column:
        rows = F.try_variant_get(F.try_parse_json(properties), "$", "array<variant>")
        hit = F.get(F.filter(rows, lambda p: F.try_variant_get(p, "$.property_id", "string") == pid), F.lit(0))
        return F.try_variant_get(hit, f"$.{field}", "string")

    match selector:
        case "value":
            return F.coalesce(F.try_variant_get(v, "$", "string"), value)
        case "dict_key":
            return F.try_variant_get(v, f"$.{key}", "string")
        case "list_count":
            return F.when(items.isNull(), "0").otherwise(F.size(items).cast("string"))
        case "list_values":
            return F.when(items.isNull(), "[]").otherwise(F.to_json(v))
        case "owned_property_count":
            owned = F.size(F.filter(items, lambda p: F.try_variant_get(p, "$.ownership_status", "string") == "owned"))
            return F.when(items.isNull(), "0").otherwise(owned.cast("string"))
        case "property_field":
            return field_of(entity, key)
        case "primary_residence_address":
            return field_of(F.try_variant_get(v, "$", "string"), "address")
    raise ValueError(f"unknown selector: {selector}")


def masked_value(value: Column, selector: str, instance: Column, operation: Column) -> Column:
    """The value that a masked question shows, as text: the last property that the event instance touches counts."""
    v = F.try_parse_json(value)
    whole = F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    items = F.try_variant_get(v, "$", "array<variant>")
    get = lambda p, f: F.try_variant_get(p, f"$.{f}", "string")
    touches = lambda p: F.coalesce(F.array_contains(F.array_compact(F.array(*[get(p, f) for f in ("acquisition_event_instance_id", "disposal_event_instance_id", "event_instance_id")])), instance), F.lit(False))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    last = lambda xs: F.try_element_at(xs, F.lit(-1))
    record = F.when(items.isNotNull(), last(F.filter(items, touches))).otherwise(F.when(is_object, v))
    match selector:
        case "amount_krw":
            return F.when(is_object, F.coalesce(get(v, "amount_krw"), get(v, "amount"))).otherwise(whole)
        case "stage_transition":
            return F.when(operation == "no_change", "no_change").otherwise(whole)
        case "property_address":
            mine, named = F.filter(items, touches), F.filter(items, lambda p: F.length(get(p, "address")) > 0)
            listed = F.when(F.size(mine) > 0, get(last(mine), "address")).otherwise(get(last(named), "address"))
            return F.when(items.isNotNull(), listed).when(is_object, F.coalesce(get(v, "address"), whole)).otherwise(whole)
        case "property_ownership_status":
            return get(record, "ownership_status")
        case "property_loan_type":
            return F.when(get(record, "mortgage_status") == "active", "mortgage").otherwise(get(record, "mortgage_status"))
    return whole


def without(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` without gold columns; that one is missing already is no error."""
    return df.drop(*columns)


def predecessor(stage: Column, stages: Sequence[str]) -> Column:
    """The stage before, the first one for the first; null for an unknown stage."""
    known = F.array(*map(F.lit, stages))
    at = F.array_position(known, stage)
    return F.when(at > 0, F.element_at(known, F.greatest(at - 1, F.lit(1)).cast("int")))


def fixed_transitions(df: DataFrame, before: str, after: str, stages: Sequence[str]) -> DataFrame:
    """Transitions rewritten to start at the stage before their new one; ``changed`` tells which differ from what was there."""
    new = F.coalesce(predecessor(F.col(after), stages), F.col(before))
    return df.withColumn("changed", ~F.col(before).eqNullSafe(new)).withColumn(before, new)


# -- visibility ---------------------------------------------------------------------


def visible_for(ids: Column, condition: Column, evidence: Column, last: int = 15) -> Column:
    """Session ids shown under a condition: the whole prefix, its last ones, or only the evidence, in order; else an error."""
    unknown = F.raise_error(F.concat(F.lit("unknown condition: "), F.coalesce(condition, F.lit("null")))).cast("array<string>")
    tail = F.slice(ids, F.greatest(F.size(ids) - last + 1, F.lit(1)), F.lit(last))
    return F.when(condition == "full_prefix", ids).when(condition == f"last_{last}", tail).when(condition == "oracle_evidence", F.array_sort(F.array_distinct(F.array_intersect(evidence, ids)))).otherwise(unknown)


def visible_history(ids: Column, mode: str) -> Column:
    """None, the last one, or the last third (one at least) of the sessions."""
    n = F.size(ids)
    take = {"none": F.lit(0), "last": F.lit(1), "last_third": F.greatest(F.lit(1), F.floor(n / 3).cast("int"))}[mode]
    return F.when((n > 0) & (take > 0), F.slice(ids, F.greatest(n - take + 1, F.lit(1)), take)).otherwise(_strings())


def selection(text: str, known: Sequence[str]) -> list[str]:
    """The names of a list like ``a,b`` in the order of ``known``; ``all`` is every one. An unknown name raises."""
    asked = [x.strip() for x in text.split(",") if x.strip()]
    if asked == ["all"]:
        return list(known)
    if bad := [x for x in asked if x not in known]:
        raise ValueError(f"unknown names: {bad}")
    return [x for x in known if x in asked]


def future_evidence(df: DataFrame, evidence: str, checkpoint: str) -> DataFrame:
    """Rows that cite a session behind their checkpoint, with the first such session."""
    late = F.filter(evidence, lambda s: F.regexp_extract(s, "([0-9]+)$", 1).cast("int") > F.col(checkpoint))
    return df.withColumn("late", F.try_element_at(late, F.lit(1))).filter("late is not null")


# -- registry conditions ---------------------------------------------------------------


def status_as_of(history: Column, month: Column) -> Column:
    """The last status of a history (array of struct(status, month)) at or before a month; list order decides ties."""
    return F.try_element_at(F.filter(history, lambda h: h["month"] <= month), F.lit(-1))["status"]


def selects(label: Column, path: Column, kind: Column, paths: Column) -> Column:
    """Whether a selector of a label and a path (null: not stated) takes an action; a selector that states nothing takes none."""
    stated = label.isNotNull() | path.isNotNull()
    return stated & (label.isNull() | F.coalesce(kind == label, F.lit(False))) & (path.isNull() | F.coalesce(F.array_contains(paths, path), F.lit(False)))


def plan_condition(params: Column, statuses: Column, state: Column, actions: Column, need: Mapping[str, object]) -> Column:
    """Whether a plan's needs hold: param_equals, memory_status, state_equals (maps), state_truthy (names), actions all, any_of and absent (lists)."""
    truthy = lambda c: ~F.coalesce(c, F.lit("")).isin("", "0", "false", "None", "[]", "{}")
    equal = lambda m, ws: [F.coalesce(F.try_element_at(m, F.lit(k)) == str(w), F.lit(False)) for k, w in ws.items()]
    member = lambda m, ws: [F.coalesce(F.try_element_at(m, F.lit(k)).isin(*w), F.lit(False)) for k, w in ws.items()]
    terms = equal(params, need.get("param_equals", {})) + member(statuses, need.get("memory_status", {})) + equal(state, need.get("state_equals", {}))
    terms += [truthy(F.try_element_at(state, F.lit(k))) for k in need.get("state_truthy", ())]
    have = F.coalesce(actions, _strings())
    listed = lambda xs: F.array(*map(F.lit, xs))
    if need.get("all"):
        terms.append(F.size(F.array_except(listed(need["all"]), have)) == 0)
    if need.get("any_of"):
        terms.append(F.arrays_overlap(listed(need["any_of"]), have))
    if need.get("absent"):
        terms.append(~F.arrays_overlap(listed(need["absent"]), have))
    out = F.lit(True)
    for t in terms:
        out = out & F.coalesce(t, F.lit(False))
    return out


def contract_errors(params: Column, contract: Mapping[str, Sequence[str]]) -> Column:
    """Parameters that are missing or hold a value that their contract does not list, as codes in order of name."""
    codes = []
    for name, allowed in sorted(contract.items()):
        v = F.try_element_at(params, F.lit(name))
        codes.append(F.when(v.isNull(), f"missing:{name}").when(~v.isin(*allowed), F.concat(F.lit(f"invalid:{name}:"), v)))
    return F.array_compact(F.array(*codes))


# -- arrays and maps ---------------------------------------------------------------------


def flattened(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """Scalars of the JSON in column ``text``: a row for each, with the columns of ``keep``, path and value (text).

    Any depth: containers are taken apart level by level, ``LEVELS`` of them as
    rows pass. No text is deeper than it has opening brackets; where that leaves
    more levels, the containers still whole are written out once and taken
    further. Nulls, empty containers and texts that are no JSON have no row.
    """
    v, path, pos, key, item = (free(n, df) for n in ("variant", "path_", "pos_", "key_", "item_"))
    left = df.agg(F.max(F.length(text) - F.length(F.translate(text, "{[", "")))).first()[0] or 0
    rows, out = df.select(*keep, F.lit("$").alias(path), F.try_parse_json(text).alias(v)), []
    step = F.when(F.col(pos).isNull(), "").when(F.col(key).isNull(), F.concat(F.lit("["), F.col(pos).cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col(key)))
    kind = F.schema_of_variant(v)
    while True:
        for _ in range(min(left, LEVELS)):
            parts = rows.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col(v).outer()).toDF(pos, key, item))
            rows = parts.select(*keep, F.concat(path, step).alias(path), F.when(F.col(pos).isNull(), F.col(v)).otherwise(F.col(item)).alias(v))
        left -= LEVELS
        out.append(rows.filter(~kind.rlike("^(OBJECT|ARRAY|VOID)")).select(*keep, F.col(path).alias("path"), F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)).alias("value")))
        if left <= 0:
            return reduce(DataFrame.unionAll, out)
        rows = staged(rows.filter(kind.rlike("^(OBJECT|ARRAY)") & ~kind.isin("OBJECT<>", "ARRAY<VOID>")))  # those hold nothing
        if rows.isEmpty():
            return reduce(DataFrame.unionAll, out)


def merged(a: Column, b: Column) -> Column:
    """Entries of two maps, the second one's on equal keys; null counts as empty."""
    empty = F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))")
    left, right = F.coalesce(a, empty), F.coalesce(b, empty)
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def composite(df: DataFrame, column: str, by: Sequence[str], names: Sequence[str], sep: str = "|") -> DataFrame:
    """Entries of a map whose keys are joined parts: a row each, with the parts as columns."""
    out = df.select(*by, F.explode(column).alias("_k", "value"))
    parts = F.split("_k", f"[{sep}]", len(names))
    return out.select(*by, *[parts[i].alias(n) for i, n in enumerate(names)], "value")


def capped(values: Column, most: int) -> Column:
    """Values in order, the first ``most``: a bound of the data model."""
    return F.slice(F.array_sort(values), 1, most)


def unique(values: Column) -> Column:
    """Values once each, in order of first place."""
    return F.array_distinct(values)


def canonical_numbers(v: Column) -> Column:
    """A number as text without a fraction that is zero."""
    return F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))


def canonical_list(values: Column, as_set: bool = True) -> Column:
    """A list in the form in which it is compared: texts trimmed and squeezed, in order, as a set or with repeats."""
    clean = F.transform(values, lambda v: F.trim(F.regexp_replace(v, r"\s+", " ")))
    return F.array_sort(F.array_distinct(clean) if as_set else clean)
