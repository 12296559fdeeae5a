"""Mixing sources to target weights by hierarchical budgets.

The leaves of a domain / language / source tree hold documents. A token budget
is handed down from the root: the children of a node share its budget in
proportion to their weights, and a child never gets more than its supply (its
leaves' tokens times ``max_epochs``). What a short child leaves over goes to its
siblings first; only what all siblings together cannot use reaches the
ancestors' siblings. Each leaf then reads its documents epoch by epoch, every
epoch in its own seeded order, and keeps the token-prefix that fits.

No step gathers a leaf: prefix sums run over hash buckets of a leaf (256, then
256 below the one where the budget ends), and only the documents of that last
small bucket are put in order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm._common import WORD, materialize, small

PATH = ("domain", "lang", "source")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(level: Mapping[str, int] | None, name: Column) -> Column:
    out = F.lit(1)
    for k, v in (level or {}).items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out.cast("long")


def budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], budget: Column, max_epochs: int) -> DataFrame:
    """Leaf budgets. ``leaves`` has the columns of PATH and ``tokens``; ``budget`` may use ``total``, the tokens of all leaves.

    A weight that is not stated is 1; a node of weight 0 gets nothing. The
    budgets are whole tokens and sum to the budget, or to the whole supply if
    that is less.
    """
    keys = list(PATH)
    tree = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    for depth in range(len(keys), 0, -1):
        tree = tree.withColumn(f"w{depth}", _weight(weights.get(keys[depth - 1]), F.col(keys[depth - 1])))
    usable = lambda depth: F.when(F.col(f"w{depth}") > 0, F.col("cap")).otherwise(0)
    nodes = {len(keys): tree.withColumn("cap", usable(len(keys)))}
    for depth in range(len(keys) - 1, 0, -1):
        summed = nodes[depth + 1].groupBy(*keys[:depth]).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        summed = summed.withColumn(f"w{depth}", _weight(weights.get(keys[depth - 1]), F.col(keys[depth - 1])))
        nodes[depth] = summed.withColumn("cap", usable(depth))
    root = nodes[1].agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("cap"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    above = root.select(F.least(budget.cast("long"), F.col("cap")).alias("share"))
    for depth in range(1, len(keys) + 1):
        up = keys[: depth - 1]
        child = nodes[depth].select(*keys[:depth], "cap", "tokens", F.col(f"w{depth}").alias("w"))
        child = child.join(above, up) if up else child.crossJoin(F.broadcast(above))  # the root is one row
        above = _fill(child, up, keys[depth - 1]).select(*keys[:depth], "tokens", F.col("given").alias("share"))
        above = above if depth == len(keys) else above.drop("tokens")
    return above


def _fill(child: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Water-filling below each parent: the children with the least supply per weight fill up first."""
    group = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = group.orderBy(F.col("w") <= 0, F.col("cap") / F.when(F.col("w") > 0, F.col("w")), name)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    out = (
        child.withColumn("w_left", F.sum("w").over(group) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("b_left", F.col("share") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("full", (F.col("w") > 0) & (F.col("cap") * F.col("w_left") <= F.col("w") * F.col("b_left")))
    )
    open_w = F.when(~F.col("full"), F.col("w")).otherwise(0)
    out = (
        out.withColumn("w_open", F.sum(open_w).over(group))
        .withColumn("rest", F.col("share") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(group))
        .withColumn("w_to", F.sum(open_w).over(so_far))
    )
    cut = lambda w: F.expr(f"coalesce(({w} * rest) div nullif(w_open, 0), 0)")
    return out.withColumn("given", F.when(F.col("full"), F.col("cap")).when(F.col("w") > 0, cut("w_to") - cut("(w_to - w)")).otherwise(F.lit(0)))


def _leaf(docs: DataFrame, domain: Column, tokens: Column | None, *more: Column) -> DataFrame:
    """What the mixture needs of each row: doc_id, the leaf's names, tokens, and h, a hash of the text that orders rows of one id."""
    named = [domain.alias("domain"), F.col("lang").alias("lang"), F.col("source").alias("source")]
    count = word_count(F.col("text")) if tokens is None else tokens
    return docs.select(*more, "doc_id", *[F.coalesce(c, F.lit("")).alias(n) for c, n in zip(named, PATH)], count.alias("tokens"), F.xxhash64("text").alias("h"))


def _taken(slim: DataFrame, rows: DataFrame, weights: Mapping[str, Mapping[str, int]], budget: Column, max_epochs: int, seed: int) -> DataFrame:
    """``rows`` with ``full`` and ``part``; ``slim`` has the same rows without further columns and is read several times."""
    leaves = slim.groupBy(*PATH).agg(F.sum("tokens").alias("tokens"))
    plan = budgets(leaves, weights, budget, max_epochs)
    plan = plan.select(*PATH, F.expr("coalesce(share div nullif(tokens, 0), 0)").alias("full"), F.expr("coalesce(share % nullif(tokens, 0), 0)").alias("rest"))
    plan = small(materialize(plan.coalesce(1), "mix_plan"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("h").cast("string")))

    def located(df: DataFrame) -> DataFrame:
        out = df.join(plan, list(PATH)).withColumn("at", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), name)))
        return out.withColumn("b1", F.substring("at", 1, 2)).withColumn("b2", F.substring("at", 3, 2))

    at = located(slim).filter("rest > 0")
    first = _ends_in(at, [], "b1")
    second = _ends_in(at.join(small(first.select(*PATH, "b1", "base")), [*PATH, "b1"]).withColumn("rest", F.col("rest") - F.col("base")).drop("base"), ["b1"], "b2")
    ends = first.select(*PATH, F.col("b1").alias("e1"), F.col("base").alias("base1")).join(second.select(*PATH, F.col("b2").alias("e2"), F.col("base").alias("base2")), list(PATH), "left")
    ends = small(materialize(ends.coalesce(1), "mix_ends"))
    got = located(rows).join(ends, list(PATH), "left")
    edge = (F.col("b1") == F.col("e1")) & (F.col("b2") == F.col("e2"))
    inside = F.when(F.col("e1").isNull() | (F.col("b1") > F.col("e1")), 0).when(F.col("b1") < F.col("e1"), F.col("tokens")).when(F.col("b2") < F.col("e2"), F.col("tokens")).otherwise(0)
    run = W.partitionBy(*PATH).orderBy("at", "doc_id", "tokens", "h").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("rest") - F.col("base1") - F.col("base2") - F.coalesce(F.sum("tokens").over(run), F.lit(0))
    exact = got.filter(edge).withColumn("part", F.greatest(F.lit(0), F.least(F.col("tokens"), left)))
    rest = got.filter(~F.coalesce(edge, F.lit(False))).withColumn("part", inside)
    cols = [*rows.columns, "full", "part"]
    return exact.select(cols).unionByName(rest.select(cols))


def mix(docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, int]], budget: Column, max_epochs: int = 4, seed: int = 1, tokens: Column | None = None) -> DataFrame:
    """How often, and how far, each document is read: a row for each row of ``docs``.

    ``docs`` needs ``doc_id``, ``text``, ``lang`` and ``source``; other columns
    are not looked at. Returned: ``doc_id``, the leaf's ``domain``, ``lang`` and
    ``source``, ``tokens``, ``full`` (whole epochs that hold the document) and
    ``part`` (tokens taken from it in the last, partial epoch). Null labels
    count as an empty name. Documents without tokens are never taken. Repeated
    rows are separate documents; equal ids in one leaf are ordered by their
    token counts, then by a hash of their texts, and rows without an id are
    placed by that hash. An empty table gives an empty result.
    """
    slim = materialize(_leaf(docs, domain, tokens), "mix_tokens")
    return _taken(slim, slim, weights, budget, max_epochs, seed).select("doc_id", *PATH, "tokens", "full", "part")


def _ends_in(rows: DataFrame, inside: list[str], bucket: str) -> DataFrame:
    """Per leaf, the bucket in which ``rest`` tokens end, and the tokens of the buckets before it."""
    sums = rows.groupBy(*PATH, *inside, bucket).agg(F.sum("tokens").alias("t"), F.max("rest").alias("rest"))
    upto = W.partitionBy(*PATH).orderBy(bucket).rowsBetween(W.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("t").over(upto)).withColumn("base", F.col("upto") - F.col("t"))
    return sums.filter("base < rest and upto >= rest and t > 0")


def selected(docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, int]], budget: Column, max_epochs: int = 4, seed: int = 1, tokens: Column | None = None) -> DataFrame:
    """The mixture of ``mix`` as documents: a row for each epoch that holds a document, the last one cut to its token-prefix.

    The columns of ``docs`` are returned, whatever their names, ``n_chars``
    following the text where both exist. Decisions are made row by row, so
    repeated and null ids keep their rows apart; of equal rows any one is cut.
    Only rows of the small buckets in which a leaf's budget ends are exchanged.
    """
    slim = materialize(_leaf(docs, domain, tokens), "mix_tokens")
    rows = _taken(slim, _leaf(docs, domain, tokens, F.struct("*").alias("row")), weights, budget, max_epochs, seed).filter("tokens > 0 and (full > 0 or part > 0)")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - F.when(F.col("part") > 0, 0).otherwise(1))))
    whole = (F.col("k") < F.col("full")) | (F.col("part") >= F.col("tokens"))
    words = F.split(F.regexp_replace("row.text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    text = F.when(whole, F.col("row.text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("part"), F.lit(1)).cast("int")), " "))
    rows = rows.withColumn("text", text)
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return rows.select(*[(changed[c] if changed.get(c) is not None else F.col("row")[c]).alias(c) for c in docs.columns])
