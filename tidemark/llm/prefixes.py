"""Prefix trie of conversations by heavy-path decomposition.

A node is a distinct sequence of first turns, under a hash of 128 bits that is a
sum over (place, turn), so that prefix sums give the nodes of a conversation and
a long conversation can be summed in blocks. Of a node's children the one with
most conversations is heavy; heavy edges make paths, each from a top down to a
leaf, and named by the first conversation that ends at that leaf. What a node's
subtree holds is the suffix sum of what the path's nodes hold themselves and
receive from the tops of light paths below them. A light edge at least halves
the number of conversations, so with paths numbered by their light edges to the
root, the deepest first, all sums are there after at most log2(conversations)
rounds, each one pass over its paths.

Nothing gathers a node, a path or a conversation: members are counted in the
map tasks first, paths and conversations are summed in blocks of ``BLOCK``
places whose totals are carried on, and joins on keys that may have many rows
meet a broadcast of at most ``HOT`` nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm._common import materialize, parts
from tidemark.llm.mixing import word_count

#: Places of a conversation or path that are summed at a time; ids of a range that are joined to a string at a time (a power of two).
BLOCK, RANGE_BITS = 4_096, 12
#: A node with more than one in HOT of all turns is joined by broadcast: there are fewer than HOT of them.
HOT = 5_000
KEY = ["ka", "kb"]
PARENT = ["pa", "pb"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, p (place in the conversation, from 1), digest of role and text, words of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", role.alias("role"), F.sha2(text.cast("binary"), 256).alias("by_text"), digest.alias("digest"), word_count(text).alias("words"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("by_text")]
    # sorted by range, so that a conversation may spread over tasks; all but its first part need the size of the parts before
    placed = rows.repartitionByRange(parts(rows.sparkSession), *order).sortWithinPartitions(*order).select("conv_id", "digest", "words", F.monotonically_increasing_id().alias("place"))
    placed = materialize(placed, "turns").withColumn("part", F.shiftright("place", 33))
    sizes = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("conv_id", "part", F.sum("n").over(before).alias("before")).filter("before > 0")  # at most one for each part
    number = F.row_number().over(W.partitionBy("conv_id", "part").orderBy("place")).cast("long")
    out = placed.withColumn("k", number).join(F.broadcast(offsets), ["conv_id", "part"], "left")
    return out.select("conv_id", (F.col("k") + F.coalesce("before", F.lit(0))).alias("p"), "digest", "words")


def _block(place: str) -> Column:
    return F.expr(f"{place} div {BLOCK}").alias("block")


def _by_block(df: DataFrame, last: str) -> DataFrame:
    """A row for each block of places up to ``last``, so that a join on (conv_id, block) meets BLOCK rows at most."""
    return df.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"{last} div {BLOCK}"))))


def rebuilt(turns: DataFrame, every: int = 20, modulus: int = 4) -> tuple[DataFrame, DataFrame]:
    """Each conversation with its head replaced: (conv_id, d, digest, words, turns) and (conv_id, turns).

    The head is the first h turns of the conversation whose id is the largest
    multiple of ``every`` towards zero; h is the id's crc32 modulo ``modulus``.
    """
    convs = materialize(turns.groupBy("conv_id").agg(F.max("p").alias("n")), "conversations")
    head = F.col("conv_id") - F.col("conv_id") % every
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % modulus).withColumn("head", head)
    long = convs.select(F.col("conv_id").alias("head"), F.col("n").alias("head_n"))
    convs = convs.join(long, "head", "left").withColumn("got", F.least("h", F.coalesce("head_n", F.lit(0))))
    convs = materialize(convs.select("conv_id", "head", "h", "n", "got", (F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns")), "rebuilt")
    own = turns.withColumn("block", _block("p")).join(_by_block(convs, "n"), ["conv_id", "block"]).filter("p > h")
    own = own.select("conv_id", (F.col("p") - F.col("h") + F.col("got")).alias("d"), "digest", "words", "turns")
    heads = turns.filter(f"conv_id % {every} = 0 and p < {modulus}").withColumnRenamed("conv_id", "head")
    heads = heads.join(convs, "head").filter("p <= h").select("conv_id", F.col("p").alias("d"), "digest", "words", "turns")
    return own.unionByName(heads), convs.select("conv_id", "turns")


def steps(turns: DataFrame) -> DataFrame:
    """A row for each conversation and depth above 0: the node that it passes and that node's parent."""
    low = F.lit((1 << 32) - 1)
    one, two = F.xxhash64("digest", "d"), F.xxhash64("d", "digest", F.lit(1))
    parts_of = {"x0": F.shiftrightunsigned(one, 32), "x1": one.bitwiseAND(low), "x2": F.shiftrightunsigned(two, 32), "x3": two.bitwiseAND(low)}
    rows = turns.select("*", *[c.alias(n) for n, c in parts_of.items()], _block("d"))
    totals = rows.groupBy("conv_id", "block").agg(*[F.sum(x).alias(f"t{x}") for x in parts_of])
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select("conv_id", "block", *[F.sum(f"t{x}").over(before).alias(f"c{x}") for x in parts_of])
    inside = W.partitionBy("conv_id", "block").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("*", *[F.sum(x).over(inside).alias(f"r{x}") for x in parts_of]).join(carried, ["conv_id", "block"])
    upto = {x: F.col(f"r{x}") + F.coalesce(f"c{x}", F.lit(0)) for x in parts_of}
    key = lambda s, a, b: F.shiftleft(s[a].bitwiseAND(low), 32).bitwiseOR(s[b].bitwiseAND(low))
    above = {x: upto[x] - F.col(x) for x in parts_of}
    return rows.select("conv_id", "d", key(upto, "x0", "x1").alias("ka"), key(upto, "x2", "x3").alias("kb"), key(above, "x0", "x1").alias("pa"), key(above, "x2", "x3").alias("pb"), "words", (F.col("d") == F.col("turns")).alias("ends"))


def _join_few(rows: DataFrame, few: DataFrame, on: list[str], hot: Column, how: str) -> DataFrame:
    """``rows`` joined with ``few`` (one row for each key). Keys that are ``hot`` in few, fewer than HOT, are broadcast, so their rows stay where they are."""
    few = few.withColumn("is_hot", hot)
    broad = few.filter("is_hot").drop("is_hot")
    marked = rows.join(F.broadcast(broad.select(*on, F.lit(True).alias("is_hot"))), on, "left")
    here = marked.filter("is_hot").drop("is_hot").join(F.broadcast(broad), on, how)
    return here.unionByName(marked.filter("is_hot is null").drop("is_hot").join(few.filter("not is_hot").drop("is_hot"), on, how))


def _ends(passed: DataFrame, convs: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ids that end at each node, in ascending order."""
    root = convs.filter("turns = 0").select(F.lit(0).cast("long").alias("ka"), F.lit(0).cast("long").alias("kb"), "conv_id")
    rows = passed.filter("ends").select(*KEY, "conv_id").unionByName(root)
    spans = rows.groupBy(*KEY, F.shiftright("conv_id", RANGE_BITS).alias("span")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))  # ids differ, so a range is bounded
    strings = spans.select(*KEY, "span", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ka", pa.int64()), ("kb", pa.int64()), ("ends_sha256", pa.string())])
        last, sha = None, hashlib.sha256()
        for batch in batches:
            done = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
                if (a, b) == last:
                    sha.update(b",")
                else:
                    if last is not None:
                        done.append((*last, sha.hexdigest()))
                    last, sha = (a, b), hashlib.sha256()
                sha.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else ((), (), ()), schema.types)], schema=schema)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*last, sha.hexdigest()), schema.types)], schema=schema)

    dealt = strings.repartition(parts(rows.sparkSession), *KEY).sortWithinPartitions(*KEY, "span")
    return dealt.mapInArrow(hashed, "ka long, kb long, ends_sha256 string")


def _paths(passed: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """path, level (light edges above), top (depth of the path's top), d, and the node's key: a row for each node."""
    leaves = nodes.filter("n_children = 0").select("conv_id", F.col("d").alias("leaf"))
    spread = _by_block(leaves, "leaf")
    walks = passed.select("conv_id", "d", *KEY, _block("d")).join(spread.select("conv_id", "block"), ["conv_id", "block"]).drop("block")
    walks = materialize(walks, "walks")  # the way from the root to each leaf
    light = nodes.filter("d > 0 and not heavy").select(*KEY, "n_convs")
    crossed = _join_few(walks, light, KEY, F.col("n_convs") * HOT > total, "inner")
    tops = crossed.groupBy("conv_id").agg(F.max("d").alias("top"), F.count(F.lit(1)).alias("level"))
    tops = leaves.join(tops, "conv_id", "left").fillna(0, ["top", "level"])
    tops = materialize(tops, "tops")
    rows = walks.select("*", _block("d")).join(_by_block(tops, "leaf"), ["conv_id", "block"]).filter("d >= top")
    zero = F.lit(0).cast("long")
    root = tops.filter("level = 0").select("conv_id", zero.alias("d"), zero.alias("ka"), zero.alias("kb"), "top", "level")
    return rows.select("conv_id", "d", *KEY, "top", "level").unionByName(root).withColumnRenamed("conv_id", "path")


def _subtree_sums(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """n_leaves and saved_tokens of each node's subtree, from the deepest paths up."""
    own = nodes.select(*KEY, *PARENT, F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("a"), ((F.col("n_convs") - 1) * F.col("words")).alias("b"))
    rows = materialize(paths.join(own, KEY), "paths", "level")
    levels = rows.agg(F.max("level")).first()[0]
    received, out = None, []
    for level in range(-1 if levels is None else levels, -1, -1):
        here = rows.filter(F.col("level") == level).drop("level")
        if received is not None:
            here = here.join(received, KEY, "left").select("path", "d", *KEY, *PARENT, "top", *[(F.col(x) + F.coalesce(f"got_{x}", F.lit(0))).alias(x) for x in ("a", "b")])
        here = here.select("*", _block("d"))
        inside = W.partitionBy("path", "block").orderBy(F.col("d").desc()).rowsBetween(W.unboundedPreceding, 0)
        totals = here.groupBy("path", "block").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
        behind = W.partitionBy("path").orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
        carried = totals.select("path", "block", *[F.coalesce(F.sum(f"t{x}").over(behind), F.lit(0)).alias(f"c{x}") for x in ("a", "b")])
        summed = here.select("*", *[F.sum(x).over(inside).alias(f"s{x}") for x in ("a", "b")]).join(carried, ["path", "block"])
        summed = summed.select(*KEY, *PARENT, (F.col("d") == F.col("top")).alias("is_top"), (F.col("sa") + F.col("ca")).alias("n_leaves"), (F.col("sb") + F.col("cb")).alias("saved_tokens"))
        summed = materialize(summed, f"level_{level}")
        out.append(summed.select(*KEY, "n_leaves", "saved_tokens"))
        tops = summed.filter("is_top").groupBy(*PARENT).agg(F.sum("n_leaves").alias("got_a"), F.sum("saved_tokens").alias("got_b"))
        received = tops.withColumnsRenamed(dict(zip(PARENT, KEY)))
    zero = nodes.filter("false").select(*KEY, F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    for df in out:
        zero = zero.unionByName(df)
    return zero


def trie(conversations: DataFrame, every: int = 20, modulus: int = 4) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role, text; other columns are not looked
    at. Turns are ordered by turn, null first; equal ones by role and the SHA-256
    of the text, and equal rows are turns of their own. A null role or text is
    empty. Rows without a conv_id belong to no conversation and take no part. A
    conversation that is rebuilt to nothing is a member of the root only. An
    empty table has no conversations and gives no node. Very long conversations
    are summed in blocks.
    """
    turns = materialize(numbered_turns(conversations), "numbered")
    made, convs = rebuilt(turns, every, modulus)
    passed = materialize(steps(made), "steps")
    total = passed.count()
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(zero.alias("d"), *[zero.alias(k) for k in KEY], *[F.lit(None).cast("long").alias(k) for k in PARENT], "conv_id", "n_convs", zero.alias("words"))
    nodes = passed.groupBy("d", *KEY, *PARENT).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    nodes = materialize(nodes.unionByName(root), "nodes")
    largest = F.max(F.struct("n_convs", F.bitwise_not("conv_id").alias("first"), *KEY))
    kids = nodes.filter("d > 0").groupBy(*PARENT).agg(F.count(F.lit(1)).alias("n_children"), largest.alias("most"))
    kids = materialize(kids.select(*PARENT, "n_children", F.col("most.ka").alias("ha"), F.col("most.kb").alias("hb")), "children")
    heavy = kids.select(F.col("ha").alias("ka"), F.col("hb").alias("kb"), F.lit(True).alias("heavy"))
    nodes = nodes.join(kids.select(F.col("pa").alias("ka"), F.col("pb").alias("kb"), "n_children"), KEY, "left").join(heavy, KEY, "left").fillna(0, ["n_children"]).fillna(False, ["heavy"])
    nodes = materialize(nodes, "marked")
    sums = _subtree_sums(_paths(passed, nodes, total), nodes)
    above = nodes.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "n_convs").filter("n_convs > 0")
    below = _join_few(nodes.filter("d > 0"), above.withColumnRenamed("n_convs", "above_convs"), PARENT, F.col("above_convs") * HOT > total, "inner").select(*KEY, "parent_conv_id")
    nothing = hashlib.sha256(b"").hexdigest()
    out = nodes.join(sums, KEY).join(_ends(passed, convs), KEY, "left").join(below, KEY, "left")
    return out.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
