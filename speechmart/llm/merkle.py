"""A Merkle manifest of a table, collapsed in blocks by higher-order functions.

Every row is a leaf. The leaves of one group ascend by id; while several nodes remain, every ``ARITY``
consecutive ones become the digest of their digests. A group's last node is its subroot, and the
subroots, ordered by group, are collapsed likewise to the root.

Leaves find their position from ranges with counted bases and are collected in blocks of ``BLOCK``
consecutive leaves, which is ``ARITY`` to the power ``DEPTH``. A block's array is collapsed natively, a
level a step of ``aggregate``: ``sequence`` counts the runs, ``slice`` and ``array_join`` take one run,
``transform`` makes the next level. The block roots are the leaves of the next pass, so every pass has
one row for ``BLOCK`` of the pass before, and a group of any size spreads over its blocks. On the way
back each block gets the siblings above it once; proofs of its leaves are cut from the levels it holds.
No Python runs at any step.

A digest is the lower-case hex sha256 of its inputs, concatenated; digests enter as hex text. A value is
``-`` if null, else its length in UTF-8 bytes, a colon and the value. Null groups come first. Rows with a
null id come before all others and are never tampered; rows equal in id are ordered by their leaf, so
equal rows are leaves of their own side by side. Texts are read whole; an empty table gives an empty
result; columns other than the five named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechmart.operators.ranking import running_total

from .common import lower_ascii, materialize, pick

ARITY, DEPTH = 8, 3
BLOCK = ARITY**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """``-`` for null, else byte length, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def _collapse(nodes: Column) -> Column:
    """The next level of an array of nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), ""), 256))


def _levels(nodes: Column, depth: Column) -> Column:
    """The nodes and ``depth`` levels above them."""
    return F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(1), depth), F.array(nodes), lambda levels, _: F.concat(levels, F.array(_collapse(F.element_at(levels, -1)))))


def _siblings(levels: Column, place: Column) -> Column:
    """From the lowest level up, what stands left and right of the node on the way from ``place``."""

    def step(level: Column, k: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(ARITY), k)).cast("int")
        first = at - at % ARITY
        left = F.slice(level, first + 1, at - first)
        right = F.slice(level, at + 2, first + ARITY - at - 1)
        return F.struct(F.array_join(left, "").alias("l"), F.array_join(right, "").alias("r"))

    below_root = F.slice(levels, F.lit(1), F.size(levels) - 1)
    return F.transform(below_root, step)


def _fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["l"], node, s["r"]), 256))


def _proof(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def _blocks(nodes: DataFrame, sizes: DataFrame, carried: list[str], name: str) -> DataFrame:
    """group, block, items (node and what is carried), levels, n: blocks of the nodes, which have group, pos and node."""
    item = F.struct("pos", "node", *carried)
    blocks = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long")).groupBy("group", "block").agg(F.sort_array(F.collect_list(item)).alias("items"))
    blocks = blocks.join(sizes.withColumnRenamed("group", "_g"), F.col("group").eqNullSafe(F.col("_g"))).drop("_g")
    # one block alone is collapsed until a single node is left; of several, each is collapsed to its full depth
    depth = F.when(F.col("n") > BLOCK, DEPTH).otherwise(sum(F.when(F.col("n") > ARITY**k, 1).otherwise(0) for k in range(DEPTH)))
    return materialize(blocks.withColumn("levels", _levels(F.transform("items", lambda x: x["node"]), depth)), name)


def _top(blocks: DataFrame) -> Column:
    return F.element_at(F.element_at("levels", -1), 1)


def _climb(nodes: DataFrame, sizes: DataFrame, carried: list[str], name: str) -> tuple[list[DataFrame], DataFrame]:
    """All passes over the nodes of every group, and (group, root)."""
    passes = [_blocks(nodes, sizes, carried, f"{name}-0")]
    while True:
        roots = passes[-1].select("group", F.col("block").alias("pos"), _top(passes[-1]).alias("node"), "n")
        if passes[-1].filter(F.col("n") > BLOCK).isEmpty():
            done = roots
            break
        # groups that are one node already pass through as a block of one
        sizes = roots.groupBy("group").agg(F.count("*").alias("n"))
        passes.append(_blocks(roots.drop("n"), sizes, [], f"{name}-{len(passes)}"))
    return passes, done.select("group", F.col("node").alias("top"))


def _descend(passes: list[DataFrame], above: DataFrame) -> DataFrame:
    """The blocks of the lowest pass with ``up``: the siblings above each block, given those above each group."""
    blocks = passes[-1].join(above.withColumnRenamed("group", "_g"), F.col("group").eqNullSafe(F.col("_g"))).drop("_g")
    for lower in reversed(passes[:-1]):
        inner = F.transform("items", lambda x: F.struct(x["pos"].alias("_b"), F.concat(_siblings(F.col("levels"), (x["pos"] % BLOCK).cast("int")), F.col("up")).alias("up")))
        ways = blocks.select(F.col("group").alias("_g"), *[c for c in above.columns if c not in ("group", "up")], F.explode(inner).alias("way"))
        ways = ways.select("_g", *[c for c in above.columns if c not in ("group", "up")], "way._b", "way.up")
        blocks = lower.join(ways, F.col("group").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b"))).drop("_g", "_b")
    return blocks


def _counted(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("group").agg(F.count("*").alias("n"))


def manifest(rows: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One row per row of ``rows``: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``folded_root`` is what the siblings give with the leaf of the tampered row: where 3 divides the
    crc32 of the id, A-Z of the text are in lower case. ``verified`` tells whether that is the root.
    """
    at = {c: F.col(f"`{c}`") for c in fields}
    shifted = at | {text_col: lower_ascii(at[text_col])}
    tampered = F.coalesce(F.crc32(at[id_col].cast("string").cast("binary")) % 3 == 0, F.lit(False))
    leaf = digest(*[encoded(at[c]) for c in fields])
    other = F.when(tampered, digest(*[encoded(shifted[c]) for c in fields])).otherwise(leaf)
    leaves = pick(rows, fields).select(at[group_col].alias("group"), at[id_col].alias("id"), leaf.alias("node"), other.alias("seen"))
    # the digests are made once, and only they are dealt to ranges
    placed = running_total(materialize(leaves, "merkle-digests"), ["group"], ["id", "node"], F.lit(1), "pos")
    placed = materialize(placed, "merkle-leaves")
    passes, tops = _climb(placed, _counted(placed), ["id", "seen"], "merkle-leaves")
    tops = materialize(tops, "merkle-tops")
    # the groups' subroots, in order of the groups, are the leaves of one more tree
    ordered = running_total(tops.withColumn("all", F.lit(0)), ["all"], ["group"], F.lit(1), "pos")
    ordered = materialize(ordered.select(F.col("all").alias("group"), "pos", F.col("top").alias("node"), F.col("group").alias("key")), "merkle-groups")
    upper, roots = _climb(ordered, _counted(ordered), ["key"], "merkle-groups")
    none = F.array().cast("array<struct<l:string,r:string>>")
    high = _descend(upper, roots.withColumn("up", none).withColumnRenamed("top", "root"))
    inner = F.transform("items", lambda x: F.struct(x["key"].alias("group"), x["node"].alias("subroot"), F.concat(_siblings(F.col("levels"), (x["pos"] % BLOCK).cast("int")), F.col("up")).alias("up")))
    above = materialize(high.select("root", F.explode(inner).alias("x")).select("x.group", "x.subroot", "root", "x.up"), "merkle-above")
    blocks = _descend(passes, above)
    steps = F.transform("items", lambda x: F.struct(x["id"].alias("id"), x["node"].alias("leaf"), x["seen"].alias("seen"), F.concat(_siblings(F.col("levels"), (x["pos"] % BLOCK).cast("int")), F.col("up")).alias("steps")))
    out = blocks.select("subroot", "root", F.explode(steps).alias("x")).select("subroot", "root", "x.*")
    out = out.select(F.col("id").alias(id_col), "leaf", "subroot", "root", _proof(F.col("steps")).alias("proof_sha256"), _fold(F.col("seen"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
