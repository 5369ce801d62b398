"""Merkle manifest of a table: one tree of digests per group, one over the groups' roots, and a proof for every row.

Rows are leaves. Within a group they are numbered in their order, and the number's digits (base 16) become columns. A
block is the 4,096 rows that agree in all but the last three digits; three groupings take these digits away, last one
first, and every grouping nests the structs of the one before as children of a node. Block roots are the leaves of the
next, 256 to 4,096 times smaller table, until one node per group is left; groups' roots go through the same steps under
one key. Going down again, a block's row gets the siblings above it and is exploded through its nested children, so that
proofs within a block need no join; there is one join per block, not per leaf, for what lies above it. (One nested struct
for a whole group would be a row without bound.)

A node is the digest of its children's hexadecimal digests on end, also when the last run of a level has a single child.
Rows of a group are ordered by ``order``, null first, then by digest; equal rows are interchangeable. Null groups are a
group. Nulls and edges: a null field counts as ``-``; a group of one row has that row's leaf as its root; an empty table
has no root and no proofs; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latentlake.llm.text import written
from latentlake.plans.runtime import join_groups, tasks

ARITY = 16
DIGITS = 3  # of a rank within a block
BLOCK = ARITY**DIGITS
ROWS_PER_RANGE = 2_000_000
HEX = 64  # characters of a digest
PATH_BYTES = 8_192  # of a block's siblings above it, for the size check of a broadcast


def field(value: Column) -> Column:
    """``-`` for null, else number of bytes, colon, value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(*values: Column) -> Column:
    """The leaf of a row with these fields."""
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a proof on end, from the leaf's level upward, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """(tree, rank, n, ...): rows numbered from 0 in their tree, with the tree's size.

    Rows are sorted in ranges over (tree, order), numbered in their range, and moved on by what earlier ranges hold of
    the tree; so a tree may have any share of the rows.
    """
    spark = rows.sparkSession
    n = max(tasks(spark), -(-rows.count() // ROWS_PER_RANGE))
    cut = rows.repartitionByRange(n, "tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    cut = written(cut, "sorted").withColumn("part", F.shiftright("at", 33))
    held = cut.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = held.select("tree", "part", (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("moved"), F.sum("held").over(tree).alias("n"))
    return join_groups(cut, moved, ["tree", "part"]).withColumn("rank", F.col("at") + F.col("moved")).drop("at", "part", "moved")


def nested(nodes: DataFrame, kept: list[str]) -> DataFrame:
    """(tree, n, block, h, kids): one row per block of (tree, n, rank, h, kept...), its digits grouped away into structs."""
    digits = [f"d{k}" for k in range(DIGITS)]
    rows = nodes.withColumns({d: F.floor(F.col("rank") / ARITY**k) % ARITY for k, d in enumerate(digits)}).withColumn("block", F.floor(F.col("rank") / BLOCK))
    rows, held = rows.repartition("tree", "block"), ["h", *kept]  # the groupings below keep this partitioning
    for k, d in enumerate(digits):
        kids = F.sort_array(F.collect_list(F.struct(d, *held)))
        rows = rows.groupBy("tree", "n", "block", *digits[k + 1:]).agg(kids.alias("kids"))
        every = F.array_join(F.col("kids.h"), "")
        rows = rows.withColumn("h", F.when(F.col("n") > ARITY**k, F.sha2(every, 256)).otherwise(every))
        held = ["h", "kids"]
    return rows


def unnested(blocks: DataFrame, kept: list[str], above: list[str]) -> DataFrame:
    """(tree, rank, h, kept..., above..., path): the leaves of blocks that have the path above them."""
    rows = blocks.withColumn("rank", F.col("block"))
    for k in reversed(range(DIGITS)):
        inner = ["h", *(kept if k == 0 else ["kids"])]
        rows = rows.withColumn("every", F.array_join(F.col("kids.h"), "")).select("tree", "n", "rank", "every", "path", *above, F.explode("kids").alias("kid"))
        at = (F.col(f"kid.d{k}") * HEX).cast("int")
        step = F.array(F.struct(F.substring("every", F.lit(1), at).alias("left"), F.substring("every", at + HEX + 1, F.lit(ARITY * HEX)).alias("right")))
        rows = rows.select("tree", "n", (F.col("rank") * ARITY + F.col(f"kid.d{k}")).alias("rank"), *above,
                           F.when(F.col("n") > ARITY**k, F.concat(step, "path")).otherwise(F.col("path")).alias("path"), *[F.col(f"kid.{c}").alias(c) for c in inner])
    return rows.drop("n")


def raised(nodes: DataFrame, kept: list[str]) -> list[DataFrame]:
    """Tables of blocks from (tree, n, rank, h, kept...) upward; the last has one block per tree."""
    levels = []
    while True:
        levels.append(written(nested(nodes, [] if levels else kept), "blocks"))
        if (levels[-1].agg(F.max("n")).first()[0] or 0) <= BLOCK:
            return levels
        nodes = levels[-1].select("tree", "n", F.col("block").alias("rank"), "h").withColumn("n", F.ceil(F.col("n") / BLOCK))


def lowered(levels: list[DataFrame], tops: DataFrame, kept: list[str], above: list[str]) -> DataFrame:
    """Leaves of levels of blocks; tops: (tree, path, above...)."""
    rows, on = tops, ["tree"]
    for k in reversed(range(len(levels))):
        blocks = join_groups(levels[k], rows, on, row_bytes=PATH_BYTES)
        rows = unnested(blocks, [] if k else kept, above)
        if k:
            rows, on = rows.select("tree", F.col("rank").alias("block"), "path", *above), ["tree", "block"]
    return rows


def proofs(rows: DataFrame, leaf: Column, group: str, order: list[str], keep: dict[str, Column] | None = None) -> DataFrame:
    """(keep..., leaf, path, subroot, root) for every row.

    ``path`` holds one struct (left, right) per level from the leaf to the root: the digests beside the own one, on end.
    ``keep`` are columns to carry along; names are the caller's.
    """
    keep = keep or {}
    kept = [f"k{i}" for i in range(len(keep))]
    leaves = rows.select(F.col(group).alias("tree"), leaf.alias("h"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[c.alias(k) for k, c in zip(kept, keep.values())])
    leaves = written(leaves, "leaves")  # the fields are read and hashed once
    levels = raised(ranked(leaves, [*[f"o{i}" for i in range(len(order))], "h"]), kept)
    groups = levels[-1].select(F.lit(0).alias("tree"), F.col("tree").alias("o0"), "h")
    crown = raised(ranked(written(groups, "groups"), ["o0"]), ["o0"])
    empty = F.array().cast("array<struct<left: string, right: string>>")
    top = crown[-1].select("tree", empty.alias("path"), F.col("h").alias("root"))
    tops = lowered(crown, top, ["o0"], ["root"]).select(F.col("o0").alias("tree"), "path", F.col("h").alias("subroot"), "root")
    out = lowered(levels, tops, kept, ["subroot", "root"])
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], F.col("h").alias("leaf"), "path", "subroot", "root")
