"""Prefix trie of conversations, by van Emde Boas recursion over depth.

A sequence of at most 2**K steps, the last of which ends it, is cut at half depth. What it has up to the cut is a path in
the upper trie, and the digest of that path, together with the name of the trie's root, is the name of the cut node; the
rest belongs to the lower trie under that name. Both halves are cut in the same way, all tries of one height in one
table, so that K rounds name every prefix of every sequence, whatever its length. Digests of the halves come first, in K
rounds from pairs of steps upward.

Equal names at one depth are one node. Totals over subtrees are grafted upward in K rounds, small tries first: when tries
of half the height have their totals, those of every lower root are added to its ancestors in the upper trie, which are
the prefixes of one of its members there. A node at depth d is known by its smallest member too, which passes no other
node of that depth. No step collects the rows of a conversation or of a node: counts and totals are combined before
the shuffle, and the one thing that is sequential by definition, the digest of a node's ends in order, is streamed over
strings of up to 4,096 ids that were joined in ranges before.

Nulls and edges: rows without a conversation's id take no part; null roles and texts are empty; turns sort null first, then
by role and text; repeated rows are turns of their own; ids are whole numbers; an empty table has no nodes, not even a root;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentlake.llm.text import written
from latentlake.operators.ordered import numbered
from latentlake.plans.runtime import join_groups, tasks

IDS = 4_096  # ids in a string
NOTHING = hashlib.sha256(b"").hexdigest()


# --- sequences ---------------------------------------------------------------------------------------------------------

def steps_of(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, at, symbol, chars): turns by number from 0; equal symbols are equal roles and texts."""
    said = [F.coalesce(F.col(k), F.lit("")) for k in (role, text)]
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("o0"), said[0].alias("o1"), said[1].alias("o2"))
    rows = rows.select("*", F.sha2(F.concat(F.octet_length("o1").cast("string"), F.lit(":"), "o1", "o2"), 256).alias("symbol"))
    return numbered(rows, ["c"], ["o0", "o1", "o2"]).select("c", (F.col("rn") - 1).alias("at"), "symbol", F.length("o2").cast("long").alias("chars"))


def lengths_of(steps: DataFrame) -> DataFrame:
    """(c, n) of all conversations that have steps."""
    return steps.groupBy("c").agg(F.count(F.lit(1)).alias("n"))


def shared_starts(steps: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(steps, lengths) after each conversation's first h steps are replaced by those of the first of its ``every`` ids.

    h is crc32 of the id modulo ``most``. The leader's first steps travel to its followers as one array of under ``most``.
    """
    leads = steps.where((F.col("c") % every == 0) & (F.col("at") < most - 1)).groupBy("c").agg(
        F.sort_array(F.collect_list(F.struct("at", "symbol", "chars"))).alias("lead")).withColumnRenamed("c", "leader")
    convs = lengths_of(steps).withColumns({"h": F.crc32(F.col("c").cast("string")) % most, "leader": F.col("c") - F.col("c") % every})
    convs = convs.join(leads, "leader", "left").withColumn("lead", F.filter(F.coalesce("lead", F.array()), lambda s: s["at"] < F.col("h")))
    convs = written(convs.select("c", "n", "h", "lead", F.size("lead").cast("long").alias("m")), "leads")
    led = convs.select("c", F.explode("lead").alias("s")).select("c", "s.at", "s.symbol", "s.chars")
    own = join_groups(steps, convs.select("c", "h", "m"), "c", row_bytes=32).where("at >= h").withColumn("at", F.col("at") - F.col("h") + F.col("m"))
    return led.unionByName(own.select(*led.columns)), convs.select("c", (F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("n"))


# --- names -------------------------------------------------------------------------------------------------------------

def _half(column: str):
    return F.floor(F.col(column) / 2)


def paired(blocks: DataFrame) -> DataFrame:
    """(c, i, l, more, b) from blocks (c, i, b) of half the length: the left half's digest, whether there is a right half,
    and the digest of both, null where the sequence ends within."""
    odd = F.col("i") % 2 == 1
    both = blocks.groupBy("c", _half("i").alias("i")).agg(
        F.max(F.when(~odd, F.col("b"))).alias("l"), F.max(F.when(odd, F.col("b"))).alias("r"), F.max(odd).alias("more"))
    return both.select("c", "i", "l", "more", F.when(F.col("more"), F.sha2(F.concat("l", "r"), 256)).alias("b"))


def prefixes(steps: DataFrame, lengths: DataFrame, rounds: int) -> DataFrame:
    """(c, at, name): the names of the first ``at`` steps of every sequence, at from 0 to its length."""
    none = F.lit(None).cast("string")
    blocks = steps.select("c", F.col("at").alias("i"), F.col("symbol").alias("b")).unionByName(lengths.select("c", F.col("n").alias("i"), none.alias("b")))
    levels = []
    for _ in range(rounds):
        levels.append(written(paired(blocks), "halves"))
        blocks = levels[-1]
    names = lengths.select("c", F.lit(0).cast("long").alias("i"), F.lit("").alias("name"))
    for level in reversed(levels):
        cut = names.join(level.drop("b"), ["c", "i"])
        upper = F.struct((F.col("i") * 2).alias("i"), F.col("name"))
        lower = F.struct((F.col("i") * 2 + 1).alias("i"), F.sha2(F.concat("name", "l"), 256).alias("name"))
        names = written(cut.select("c", F.explode(F.when(F.col("more"), F.array(upper, lower)).otherwise(F.array(upper))).alias("t")).select("c", "t.*"), "names")
    return names.withColumnRenamed("i", "at")


# --- nodes -------------------------------------------------------------------------------------------------------------

def grafted(nodes: DataFrame, names: DataFrame, rounds: int, totals: list[str]) -> DataFrame:
    """nodes (at, name, conv_id, totals...) with their totals summed over subtrees."""
    for j in range(1, rounds + 1):
        height = 2**j
        within = F.col("at") % height
        tree = F.floor(F.col("at") / height).alias("i")
        roots = nodes.where(within == height // 2).select(F.col("conv_id").alias("c"), tree, *totals)
        upper = names.where(within < height // 2).select("c", tree, "at", "name")
        more = upper.join(roots, ["c", "i"]).groupBy("at", "name").agg(*[F.sum(t).alias(f"_{t}") for t in totals])
        both = nodes.join(more, ["at", "name"], "left")
        nodes = written(both.withColumns({t: F.col(t) + F.coalesce(f"_{t}", F.lit(0)) for t in totals}).drop(*[f"_{t}" for t in totals]), "totals")
    return nodes


def ends_digest(ends: DataFrame) -> DataFrame:
    """(at, name, ends_sha256): the digest of the ids at every node that has any, in order, joined by commas."""
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids = None, 0, []

        def out():
            return pa.RecordBatch.from_pydict({"at": [key[0]], "name": [key[1]], "first": [first], "ids": [",".join(map(str, ids))]})

        for batch in batches:
            for at, name, c in zip(*(batch.column(k).to_pylist() for k in ("at", "name", "c"))):
                if (at, name) != key or len(ids) == IDS:
                    if ids:
                        yield out()
                    key, first, ids = (at, name), c, []
                ids.append(c)
        if ids:
            yield out()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for at, name, ids in zip(*(batch.column(k).to_pylist() for k in ("at", "name", "ids"))):
                if (at, name) == key:
                    state.update(b",")
                else:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (at, name), hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_pydict({k: [d[i] for d in done] for i, k in enumerate(("at", "name", "ends_sha256"))},
                                             schema=pa.schema([("at", pa.int64()), ("name", pa.string()), ("ends_sha256", pa.string())]))
        if key:
            yield pa.RecordBatch.from_pydict({"at": [key[0]], "name": [key[1]], "ends_sha256": [state.hexdigest()]})

    n = tasks(ends.sparkSession)
    strings = ends.repartitionByRange(n, "at", "name", "c").sortWithinPartitions("at", "name", "c").mapInArrow(joined, "at long, name string, first long, ids string")
    return strings.repartition(n, "at", "name").sortWithinPartitions("at", "name", "first").mapInArrow(hashed, "at long, name string, ends_sha256 string")


def prefix_trie(steps: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences: steps (c, at, symbol, chars) and the length (c, n) of each, 0 included.

    Per node: conv_id (its smallest member), depth, parent_conv_id, n_convs (members: sequences that start with it), n_children,
    n_leaves, saved_tokens (characters of its subtree's steps that are there more than once), ends_sha256.
    """
    steps, lengths = written(steps, "steps"), written(lengths, "lengths")
    rounds = (lengths.agg(F.max("n")).first()[0] or 0).bit_length()
    names = prefixes(steps, lengths, rounds)
    nodes = written(names.groupBy("at", "name").agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")), "nodes")
    before = names.select(F.col("c").alias("conv_id"), (F.col("at") + 1).alias("at"), F.col("name").alias("parent"))
    last = steps.select(F.col("c").alias("conv_id"), (F.col("at") + 1).alias("at"), "chars")
    nodes = written(nodes.join(before, ["conv_id", "at"], "left").join(last, ["conv_id", "at"], "left"), "nodes")
    children = nodes.where("at > 0").groupBy((F.col("at") - 1).alias("at"), F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["at", "name"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.coalesce("chars", F.lit(0).cast("long"))})
    nodes = grafted(written(nodes.drop("chars"), "nodes"), names, rounds, ["n_leaves", "saved_tokens"])
    ends = ends_digest(names.join(lengths.select("c", F.col("n").alias("at")), ["c", "at"]))
    above = nodes.select((F.col("at") + 1).alias("at"), F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(ends, ["at", "name"], "left").join(above, ["at", "parent"], "left")
    return out.select("conv_id", F.col("at").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
