"""Exact work on pairs of rows, cut into tasks of bounded size.

Three steps, each linear in what leaves a task:

1. ``collapse_copies`` turns equal vectors into one row with a count, so a group of copies costs one row.
2. ``metric_cells`` assigns every vector to its nearest pivot and, for a search radius, to each further cell that can
   hold a partner within the radius. Vectors that provably cannot meet are never compared.
3. ``pair_tasks`` splits the rows of a cell into blocks of at most ``block_rows`` and sends each block to the block pairs
   it takes part in. A cell that holds a third of all rows becomes many tasks, not one.

Kernels then return only results (matching pairs, forest edges, partial sums), never the pairs themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latentlake.operators.kernels import ints, matrix, pairwise, pieces
from latentlake.operators.ordered import top_rows
from latentlake.operators.sketch import Index
from latentlake.plans.runtime import join_groups, materialize

BLOCK_ROWS = 1024
CELL_ROWS = 16_384
MAX_PIVOTS = 4096
SLACK = 1e-9


def collapse_copies(df: DataFrame, vec_id: str, x: str, by: list[str] | None = None) -> DataFrame:
    """One row per distinct vector (within ``by``): representative = smallest id, n = number of copies."""
    return df.groupBy(*(by or []), x).agg(F.min(vec_id).alias(vec_id), F.count(F.lit(1)).alias("n"))


def first_members(df: DataFrame, vec_id: str, x: str, keep: int) -> DataFrame:
    """Per distinct vector: representative and its ``keep`` smallest ids (bounded before the shuffle)."""
    return top_rows(df, [x], [F.col(vec_id)], keep).groupBy(x).agg(
        F.min(vec_id).alias(vec_id), F.sort_array(F.collect_list(vec_id)).alias("ids"))


def choose_pivots(df: DataFrame, vec_id: str, x: str, cell_rows: int = CELL_ROWS) -> tuple[list[int], np.ndarray]:
    """A deterministic spread of at most MAX_PIVOTS rows to build cells around: their ids and vectors."""
    want = max(1, min(MAX_PIVOTS, math.ceil(df.count() / cell_rows)))
    rows = df.orderBy(F.xxhash64(vec_id), vec_id).limit(want).select(vec_id, x).collect()
    return [r[0] for r in rows], np.array([list(r[1]) for r in rows], dtype=np.float64)


def metric_cells(df: DataFrame, x: str, pivots: np.ndarray, radius: float | None, core: bool = False) -> DataFrame:
    """Add ``_cell``, ``_home``, ``_core`` and ``_reach`` (distance to the cell's pivot).

    Each row appears once in its home cell, that of its nearest pivot. With a radius it also visits every later cell
    whose points can lie within the radius: a partner y at home in p has d(x,p) <= d(x,nearest) + 2 radius. Visiting only
    later cells finds each cross-cell pair exactly once.

    With ``core``, a row within half the radius of some pivot belongs to the first such pivot's core instead. Rows of one
    core are all within the radius of each other, so they need no comparing, however many they are; a partner in a core
    has d(x,p) <= 1.5 radius.
    """
    cols = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("_cell", T.LongType()), T.StructField("_home", T.BooleanType()),
                           T.StructField("_core", T.BooleanType()), T.StructField("_reach", T.DoubleType())])

    def assign(batches):
        for b in (piece for batch in batches for piece in pieces(batch, len(pivots))):
            d = pairwise(matrix(b.column(x)), pivots)
            near, home, at = d.min(1), d.argmin(1), np.arange(len(d))
            inner = np.zeros(len(d), bool)
            if core:
                close = d <= radius / 2 - SLACK
                inner = close.any(1)
                home = np.where(inner, close.argmax(1), home)
            rows, cells, is_home = [at], [home], [np.ones(len(d), bool)]
            if radius is not None and len(pivots) > 1:
                reach = near + 2 * radius
                visit = d <= (np.maximum(reach, 1.5 * radius) if core else reach)[:, None] + SLACK
                r, p = np.nonzero(visit & (np.arange(len(pivots))[None, :] > home[:, None]))
                rows.append(r), cells.append(p), is_home.append(np.zeros(len(r), bool))
            r, p, h = np.concatenate(rows), np.concatenate(cells), np.concatenate(is_home)
            for s in range(0, len(r), 4096):
                part = slice(s, s + 4096)
                t = b.take(pa.array(r[part]))
                yield pa.RecordBatch.from_arrays(
                    [*[t.column(c) for c in cols], pa.array(p[part].astype(np.int64)), pa.array(h[part]),
                     pa.array(inner[r[part]] & h[part]), pa.array(d[r[part], p[part]])],
                    names=[*cols, "_cell", "_home", "_core", "_reach"])

    return df.mapInArrow(assign, schema)


def pair_tasks(rows: DataFrame, cell: list[str], vec_id: str, block_rows: int = BLOCK_ROWS,
               within: bool = True) -> DataFrame:
    """Send every row to the block pairs of its cell: adds ``_i``, ``_j`` (the task) and ``_side`` (the row's block).

    Home rows meet each other (unless ``within`` is False), the cell's core rows (if it has a ``_core`` column) and its
    visitors. Core rows and visitors meet, but neither meet their own kind.
    """
    inner = F.coalesce(F.col("_core"), F.lit(False)) if "_core" in rows.columns else F.lit(False)
    size = lambda cond: F.ceil(F.count_if(cond) / block_rows).cast("int")
    counts = rows.groupBy(*cell).agg(size(F.col("_home") & ~inner).alias("_nh"), size(F.col("_home") & inner).alias("_nc"),
                                     size(~F.col("_home")).alias("_nv")).where("_nh + _nc > 0")
    rows = join_groups(rows, counts, cell)
    nh, nc, nv = F.col("_nh"), F.col("_nc"), F.col("_nv")
    spread = lambda n: F.pmod(F.xxhash64(vec_id), F.greatest(n, F.lit(1)))
    side = F.when(~F.col("_home"), nh + nc + spread(nv)).when(inner, nh + spread(nc)).otherwise(spread(nh))
    rows = rows.withColumn("_side", side.cast("int"))
    me = F.col("_side")
    none = F.array().cast("array<struct<i:int,j:int>>")

    def meet(first, n):
        """This row's tasks with the n blocks from ``first`` on; a task is named by the smaller block, then the larger."""
        pair = lambda k: F.struct(F.least(k, me).alias("i"), F.greatest(k, me).alias("j"))
        return F.when(n > 0, F.transform(F.sequence(first, first + n - 1), pair)).otherwise(none)

    zero = F.lit(0)
    todo = (F.when(~F.col("_home"), meet(zero, nh + nc)).when(inner, F.concat(meet(zero, nh), meet(nh + nc, nv)))
            .otherwise(F.concat(meet(zero, nh) if within else none, meet(nh, nc + nv))))
    return rows.withColumn("_t", F.explode(todo)).select(
        *[c for c in rows.columns if c not in ("_nh", "_nc", "_nv")], F.col("_t.i").alias("_i"), F.col("_t.j").alias("_j"))


def on_pairs(tasked: DataFrame, cell: list[str], kernel, schema: str, parts: int | None = None) -> DataFrame:
    """Run ``kernel(left, right, same)`` on every task; left and right are Arrow tables, equal when same is True.

    With ``parts``, tasks are dealt over so many partitions, also if the rows lie by cell already: one cell is many tasks.
    """

    def run(table: pa.Table) -> pa.Table:
        side = ints(table.column("_side"))
        i, j = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
        left = table.filter(pa.array(side == i))
        return kernel(left, left if i == j else table.filter(pa.array(side == j)), i == j)

    keys = [*cell, "_i", "_j"]
    return (tasked if parts is None else tasked.repartition(parts, *keys)).groupBy(*keys).applyInArrow(run, schema)


def similar_pairs(df: DataFrame, vec_id: str, x: str, tau: float, carry: list[str] | None = None,
                  cell_rows: int | None = None, block_rows: int | None = None, dense: float | None = None) -> DataFrame:
    """Exact similarity self-join of distinct vectors: (a, b, d, carry_a.., carry_b..) with a < b and d <= tau.

    Few, large blocks of vectors meet where their cells are within reach, and their tasks return the pairs. With ``dense``,
    results of more pairs per row are counted and then come from blocks around pivots.
    """
    carry = carry or []
    df = materialize(df.select(vec_id, x, *carry))
    index = Index(df, vec_id, x, carry, cell_rows=cell_rows, block_rows=block_rows)
    found = index.within(tau)
    if dense is not None:
        found = materialize(found)
        if found.count() > dense * index.rows:
            return similar_pairs_by_blocks(df, vec_id, x, tau, carry, cell_rows or CELL_ROWS, block_rows or BLOCK_ROWS)
    return found


def similar_pairs_by_blocks(df: DataFrame, vec_id: str, x: str, tau: float, carry: list[str] | None = None,
                  cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The same join for results with many pairs per row: every block of vectors visits the blocks within reach."""
    carry = carry or []
    tasked = radius_tasks(df.select(vec_id, x, *carry), vec_id, x, tau, cell_rows, block_rows)
    types = dict(df.dtypes)
    schema = ", ".join(["a long", "b long", "d double", *[f"{c}_a {types[c]}, {c}_b {types[c]}" for c in carry]])

    def kernel(left, right, same):
        a, b = matrix(left.column(x)), matrix(right.column(x))
        ia, ib = ints(left.column(vec_id)), ints(right.column(vec_id))
        if not len(ia) or not len(ib):
            hit = np.empty(0, int), np.empty(0, int)
        else:
            near = pairwise(a, b) <= tau + SLACK
            hit = np.nonzero(np.triu(near, 1) if same else near)
        d = np.sqrt(((a[hit[0]] - b[hit[1]]) ** 2).sum(1)) if len(hit[0]) else np.empty(0)
        keep = d <= tau
        r, s, d = hit[0][keep], hit[1][keep], d[keep]
        flip = ia[r] > ib[s] if len(r) else np.empty(0, bool)
        cols = {"a": pa.array(np.where(flip, ib[s], ia[r]).astype(np.int64)),
                "b": pa.array(np.where(flip, ia[r], ib[s]).astype(np.int64)), "d": pa.array(d)}
        for c in carry:
            va, vb = ints(left.column(c))[r], ints(right.column(c))[s]
            cols[f"{c}_a"], cols[f"{c}_b"] = pa.array(np.where(flip, vb, va)), pa.array(np.where(flip, va, vb))
        return pa.table(cols)

    return on_pairs(tasked, ["_cell"], kernel, schema)


def radius_tasks(df: DataFrame, vec_id: str, x: str, radius: float, cell_rows: int = CELL_ROWS,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Block pairs that cover every pair within the radius."""
    cells = metric_cells(df, x, choose_pivots(df, vec_id, x, cell_rows)[1], radius)
    return pair_tasks(cells.drop("_reach", "_core"), ["_cell"], vec_id, block_rows)
