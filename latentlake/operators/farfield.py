"""Isolation scores without comparing all pairs, each within a stated share of the exact one.

Rows of a group are gathered in cells around pivots. Of a cell that is far from a row, its size, mean and spread tell the
row's summed coupling from both sides: with u the squared distances, their mean is known exactly and 1/u is convex, so the
sum lies between that of equal distances and that of the two extreme ones. Only where the two differ by more than the
allowed error are the cell's rows compared one by one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentlake.functions.vec import EPS, l2, mean_vector
from latentlake.operators.blocks import BLOCK_ROWS, choose_pivots, collapse_copies, metric_cells, on_pairs, pair_tasks
from latentlake.operators.kernels import ints, matrix, pairwise
from latentlake.plans.runtime import join_groups, materialize

SEEN = 500_000   # pairs of a row and a cell looked at together
FAR_ROWS = 4096  # rows that meet the cells of their group in one task


def isolation_within(df: DataFrame, group: str, vec_id: str, x: str, error: float = 0.05, coupling: float = 1.0,
                     cell_rows: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``pairs.isolation`` with a relative error of at most ``error``: adds ``isolation`` and ``off``, the row's own bound.

    error 0 compares every pair. Rows of a null group belong together; copies of a vector enter once, with their count.
    A group of one row has the score of its power over EPS, as in the exact form.
    """
    if not 0 <= error < 1:
        raise ValueError("error must be in [0, 1)")
    base = materialize(df)
    reps = materialize(collapse_copies(base.select(group, vec_id, x), vec_id, x, [group]))
    rows = reps.count()
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    if not rows:
        return base.withColumns({"isolation": power, "off": F.lit(0.0)})
    pivots = choose_pivots(reps, vec_id, x, cell_rows or max(64, math.isqrt(rows)))[1]
    homes = materialize(metric_cells(reps, x, pivots, None).drop("_core", "_reach"))
    cells = _cells(homes, group, x)
    seen = materialize(_seen(homes, cells, group, vec_id, x, error, coupling))
    visits = homes.drop("_cell", "_home").join(seen.select(F.col(vec_id).alias("_v"), F.explode("near").alias("_cell")), F.col(vec_id) == F.col("_v"))
    met = materialize(homes.unionByName(visits.drop("_v").withColumn("_home", F.lit(False))))  # read twice
    near = _near(met, group, vec_id, x, coupling, block_rows)
    own = (F.col("n") - 1) * (coupling / EPS) ** 2
    total = reps.select(group, x, vec_id, "n").join(seen.drop("near"), vec_id).join(near, vec_id, "left").withColumn(
        "_sure", F.coalesce("loss", F.lit(0.0)) + own)
    low, high = F.col("_sure") + F.col("low"), F.col("_sure") + F.col("high")
    # the mean of the score's two extremes, and how far from it the score can be
    total = total.select(F.col(group).alias("_g"), F.col(x).alias("_x"), F.greatest(low, F.lit(EPS)).alias("_low"), F.greatest(high, F.lit(EPS)).alias("_high"))
    out = base.join(total, base[group].eqNullSafe(total["_g"]) & (base[x] == total["_x"]))
    return out.withColumns({"isolation": power * (1 / F.col("_low") + 1 / F.col("_high")) / 2,
                            "off": (F.col("_high") / F.col("_low") - 1) / 2}).drop("_g", "_x", "_low", "_high")


def _cells(homes: DataFrame, group: str, x: str) -> DataFrame:
    """Per group and cell: rows with copies, mean, mean squared and largest distance from it."""
    key = [group, "_cell"]
    mean = homes.groupBy(*key).agg(mean_vector(x, F.col("n").cast("double")).alias("_m"))
    far = join_groups(homes, mean, key, row_bytes=8 * 1024).withColumn("_r", l2(x, "_m"))
    return far.groupBy(*key).agg(F.sum("n").alias("size"), F.first("_m").alias("mean"), F.max("_r").alias("reach"),
                                 (F.sum(F.col("n") * F.col("_r") * F.col("_r")) / F.sum("n")).alias("spread"))


def _seen(homes: DataFrame, cells: DataFrame, group: str, vec_id: str, x: str, error: float, coupling: float) -> DataFrame:
    """Per row: the bounds of its summed squared coupling to all cells that are far enough, and the other cells that are
    not its own. A task holds a slice of a group's rows and the group's cells, of which there are at most as many as pivots."""
    counted = homes.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / FAR_ROWS).cast("int").alias("_k"))
    sliced = join_groups(homes.select(group, vec_id, F.col(x).cast("array<double>").alias("_x"), "_cell"), counted, group)
    sliced = sliced.withColumn("_s", F.pmod(F.xxhash64(vec_id), F.col("_k")).cast("int")).drop("_k")
    spread = join_groups(cells, counted, group).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).drop("_k")

    def bounds(left: pa.Table, right: pa.Table) -> pa.Table:
        step = max(1, SEEN // max(1, right.num_rows))
        return pa.concat_tables(some(left.slice(s, step), right) for s in range(0, left.num_rows or 1, step))

    def some(left: pa.Table, right: pa.Table) -> pa.Table:
        """The bounds of so many rows that a matrix of rows and cells is small."""
        ids, own, cell = ints(left.column(vec_id)), ints(left.column("_cell")), ints(right.column("_cell"))
        d = pairwise(matrix(left.column("_x")), matrix(right.column("mean")))
        reach, n = ints(right.column("reach"))[None, :], ints(right.column("size"))[None, :].astype(float)
        mean = d * d + ints(right.column("spread"))[None, :]
        nearest, farthest = (np.maximum(d - reach, 0.0) * (1 - 1e-9)) ** 2, ((d + reach) * (1 + 1e-9)) ** 2
        with np.errstate(divide="ignore", invalid="ignore"):
            low = n / mean
            high = np.maximum(n * (nearest + farthest - mean) / (nearest * farthest), low)
            far = (nearest > 0) & (high <= low * (1 + 2 * error)) & (own[:, None] != cell[None, :]) & (error > 0)
        near = ~far & (own[:, None] != cell[None, :])
        ends = np.concatenate([[0], np.cumsum(near.sum(1))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(cell[np.nonzero(near)[1]].astype(np.int64)))
        square = coupling ** 2
        return pa.table({vec_id: pa.array(ids.astype(np.int64)), "low": pa.array(square * np.where(far, low, 0.0).sum(1)),
                         "high": pa.array(square * np.where(far, high, 0.0).sum(1)), "near": lists})

    def sided(side: DataFrame, name: str):  # names of its own on each side; a null group is a key of its own
        key = F.struct(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g"), F.col(group).isNull().alias("none"), F.col("_s").alias("s"))
        kept = [c for c in side.columns if c not in (group, "_s")]
        return side.select(key.alias(name), *[F.col(c).alias(c) for c in kept]).groupBy(name)

    return sided(sliced, "_left").cogroup(sided(spread, "_right")).applyInArrow(
        lambda a, b: bounds(a, b), f"{vec_id} long, low double, high double, near array<long>")


def _near(rows: DataFrame, group: str, vec_id: str, x: str, coupling: float, block_rows: int) -> DataFrame:
    """Summed squared coupling to the rows of the own cell and of those visited, from block pairs."""

    def sums(left, right, same):
        ia, ib = ints(left.column(vec_id)), ints(right.column(vec_id))
        if not len(ia) or not len(ib):
            return pa.table({vec_id: pa.array([], pa.int64()), "loss": pa.array([], pa.float64())})
        na, nb = ints(left.column("n")), ints(right.column("n"))
        c = (coupling / (pairwise(matrix(left.column(x)), matrix(right.column(x))) + EPS)) ** 2
        if same:
            np.fill_diagonal(c, 0.0)
            ids, loss = ia, c @ nb
        elif right.column("_home")[0].as_py():
            ids, loss = np.concatenate([ia, ib]), np.concatenate([c @ nb, c.T @ na])
        else:  # visitors take from the rows at home and give nothing
            ids, loss = ib, c.T @ na
        return pa.table({vec_id: pa.array(ids.astype(np.int64)), "loss": pa.array(loss)})

    key = [group, "_cell"]
    return on_pairs(pair_tasks(rows, key, vec_id, block_rows), key, sums, f"{vec_id} long, loss double").groupBy(vec_id).agg(F.sum("loss").alias("loss"))
