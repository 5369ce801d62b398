"""Routes: rank encoding, closed length, best of several orders, self-crossings."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentlake.operators.blocks import BLOCK_ROWS, pair_tasks
from latentlake.operators.kernels import ints
from latentlake.operators.ordered import ROWS_PER_TASK, largest_group, numbered, windows
from latentlake.plans.runtime import join_groups, materialize

TASK_ROWS = 50_000


def encode_ranks(df: DataFrame, route: list[str], order: list[str], limit: int = ROWS_PER_TASK) -> DataFrame:
    """Position of each item in its route, scaled to [0, 1]."""
    sizes = df.groupBy(*route).agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).alias("_last"))
    rows = join_groups(numbered(df, route, order, "_pos", limit), sizes, route)
    return rows.withColumn("rank_value", (F.col("_pos") - 1) / F.col("_last")).drop("_pos", "_last")


def decode_ranks(df: DataFrame, route: list[str], value: str, item: str, limit: int = ROWS_PER_TASK) -> DataFrame:
    """0-based visiting position from the encoded values; ties go to the smaller item."""
    return numbered(df, route, [value, item], "position", limit).withColumn("position", F.col("position") - 1)


def segments(df: DataFrame, route: list[str], order: list[str], px: str, py: str, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Consecutive points of each closed route: (route, idx, n, px, py, qx, qy); the last segment returns to the start."""
    largest = largest_group(df, route)
    rows = numbered(df.select(*route, *order, F.col(px).cast("double").alias("px"), F.col(py).cast("double").alias("py")),
                    route, order, "idx", limit, largest)

    def build(part_rows, part, by):
        return part_rows.withColumn("_next", F.lead(F.struct("px", "py")).over(Window.partitionBy(*part).orderBy(*by)))

    rows = windows(rows, route, ["idx"], build, after=1, limit=limit, largest=largest)
    ends = rows.groupBy(*route).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("px", "py"), "idx").alias("_start"))
    rows = join_groups(rows, ends, route).withColumn("_next", F.coalesce("_next", "_start"))
    return rows.select(*route, (F.col("idx") - 1).alias("idx"), "n", "px", "py", F.col("_next.px").alias("qx"),
                       F.col("_next.py").alias("qy"))


def route_lengths(df: DataFrame, route: list[str], order: list[str], px: str, py: str, limit: int = ROWS_PER_TASK) -> DataFrame:
    length = F.hypot(F.col("qx") - F.col("px"), F.col("qy") - F.col("py"))
    return segments(df, route, order, px, py, limit).groupBy(*route).agg(F.sum(length).alias("length"))


def best_route(lengths: DataFrame, group: list[str], candidate: str, baseline) -> DataFrame:
    """Per group: the shortest candidate and its improvement over the baseline candidate in percent."""
    out = lengths.groupBy(*group).agg(
        F.min(F.struct("length", candidate)).alias("_b"),
        F.max(F.when(F.col(candidate) == baseline, F.col("length"))).alias("baseline"))
    return out.select(*group, F.col(f"_b.{candidate}").alias("best"), F.col("_b.length").alias("length"), "baseline",
                      ((1 - F.col("_b.length") / F.col("baseline")) * 100).alias("improvement_pct"))


def crossings(df: DataFrame, route: list[str], order: list[str], px: str, py: str, limit: int = ROWS_PER_TASK,
              block_rows: int = BLOCK_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """Number of proper self-crossings of each closed route.

    Segments meet only in grid cells both pass through. Cells are about one mean segment wide, so that all segments together
    pass a few times as many cells as there are segments, however long single ones are. A crossing counts in the one cell
    that holds the crossing point. Large cells are cut into blocks; a task takes many cells and compares the segments of
    all of them side by side, each with the one that follows it by 1, 2, .. places. Tasks return counts, never pairs.
    """
    seg = segments(df, route, order, px, py, limit)
    box = seg.groupBy(*route).agg(
        F.min("px").alias("_x0"), F.min("py").alias("_y0"), F.max("px").alias("_x1"), F.max("py").alias("_y1"), F.count(F.lit(1)).alias("_n"),
        F.avg(F.hypot(F.col("qx") - F.col("px"), F.col("qy") - F.col("py"))).alias("_mean"))
    side = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"), F.lit(1e-12))
    box = box.withColumn("_width", side * (1 + 1e-9)).withColumn(
        "_g", F.least(F.col("_n"), F.greatest(F.lit(1), F.floor(F.col("_width") / F.greatest("_mean", F.lit(1e-12))))))
    rows = join_groups(seg, box.select(*route, "_x0", "_y0", "_width", "_g"), route)
    g, size, pad = F.col("_g"), F.col("_width") / F.col("_g"), F.col("_width") * 1e-9

    def cell(v, origin):
        return F.least(g - 1, F.greatest(F.lit(0), F.floor((v - origin) / size)))

    # grid rows a segment passes, then the columns it passes within each of them (a little wide, so rounding loses nothing)
    low, high = F.least("py", "qy"), F.greatest("py", "qy")
    rows = rows.withColumn("_cy", F.explode(F.sequence(cell(low - pad, F.col("_y0")), cell(high + pad, F.col("_y0")))))
    bottom = F.greatest(low, F.col("_y0") + F.col("_cy") * size - pad)
    top = F.least(high, F.col("_y0") + (F.col("_cy") + 1) * size + pad)
    slope = (F.col("qx") - F.col("px")) / (F.col("qy") - F.col("py"))
    steep = F.abs(F.col("qy") - F.col("py")) > pad
    xa = F.when(steep, F.col("px") + (bottom - F.col("py")) * slope).otherwise(F.col("px"))
    xb = F.when(steep, F.col("px") + (top - F.col("py")) * slope).otherwise(F.col("qx"))
    rows = rows.withColumns({"_xa": F.least(xa, xb) - pad, "_xb": F.greatest(xa, xb) + pad})
    rows = rows.withColumn("_cx", F.explode(F.sequence(cell(F.col("_xa"), F.col("_x0")), cell(F.col("_xb"), F.col("_x0")))))
    rows = rows.drop("_xa", "_xb").withColumn("_home", F.lit(True))
    cells = [*route, "_cx", "_cy"]
    types = dict(df.dtypes)
    met = rows.groupBy(*cells).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c").withColumnsRenamed({c: f"_k_{c}" for c in cells})
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(met[f"_k_{c}"]) for c in cells])
    shared = materialize(rows.join(met, same, "left_semi"))  # a segment alone in its cell crosses nothing there
    tasked = pair_tasks(shared, cells, "idx", block_rows)
    parts = max(1, -(-shared.count() // task_rows))
    tasked = tasked.withColumn("_task", F.pmod(F.xxhash64(*cells, "_i", "_j"), F.lit(parts)))

    def count(table: pa.Table) -> pa.Table:
        named = [ints(table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices) for c in route]
        keys = np.stack([*named, *[table.column(c).to_numpy() for c in ("_cx", "_cy", "_i", "_j")]]).astype(np.int64)
        by = np.lexsort(keys)
        keys = keys[:, by]
        unit = np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(0))])  # cell and pair of blocks
        ends = np.searchsorted(unit, unit, side="right")
        own = {c: table.column(c).to_numpy()[by] for c in ("idx", "n", "px", "py", "qx", "qy", "_x0", "_y0", "_width", "_g", "_cx", "_cy", "_i", "_j", "_side")}
        found, at = np.zeros(len(by), np.int64), np.arange(len(by))
        for step in range(1, len(by)):
            at = at[at + step < ends[at]]
            if not len(at):
                break
            found[at] += _cross(own, at, at + step)
        first = np.flatnonzero(np.concatenate([[True], (keys[:len(route), 1:] != keys[:len(route), :-1]).any(0)])) if route else np.zeros(1, np.int64)
        heads = table.take(pa.array(by[first]))
        return pa.table({**{r: heads.column(r) for r in route}, "n": pa.array(np.add.reduceat(found, first))})

    schema = ", ".join([*[f"{r} {types[r]}" for r in route], "n long"])
    counted = tasked.groupBy("_task").applyInArrow(count, schema)
    every = box.select(*route).withColumn("n", F.lit(0).cast("long"))
    return counted.unionByName(every).groupBy(*route).agg(F.sum("n").alias("crossings"))


def _cross(s: dict, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the segments at places p and q of one cell cross there."""
    swap = s["idx"][p] > s["idx"][q]  # the same segment always supplies the point, so all cells agree on where it lies
    p, q = np.where(swap, q, p), np.where(swap, p, q)
    ok = (s["idx"][q] >= s["idx"][p] + 2) & ~((s["idx"][p] == 0) & (s["idx"][q] == s["n"][p] - 1))
    ok &= (s["_i"][p] == s["_j"][p]) | (s["_side"][p] != s["_side"][q])
    ax, ay, bx, by = (s[e][k] - s[f][k] for k in (p, q) for e, f in (("qx", "px"), ("qy", "py")))
    dx, dy = s["px"][q] - s["px"][p], s["py"][q] - s["py"][p]
    cross = ax * by - ay * bx
    ok &= np.abs(cross) >= 1e-10
    safe = np.where(ok, cross, 1.0)
    t, u = (dx * by - dy * bx) / safe, (dx * ay - dy * ax) / safe
    ok &= (t > 0) & (t < 1) & (u > 0) & (u < 1)
    size, last = s["_width"][p] / s["_g"][p], s["_g"][p] - 1
    for at, origin, c in ((s["px"][p] + t * ax, "_x0", "_cx"), (s["py"][p] + t * ay, "_y0", "_cy")):
        ok &= np.clip(np.floor((at - s[origin][p]) / size), 0, last) == s[c][p]
    return ok
