"""Pair work on candidates: nearest-neighbour graph, opposite phases, merging of near-duplicates, isolation."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentlake.functions.vec import EPS, dot, doubles, let, mean_vector, norm, scale, sub
from latentlake.operators.blocks import BLOCK_ROWS, collapse_copies, first_members, on_pairs, pair_tasks
from latentlake.operators.graph import components
from latentlake.operators.kernels import direct, exact_at, ints, matrix, pairwise, spanning_forest
from latentlake.operators.ordered import ROWS_PER_TASK, numbered, running, top_rows
from latentlake.operators.sketch import Index
from latentlake.plans.runtime import join_groups, materialize

# --- nearest neighbours ---------------------------------------------------------------------------------------------


def nearest_neighbours(df: DataFrame, vec_id: str, x: str, k: int = 12, cell_rows: int | None = None,
                       block_rows: int | None = None) -> DataFrame:
    """Exact k nearest neighbours of every row, without itself: (a, b, d), ties to the smaller id.

    Blocks of vectors meet (``operators/sketch.py``): first in a vector's own cell, whose k-th distance limits the search,
    then in the cells that can still hold something closer. Copies of a vector are searched for once.
    """
    reps = materialize(first_members(df.select(vec_id, x), vec_id, x, k + 1))
    n = df.count()
    k = min(k, n - 1)
    if k < 1:
        return df.sparkSession.createDataFrame([], "a long, b long, d double")
    near = Index(reps.select(vec_id, x), vec_id, x, cell_rows=cell_rows, block_rows=block_rows).nearest(k)
    if reps.count() == n:
        return near
    return _with_copies(df, reps, near, vec_id, x, k)


def _with_copies(df: DataFrame, reps: DataFrame, near: DataFrame, vec_id: str, x: str, k: int) -> DataFrame:
    """Neighbours of every member from those of its representative; each list holds at most k + 1 entries."""
    ids = reps.select(F.col(vec_id).alias("_rep"), F.explode("ids").alias("b"))
    others = near.withColumnRenamed("b", "_rep").join(ids, "_rep").select("a", "b", "d")
    own = ids.select(F.col("_rep").alias("a"), "b", F.lit(0.0).alias("d"))
    lists = top_rows(others.unionByName(own), ["a"], [F.col("d"), F.col("b")], k + 1).groupBy("a").agg(
        F.sort_array(F.collect_list(F.struct("d", "b"))).alias("l"))
    member = df.select(F.col(vec_id).alias("_id"), x).join(reps.select(x, F.col(vec_id).alias("a")), x).select("_id", "a")
    out = member.join(lists, "a").withColumn("l", F.slice(F.filter("l", lambda e: e["b"] != F.col("_id")), 1, k))
    return out.select("_id", F.inline("l")).select(F.col("_id").alias("a"), "b", "d")


def neighbour_graph(df: DataFrame, vec_id: str, x: str, k: int = 12, **kw) -> DataFrame:
    """Undirected neighbour graph as directed edges both ways: (a, b, d)."""
    return both_ways(nearest_neighbours(df, vec_id, x, k, **kw))


def both_ways(near: DataFrame) -> DataFrame:
    back = near.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")
    return near.unionByName(back).groupBy("a", "b").agg(F.min("d").alias("d"))


def local_density(near: DataFrame) -> DataFrame:
    """Inverse mean neighbour distance per row."""
    mean = F.avg("d")
    return near.groupBy("a").agg(mean.alias("mean_distance")).withColumn(
        "density", F.when(F.col("mean_distance") > EPS, 1.0 / F.col("mean_distance")).otherwise(F.lit(1.0)))


def concentration(density: DataFrame) -> DataFrame:
    return density.agg((F.max("density") / F.greatest(F.avg("density"), F.lit(EPS))).alias("concentration"))


# --- amplitudes, phases and their interference ----------------------------------------------------------------------


def amplitudes(df: DataFrame, group: str, x: str, q: str, w: str, sensitivity: float = 2.0) -> DataFrame:
    """Add d (distance to the target), phase, re, im.

    The magnitude is the root of the weight; the phase is the cosine of the row's offset to the group's mean offset.
    """
    rows = df.withColumn("_o", sub(x, q))
    mean = rows.groupBy(group).agg(mean_vector("_o").alias("_m"))
    first = F.transform(F.col("_m"), lambda v, i: F.when(i == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    unit = let(norm("_m"), lambda n: F.when(n > EPS, scale("_m", 1.0 / n)).otherwise(first))
    rows = join_groups(rows, mean.select(group, unit.alias("_u")), group, row_bytes=8 * 1024)
    rows = rows.withColumn("d", norm("_o"))
    rows = rows.withColumn("phase", sensitivity * dot("_o", "_u") / F.greatest(F.col("d"), F.lit(EPS)))
    size = F.sqrt(F.greatest(F.col(w), F.lit(0.0)))
    return rows.withColumns({"re": size * F.cos("phase"), "im": size * F.sin("phase")}).drop("_o", "_u")


def magnitude():
    return F.hypot(F.col("re"), F.col("im"))


def opposite_partners(df: DataFrame, group: str, vec_id: str, width: float = 0.5, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Per row: how many rows of its group have the opposite phase (within ``width``) and the sum of their amplitudes.

    Partners fill two phase intervals, so their sums are differences of running sums over the sorted phases: the cost
    is that of a sort, however many pairs there are.
    """
    angle = F.atan2("im", "re")
    rows = df.select(group, vec_id, angle.alias("_a"), "re", "im")
    ends = F.array(*[F.struct((F.col("_a") + shift * math.pi + side * width).alias("v"), F.lit(kind).alias("kind"),
                              F.lit(sign).alias("sign"))
                     for shift in (1, -1) for side, kind, sign in ((-1, 2, -1.0), (1, 0, 1.0))])
    # at equal phase: an upper end (kind 0) comes before the point (1), a lower end (2) after it, so both ends are open
    asks = rows.select(group, vec_id, F.inline(ends)).select(
        group, vec_id, "v", "kind", "sign", F.lit(0.0).alias("re"), F.lit(0.0).alias("im"), F.lit(0).alias("one"))
    points = rows.select(group, vec_id, F.col("_a").alias("v"), F.lit(1).alias("kind"), F.lit(0.0).alias("sign"), "re", "im",
                         F.lit(1).alias("one"))
    line = running(points.unionByName(asks), [group], ["v", "kind", vec_id],
                   {"c": ("sum", "one"), "sre": ("sum", "re"), "sim": ("sum", "im")}, limit)
    return line.where("kind <> 1").groupBy(group, vec_id).agg(
        F.sum(F.col("sign") * F.col("c")).cast("long").alias("n_partners"), F.sum(F.col("sign") * F.col("sre")).alias("partner_re"),
        F.sum(F.col("sign") * F.col("sim")).alias("partner_im"))


def subtract_partners(df: DataFrame, group: str, vec_id: str, threshold: float = 0.1, width: float = 0.5,
                      limit: int = ROWS_PER_TASK) -> DataFrame:
    """Take the partners' summed amplitude away from each row; rows with partners that end below the threshold become 0."""
    out = df.join(opposite_partners(df, group, vec_id, width, limit), [group, vec_id], "left")
    has = F.coalesce(F.col("n_partners"), F.lit(0)) > 0
    out = out.withColumns({"re": F.when(has, F.col("re") - F.col("partner_re")).otherwise(F.col("re")),
                           "im": F.when(has, F.col("im") - F.col("partner_im")).otherwise(F.col("im"))})
    gone = has & (magnitude() < threshold)
    return out.withColumns({"re": F.when(gone, F.lit(0.0)).otherwise(F.col("re")),
                            "im": F.when(gone, F.lit(0.0)).otherwise(F.col("im"))}).drop("partner_re", "partner_im")


def decay(df: DataFrame, group: str, d: str = "d", rate: float = 0.3) -> DataFrame:
    """Damp amplitudes by distance relative to the group's farthest row."""
    far = df.groupBy(group).agg(F.max(d).alias("_far"))
    k = F.exp(-rate * F.col(d) / (F.col("_far") + EPS))
    return join_groups(df, far, group).withColumns({"re": F.col("re") * k, "im": F.col("im") * k}).drop("_far")


def alive(df: DataFrame, threshold: float = 0.1) -> DataFrame:
    return df.where(magnitude() > threshold)


RUN_ROWS = 16_384  # linked rows that one task merges
ABREAST = 256      # later rows that a row is compared with at a time
ROWS = [("id", pa.int64()), ("_re", pa.float64()), ("_im", pa.float64()), ("merged", pa.int64())]


@dataclass
class Rows:
    """Rows by id: vectors, distances to the target, amplitudes, and how many rows each stands for; 0 if it has gone."""

    ids: np.ndarray
    x: np.ndarray
    e: np.ndarray
    re: np.ndarray
    im: np.ndarray
    merged: np.ndarray

    @classmethod
    def of(cls, t: pa.Table) -> Rows:
        return cls(ints(t.column("id")), matrix(t.column("x")), *[t.column(c).to_numpy().copy() for c in ("e", "re", "im", "merged")])

    def left(self) -> pa.Table:
        stay = self.merged > 0
        return pa.table([pa.array(c[stay]) for c in (self.ids, self.re, self.im, self.merged)], schema=pa.schema(ROWS))

    def power(self, i: int) -> float:
        return self.re[i] * self.re[i] + self.im[i] * self.im[i]

    def take(self, i: int, other: Rows, j: int):
        self.re[i] -= other.re[j]
        self.im[i] -= other.im[j]
        self.merged[i] += other.merged[j]
        other.merged[j] = 0


def absorb(a: Rows, b: Rows, same: bool, tau: float, reach: float):
    """All linked pairs of a row of a and a later one of b, in order."""
    for i in range(len(a.ids)):
        if not a.merged[i]:
            continue
        later = np.flatnonzero((np.abs(b.e - a.e[i]) < tau) & (b.merged > 0))
        later = later[later > i] if same else later
        for s in range(0, len(later), ABREAST):
            some = later[s:s + ABREAST]
            for j in some[direct(b.x[some], a.x[i]) < reach].tolist():
                if a.power(i) >= b.power(j):
                    a.take(i, b, j)
                else:
                    b.take(j, a, i)
                    break
            if not a.merged[i]:
                break


def merge_near(df: DataFrame, group: str, vec_id: str, x: str, d: str = "d", tau: float = 0.05, reach: float | None = None,
               block_rows: int = BLOCK_ROWS, run_rows: int = RUN_ROWS, in_order: bool = True) -> DataFrame:
    """Merge rows of a group that have nearly the same distance to the target and lie close to each other.

    Linked pairs have their turn in the order of their ids, first by the smaller one. If both rows are still there, the
    weaker one goes (the later on ties) and its amplitude is taken from that of the stronger, which goes on with what is
    left. ``merged`` counts the rows that have ended in a row, itself included.

    With ``in_order`` False, rows linked directly or through others form one cluster instead; the strongest row stays
    (smallest id on ties) and gives up the amplitude of all others, so that the order of rows plays no part.
    """
    base = materialize(df)
    if reach is None:
        some = base.select(F.size(x)).first()
        reach = tau * some[0] if some else 0.0
    found = _linked(base, group, vec_id, x, d, tau, reach, block_rows)
    if in_order:
        left = _merged_in_order(base.join(found.withColumnRenamed("node", vec_id), vec_id), vec_id, x, d, tau, reach, run_rows)
        tagged = base.join(found.withColumnRenamed("node", vec_id), vec_id, "left").join(left.withColumnRenamed("id", vec_id), vec_id, "left")
        kept = tagged.where("component IS NULL OR merged IS NOT NULL").withColumn("merged", F.coalesce("merged", F.lit(1).cast("long")))
        return kept.withColumns({"re": F.coalesce("_re", "re"), "im": F.coalesce("_im", "im")}).drop("_re", "_im", "component")
    tagged = base.join(found.withColumnRenamed("node", vec_id), vec_id, "left").withColumn(
        "cluster", F.coalesce("component", vec_id)).drop("component")
    best = tagged.groupBy("cluster").agg(
        F.max(F.struct(magnitude().alias("m"), (-F.col(vec_id)).alias("k"))).alias("_b"), F.count(F.lit(1)).alias("merged"),
        F.sum("re").alias("_re"), F.sum("im").alias("_im"))
    best = best.select((-F.col("_b.k")).alias(vec_id), "merged", "_re", "_im")
    kept = tagged.drop("cluster").join(best, vec_id)
    return kept.withColumns({"re": 2 * F.col("re") - F.col("_re"), "im": 2 * F.col("im") - F.col("_im")}).drop("_re", "_im")


def _linked(base: DataFrame, group: str, vec_id: str, x: str, d: str, tau: float, reach: float, block_rows: int) -> DataFrame:
    """(node, component) of the rows that are linked to any other. Copies are linked without comparing; tasks return at most one link per row."""
    band = F.floor(F.col("_d") / tau)
    slim = base.select(group, vec_id, doubles(x).alias("_x"), F.col(d).alias("_d"))
    reps = materialize(slim.groupBy(group, "_x", "_d").agg(F.min(vec_id).alias(vec_id)))
    stars = slim.select(group, "_x", "_d", F.col(vec_id).alias("a")).join(
        reps.select(group, "_x", "_d", F.col(vec_id).alias("b")), [group, "_x", "_d"]).where("a <> b").select("a", "b")
    slim = reps.select(group, vec_id, "_x", "_d")
    rows = slim.withColumn("_band", band).withColumn("_home", F.lit(True))
    rows = rows.unionByName(slim.withColumn("_band", band + 1).withColumn("_home", F.lit(False)))

    def links(left, right, same):
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        ids = np.concatenate([ints(left.column(vec_id)), *([] if same else [ints(right.column(vec_id))])])
        e = np.concatenate([ints(left.column("_d")), *([] if same else [ints(right.column("_d"))])])
        m = np.vstack([matrix(left.column("_x")), *([] if same else [matrix(right.column("_x"))])])
        dist = exact_at(pairwise(m, m), m, m, reach)
        linked = (np.abs(e[:, None] - e[None, :]) < tau) & (dist < reach)
        np.fill_diagonal(linked, False)
        f, t, _ = spanning_forest(np.where(linked, dist, np.inf))
        return pa.table({"a": pa.array(ids[f].astype(np.int64)), "b": pa.array(ids[t].astype(np.int64))})

    cell = [group, "_band"]
    edges = on_pairs(pair_tasks(rows, cell, vec_id, block_rows), cell, links, "a long, b long")
    return materialize(components(edges.unionByName(stars), "a", "b"))


def _merged_in_order(linked: DataFrame, vec_id: str, x: str, d: str, tau: float, reach: float, run_rows: int) -> DataFrame:
    """(id, _re, _im, merged) of the rows that stay, of rows with their ``component`` of links.

    Components don't touch each other; one of up to ``run_rows`` rows is run in one task. A larger one is cut into blocks of ids.
    Block i meets block j after (i - 1, j) and (i, j - 1), which gives every row its pairs in the same order; so all
    (i, j) of one sum are independent tasks of one round, and a task holds two blocks.
    """
    rows = linked.select("component", F.col(vec_id).cast("long").alias("id"), doubles(x).alias("x"), F.col(d).alias("e"), "re", "im")
    cut = numbered(rows, ["component"], ["id"], "_rn").withColumn("_block", F.floor((F.col("_rn") - 1) / run_rows)).drop("_rn")
    fixed = materialize(cut)
    sizes = fixed.groupBy("component").agg((F.max("_block") + 1).alias("_blocks"))
    fixed = materialize(join_groups(fixed, sizes, "component"))
    schema, one = "id long, _re double, _im double, merged long", F.lit(1).cast("long").alias("merged")

    def sorted_by_id(t: pa.Table):
        return t.take(pa.array(np.argsort(ints(t.column("id")), kind="stable")))

    def whole(t: pa.Table) -> pa.Table:
        t = sorted_by_id(t)
        part, out = ints(t.column("component")), [pa.schema(ROWS).empty_table()]
        order = np.argsort(part, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            a = Rows.of(t.take(pa.array(at)))
            absorb(a, a, True, tau, reach)
            out.append(a.left())
        return pa.concat_tables(out)

    def met(t: pa.Table) -> pa.Table:
        t = sorted_by_id(t)
        block = ints(t.column("_block"))
        low, high = t.column("_low")[0].as_py(), t.column("_high")[0].as_py()
        a = Rows.of(t.filter(pa.array(block == low)))
        b = a if low == high else Rows.of(t.filter(pa.array(block == high)))
        absorb(a, b, low == high, tau, reach)
        return a.left() if low == high else pa.concat_tables([a.left(), b.left()])

    few = fixed.where("_blocks = 1")
    parts = max(1, -(-few.count() // run_rows))
    done = few.withColumn("merged", one).groupBy(F.pmod(F.xxhash64("component"), F.lit(parts)).alias("_part")).applyInArrow(whole, schema)
    large = fixed.where("_blocks > 1")
    most = large.agg(F.max("_blocks")).first()[0] or 0
    if not most:
        return done
    live = large.select("id", F.col("re").alias("_re"), F.col("im").alias("_im"), one)
    for turn in range(2 * most - 1):
        other = F.lit(turn) - F.col("_block")
        now = large.withColumn("_due", (other >= 0) & (other < F.col("_blocks"))).drop("re", "im").join(
            live.withColumnsRenamed({"_re": "re", "_im": "im"}), "id")
        due = now.where("_due").withColumns({"_low": F.least("_block", other), "_high": F.greatest("_block", other)})
        idle = now.where("NOT _due").select("id", F.col("re").alias("_re"), F.col("im").alias("_im"), "merged")
        live = materialize(due.groupBy("component", "_low", "_high").applyInArrow(met, schema).unionByName(idle))
    return done.unionByName(live)


def isolation(df: DataFrame, group: str, vec_id: str, x: str, coupling: float = 1.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Squared amplitude over the summed squared coupling (inverse distance) to all other rows of the group.

    The sum runs over all pairs by definition. It is built from block sums: each task returns one number per row, and
    copies of a vector enter once, with their count.
    """
    base = materialize(df)
    reps = materialize(collapse_copies(base.select(group, vec_id, x), vec_id, x, [group]))
    tasked = pair_tasks(reps.withColumn("_home", F.lit(True)), [group], vec_id, block_rows)

    def sums(left, right, same):
        ia, ib = ints(left.column(vec_id)), ints(right.column(vec_id))
        if not len(ia) or not len(ib):
            ids, loss = np.empty(0, np.int64), np.empty(0)
        else:
            na, nb = ints(left.column("n")), ints(right.column("n"))
            c = (coupling / (pairwise(matrix(left.column(x)), matrix(right.column(x))) + EPS)) ** 2
            if same:
                np.fill_diagonal(c, 0.0)
                ids, loss = ia, c @ nb
            else:
                ids, loss = np.concatenate([ia, ib]), np.concatenate([c @ nb, c.T @ na])
        return pa.table({vec_id: pa.array(ids.astype(np.int64)), "loss": pa.array(loss)})

    parts = on_pairs(tasked, [group], sums, f"{vec_id} long, loss double").groupBy(vec_id).agg(F.sum("loss").alias("loss"))
    per_rep = reps.join(parts, vec_id).withColumn("loss", F.col("loss") + (F.col("n") - 1) * (coupling / EPS) ** 2)
    out = base.join(per_rep.select(group, x, "loss"), [group, x])
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return out.withColumn("isolation", power / F.greatest(F.col("loss"), F.lit(EPS)))


def interference(df: DataFrame, group: str, vec_id: str, x: str, q: str, w: str, threshold: float = 0.1,
                 rate: float = 0.3, tau: float = 0.05) -> DataFrame:
    """The whole filter per group: survivors with amplitude and isolation score. ``threshold`` applies twice, as above.

    Near rows are merged in clusters.
    """
    rows = amplitudes(df, group, x, q, w)
    rows = alive(decay(subtract_partners(rows, group, vec_id, threshold), group, rate=rate), threshold)
    return isolation(merge_near(rows, group, vec_id, x, tau=tau, in_order=False), group, vec_id, x)


def best_survivor(df: DataFrame, survivors: DataFrame, group: str, vec_id: str, d: str) -> DataFrame:
    """Per group: the most isolated survivor, or the row nearest to the target where none survived."""
    pick = survivors.groupBy(group).agg(
        F.max(F.struct("isolation", (-F.col(vec_id)).alias("k"))).alias("_b"), F.count(F.lit(1)).alias("n_survivors"))
    near = df.groupBy(group).agg(F.min(F.struct(F.col(d), F.col(vec_id))).alias("_n"), F.count(F.lit(1)).alias("n"))
    out = near.join(pick, group, "left")
    return out.select(group, F.coalesce(-F.col("_b.k"), F.col(f"_n.{vec_id}")).alias("best"),
                      F.coalesce("n_survivors", F.lit(0)).alias("n_survivors"),
                      (F.col("n") - F.coalesce("n_survivors", F.lit(0))).alias("n_removed"), F.col("_b").isNull().alias("fallback"))
