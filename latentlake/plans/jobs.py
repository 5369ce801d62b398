"""Composed jobs over candidate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentlake.functions.vec import l2, quality, total
from latentlake.operators import flow as relaxing, ordered, quality as rules, reduction, routes, weights
from latentlake.operators.commit import decide
from latentlake.plans import stages
from latentlake.plans.runtime import join_groups, materialize
from latentlake.streaming.memory import Memory, read_out, stepped

ROW = 8 * 1024
RECENT = 10  # steps whose mean distance decides on a commit


def evaluate(df: DataFrame, targets: DataFrame, group: str = "label", squeeze_to: int | None = None, field: str = "damped",
             epsilon: float = 0.1, tol: float = 1e-3, max_steps: int = 1000, tau: float = 0.05, entropy_threshold: float = 0.5,
             drift_threshold: float = 0.01, levels: int = 3, fn=None, rule: Column | None = None, memory: Memory | None = None) -> DataFrame:
    """One row per group: relax its candidates (vec_id, x) toward its target q, repair, weigh, commit to one, judge it.

    ``fn(X, Q)``: a field of the user's own instead of ``field`` (see ``flow_with``). ``rule``: a repair rule on the column
    x_final, with a memory also on h, instead of the one for non-finite values. ``memory``: every candidate's memory takes
    one step from where the candidate ends (column h); the committed one's readout is returned as ``memory``.
    """
    d = rules.validate(df, "x", epsilon, tol, max_steps)
    p = reduction.fit_pca(df, "x", squeeze_to) if squeeze_to else None
    work, goal = df, targets
    if p is not None:
        work = reduction.squeeze(df, "x", p, "x")
        goal = reduction.squeeze(targets, "q", p, "q")
    goal = materialize(goal)
    start = join_groups(work, goal, group, ROW)
    if fn is None:
        rows = relaxing.relax(start, "x", "q", field, epsilon, tol, max_steps).withColumn("tail", F.lit(None).cast("array<double>"))
    else:
        rows = relaxing.flow_with(start.withColumn("r0", l2("x", "q")), "x", "q", fn, epsilon, tol, max_steps, RECENT)
    rows = stepped(rows, "x_final", memory) if memory else rows.withColumn("h", F.lit(None).cast("array<double>"))
    rows = rules.fold_with(rows, "x_final", rules.finite_rule("x_final") if rule is None else rule)
    rows = materialize(rows.withColumn("d", l2("x_final", "q")).select(
        group, "vec_id", "x_final", "r0", "d", "steps", "converged", "ok", "tail", "h"))
    weighed = weights.softmax(rows, group, "d")
    result = weighed.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_candidates"), F.sum("steps").alias("total_steps"),
        F.count_if("converged").alias("converged_count"), F.count_if(~F.col("ok")).alias("fold_corrections"),
        weights.entropy().alias("entropy"),
        F.min_by(F.struct("vec_id", "x_final", "r0", "steps", "tail", "h"), F.struct("d", "vec_id")).alias("best"))
    result = materialize(result)
    if fn is None:
        drift = relaxing.trace(result.select(group, "best.r0"), [group], "r0", field, epsilon, tol, max_steps)
        tail = ordered.top_rows(drift, [group], [F.desc("step")], RECENT).groupBy(group).agg(
            F.count(F.lit(1)).alias("n_recent"), F.avg("drift").alias("mean_recent"))
    else:
        n = F.size("best.tail")
        tail = result.select(group, n.cast("long").alias("n_recent"), (total("best.tail") / n).alias("mean_recent"))
    out = decide(result.join(tail, group), entropy_threshold, RECENT, drift_threshold)
    out = out.withColumn("z", F.col("best.x_final"))
    if p is not None:
        out = reduction.unsqueeze(out, "z", p, "z")
    if memory:
        out = read_out(out.withColumn("_h", F.col("best.h")), "_h", memory)
    out = join_groups(out, targets, group, ROW).withColumn("_e", l2("z", "q"))
    dims = reduction.cascade_dims(d, levels)
    return out.select(group, F.col("best.vec_id").alias("winner"), F.col("z").alias("committed"), "reason", "entropy", "mean_recent",
                      "n_candidates", "total_steps", "converged_count", "fold_corrections", quality("_e", tau).alias("quality"),
                      (F.col("_e") <= tau).alias("is_equivalent"), F.array(*[F.lit(k) for k in dims]).alias("level_dims"), *(["memory"] if memory else []))


def committed_levels(result: DataFrame, d: int, group: str = "label", levels: int = 3) -> DataFrame:
    """(group, level, dim, z): the vectors that ``evaluate`` committed, at every level of abstraction."""
    return reduction.cascade_single(result.select(group, "committed"), group, "committed", d, levels)


# --- named recipes ----------------------------------------------------------------------------------------------------


def converge(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidates, relaxed, repaired, one per group."""
    return df.transform(stages.superpose()).transform(stages.flow(targets)).transform(stages.fold()).transform(stages.commit(targets))


def low_entropy_commit(df: DataFrame, targets: DataFrame, threshold: float, max_steps: int = 1000) -> DataFrame:
    """As converge, but only groups whose weights have concentrated enough commit. Adds entropy."""
    rows = materialize(df.transform(stages.superpose()).transform(stages.flow(targets, max_steps=max_steps)).transform(stages.fold()))
    settled = rows.groupBy("label").agg(weights.entropy().alias("entropy")).where(F.col("entropy") < threshold)
    return rows.transform(stages.commit(targets)).join(settled, "label")


def cascade_after_flow(df: DataFrame, targets: DataFrame, d: int, levels: int = 3) -> DataFrame:
    return converge(df, targets).transform(stages.cascade(levels, d))


def full(df: DataFrame, targets: DataFrame, k: int = 16, tau: float = 0.1, levels: int = 3) -> DataFrame:
    """Squeeze, relax, repair, compare, commit, cascade."""
    p = reduction.fit_pca(df, "x", k)
    goal = materialize(reduction.squeeze(targets, "q", p, "q"))
    return (reduction.squeeze(df, "x", p, "x").transform(stages.superpose()).transform(stages.flow(goal)).transform(stages.fold())
            .transform(stages.equiv(goal, tau)).transform(stages.commit(goal)).transform(stages.cascade(levels, k)))


# --- routes -----------------------------------------------------------------------------------------------------------


def pull_routes(df: DataFrame, route: list[str], candidate: str, item: str, order: list[str], px: str, py: str, reference,
                epsilon: float = 0.1, tol: float = 1e-3, max_steps: int = 10) -> DataFrame:
    """Pull every candidate order of a route toward the reference order and report lengths before and after.

    An order is the table of its items' ranks, so a route may have any number of items. Its distance to the reference is
    a sum over that table, and the relaxed ranks follow from it item by item.
    """
    enc = materialize(routes.encode_ranks(df, [*route, candidate], order))
    ref = enc.where(F.col(candidate) == reference).select(*route, item, F.col("rank_value").alias("goal"))
    both = materialize(enc.join(ref, [*route, item]))
    gap = both.groupBy(*route, candidate).agg(F.sqrt(F.sum(F.pow(F.col("rank_value") - F.col("goal"), 2))).alias("r0"))
    need = relaxing.steps_needed("normalize", "r0", epsilon, tol)
    gap = gap.withColumn("steps", F.least(need, F.lit(max_steps)))
    part = F.when(F.col("r0") < 1e-12, F.lit(1.0)).otherwise(relaxing.radius_at("normalize", "r0", "steps", epsilon) / F.col("r0"))
    moved = join_groups(both, gap.withColumn("_p", part), [*route, candidate]).withColumn(
        "_v", F.col("goal") + (F.col("rank_value") - F.col("goal")) * F.col("_p"))
    before = routes.route_lengths(both, [*route, candidate], ["rank_value", item], px, py).withColumnRenamed("length", "before")
    after = routes.route_lengths(moved, [*route, candidate], ["_v", item], px, py).withColumnRenamed("length", "after")
    out = before.join(after, [*route, candidate]).join(gap.select(*route, candidate, "steps"), [*route, candidate])
    return out.withColumn("improvement_pct", (1 - F.col("after") / F.col("before")) * 100)
