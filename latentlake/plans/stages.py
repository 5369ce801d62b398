"""Stages for ``df.transform``: each takes and returns a candidate table (group, vec_id, x, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentlake.functions.vec import EPS, between, l2, quality
from latentlake.operators import classify, flow as relaxing, quality as rules, reduction, weights
from latentlake.plans.runtime import join_groups
from latentlake.sources.readers import to_candidates
from latentlake.streaming.memory import Memory

ROW = 8 * 1024


def superpose(group: str = "label"):
    """Rows to equally weighted candidates; candidates stay as they are."""
    return lambda df: to_candidates(df, group, "vec_id", "x")


def flow(targets: DataFrame, group: str = "label", field: str = "normalize", epsilon: float = 0.1, tol: float = 1e-3,
         max_steps: int = 1000):
    """Relax toward the group's target q and weigh candidates by what distance is left. Adds steps, converged, d."""

    def stage(df: DataFrame) -> DataFrame:
        out = relaxing.relax(join_groups(df.drop("w"), targets, group, ROW), "x", "q", field, epsilon, tol, max_steps)
        out = out.withColumn("x", F.col("x_final")).withColumn("d", F.col("r_final"))
        return weights.softmax(out.drop("x_final", "r_final", "r0", "q"), group, "d")

    return stage


def squeeze(k: int):
    def stage(df: DataFrame) -> DataFrame:
        return reduction.squeeze(df, "x", reduction.fit_pca(df, "x", k), "x")

    return stage


def fold(rule=rules.finite_rule):
    """Repair candidates by a rule; adds ok and diagnosis."""
    return lambda df: rules.fold_with(df, "x", rule("x"))


def equiv(targets: DataFrame, tau: float = 0.05, group: str = "label"):
    """Adds quality and equivalent with respect to the group's target."""

    def stage(df: DataFrame) -> DataFrame:
        out = join_groups(df, targets, group, ROW).withColumn("_e", l2("x", "q"))
        return out.withColumns({"quality": quality("_e", tau), "equivalent": F.col("_e") <= tau}).drop("_e", "q")

    return stage


def commit(targets: DataFrame, group: str = "label"):
    """One candidate per group: the one closest to the target."""

    def stage(df: DataFrame) -> DataFrame:
        out = join_groups(df, targets, group, ROW).withColumn("_d", l2("x", "q")).drop("q")
        return out.groupBy(group).agg(F.min_by(F.struct(*df.columns), F.struct("_d", "vec_id")).alias("_b")).select("_b.*")

    return stage


def cascade(levels: int, d: int):
    """Levels of every row by truncation: (vec_id, level, dim, z)."""
    return lambda df: reduction.cascade_single(df, "vec_id", "x", d, levels)


def remember(d: int, seed: int = 42):
    """First readout of a fresh memory fed with each candidate, as column ``memory``."""
    mem = Memory(d, seed=seed)
    w_in, _, w_out = mem.matrices()
    import numpy as np

    return lambda df: reduction._apply(df, "x", lambda m: (mem.leak * np.tanh(m @ w_in.T)) @ w_out.T, "memory")


def recurse(targets: DataFrame, group: str = "label", **kw):
    """Blocks of steps until hit, fixed or out of rounds; x moves to where the row ends. Adds termination, iterations."""

    def stage(df: DataFrame) -> DataFrame:
        out = join_groups(df, targets, group, ROW).withColumn("r0", l2("x", "q"))
        out = relaxing.recursive(out, "r0", **kw)
        part = F.when(F.col("r0") < EPS, F.lit(1.0)).otherwise(F.col("rho") / F.col("r0"))
        return out.withColumn("x", between("q", "x", part)).drop("q", "r0", "rho")

    return stage


def compete(refs: classify.ReferenceSet, **kw):
    """Adds winner, margin, certainty and contested after competition of the references."""
    return lambda df: classify.compete(df, "x", refs, **kw)
