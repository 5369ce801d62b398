"""Relaxation of every row toward a target.

Each built-in field pulls along the line from the row to its target, so a row's whole path is described by its distance
r to the target. For all fields but ``sin`` the distance after k steps has a closed form, and step counts, convergence
and final positions are plain expressions: the cost does not depend on the number of steps. ``sin`` runs the recurrence
on r alone, batch by batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latentlake.functions.vec import EPS, between, c, doubles, l2, let, mean_vector, scale, sub
from latentlake.operators.kernels import matrix, vectors
from latentlake.plans.runtime import join_groups, materialize

GAINS = {
    "normalize": lambda r: np.ones_like(r),
    "damped": lambda r: np.minimum(r, 1.0),
    "adaptive": lambda r: np.minimum(r, 1.0),
    "sin": lambda r: np.sin(r) / np.maximum(r, 1e-6),
    "repulsive": lambda r: -np.ones_like(r),
}
CLOSED = ("normalize", "damped", "adaptive", "repulsive", "descent")
MAX_DIM = 1024


def check_parameters(epsilon: float, tol: float, max_steps: int) -> None:
    if not 0 < epsilon < 1:
        raise ValueError("epsilon must lie strictly between 0 and 1")
    if tol <= 0:
        raise ValueError("tol must be positive")
    if max_steps < 1:
        raise ValueError("max_steps must be at least 1")


def gain(field: str, r: Column) -> Column:
    """Pull per unit step at distance r."""
    g = {"normalize": F.lit(1.0), "damped": F.least(r, F.lit(1.0)), "adaptive": F.least(r, F.lit(1.0)),
         "sin": F.sin(r) / F.greatest(r, F.lit(1e-6)), "repulsive": F.lit(-1.0)}[field]
    return F.when(r < EPS, F.lit(0.0)).otherwise(g)


def field_vector(field: str, x, q) -> Column:
    """The field itself: direction to the target times the gain."""
    factor = let(l2(x, q), lambda r: F.when(r < EPS, F.lit(0.0)).otherwise(gain(field, r) / F.greatest(r, F.lit(EPS))))
    return scale(sub(q, x), factor)


def radius_at(field: str, r0, k, epsilon: float) -> Column:
    """Distance to the target after k steps, from distance r0."""
    r0, k = c(r0), c(k)
    if field == "normalize":
        r = F.greatest(F.lit(0.0), r0 - k * epsilon)
    elif field in ("damped", "adaptive"):
        far = F.greatest(F.lit(0.0), F.ceil((r0 - 1.0) / epsilon).cast("double"))
        r = F.when(k <= far, r0 - k * epsilon).otherwise((r0 - far * epsilon) * F.pow(F.lit(1.0 - epsilon), k - far))
    elif field == "repulsive":
        doublings = F.when(r0 < epsilon, F.ceil(F.log2(epsilon / r0)).cast("double")).otherwise(F.lit(0.0))
        near = F.least(k.cast("double"), doublings)
        r = r0 * F.pow(F.lit(2.0), near) + (k - near) * epsilon
    elif field == "descent":
        r = r0 * F.pow(F.lit(1.0 - epsilon), k)
    else:
        raise ValueError(f"no closed form for field {field!r}")
    return F.when(r0 < EPS, r0).otherwise(r)


def steps_needed(field: str, r0, epsilon: float, tol: float) -> Column:
    """Steps until the distance is below tol; null where it never gets there."""
    r0 = c(r0)
    shrink = float(np.log(1.0 - epsilon))
    if field == "normalize":
        k = F.floor((r0 - tol) / epsilon) + 1
    elif field in ("damped", "adaptive"):
        far = F.greatest(F.lit(0), F.ceil((r0 - 1.0) / epsilon))
        r1 = r0 - far * epsilon
        k = far + F.when(r1 < tol, F.lit(0)).otherwise(F.floor(F.log(tol / r1) / shrink) + 1)
    elif field == "repulsive":
        k = F.when(r0 + F.least(r0, F.lit(epsilon)) < tol, F.lit(1))
        return F.when(r0 < EPS, F.lit(1)).otherwise(k).cast("long")
    elif field == "descent":
        k = F.when(r0 < tol, F.lit(1)).otherwise(F.floor(F.log(tol / r0) / shrink) + 1)
    else:
        raise ValueError(f"no closed form for field {field!r}")
    return F.when(r0 < tol, F.lit(1)).otherwise(F.greatest(F.lit(1), k)).cast("long")


def _advance(r: np.ndarray, g, epsilon: float) -> np.ndarray:
    """One capped step on distances: at most length 1, at most up to the target."""
    pull = np.where(r < EPS, 0.0, g(r))
    n = np.minimum(np.abs(epsilon * pull), 1.0)
    n = np.where((n > EPS) & (n > r), r, n)
    return np.abs(r - np.sign(pull) * n)


def relax_by_steps(df: DataFrame, r0: str, field: str, epsilon: float, tol: float, max_steps: int) -> DataFrame:
    """Add steps, converged and r_final by running the recurrence on the distance column; finished rows leave the loop."""
    g = GAINS[field]
    schema = T.StructType([*df.schema.fields, T.StructField("steps", T.LongType()),
                           T.StructField("converged", T.BooleanType()), T.StructField("r_final", T.DoubleType())])

    def run(batches):
        for b in batches:
            r = np.array(b.column(r0).to_numpy(zero_copy_only=False), dtype=np.float64)
            steps = np.zeros(len(r), dtype=np.int64)
            active = np.arange(len(r))
            for _ in range(max_steps):
                if not len(active):
                    break
                r[active] = _advance(r[active], g, epsilon)
                steps[active] += 1
                active = active[r[active] >= tol]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(steps), pa.array(r < tol), pa.array(r)],
                                             names=schema.names)

    return df.mapInArrow(run, schema)


def relax(df: DataFrame, x: str, q: str, field: str = "normalize", epsilon: float = 0.1, tol: float = 1e-3,
          max_steps: int = 1000, final: bool = True) -> DataFrame:
    """Add r0, steps, converged, r_final and (if ``final``) the final position x_final."""
    check_parameters(epsilon, tol, max_steps)
    out = df.withColumn("r0", l2(x, q))
    if field in CLOSED:
        need = steps_needed(field, "r0", epsilon, tol)
        out = out.withColumns({"steps": F.coalesce(F.least(need, F.lit(max_steps)), F.lit(max_steps)).cast("long"),
                               "converged": F.coalesce(need <= max_steps, F.lit(False))})
        out = out.withColumn("r_final", radius_at(field, "r0", "steps", epsilon))
    else:
        out = relax_by_steps(out, "r0", field, epsilon, tol, max_steps)
    if final:
        out = out.withColumn("x_final", path_at(x, q, "r0", "r_final"))
    return out


def trace(df: DataFrame, keys: list[str], r0: str, field: str = "normalize", epsilon: float = 0.1, tol: float = 1e-3,
          max_steps: int = 1000) -> DataFrame:
    """Long trace (keys, step, drift): one row per step until convergence or the step limit."""
    check_parameters(epsilon, tol, max_steps)
    if field in CLOSED:
        need = steps_needed(field, r0, epsilon, tol)
        last = F.coalesce(F.least(need, F.lit(max_steps)), F.lit(max_steps)).cast("int")
        out = df.select(*keys, F.col(r0).alias("_r0"), F.explode(F.sequence(F.lit(1), last)).alias("step"))
        return out.select(*keys, "step", radius_at(field, "_r0", "step", epsilon).alias("drift"))
    g = GAINS[field]
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("step", T.IntegerType()),
                           T.StructField("drift", T.DoubleType())])

    def run(batches):
        for b in batches:
            r = np.array(b.column(r0).to_numpy(zero_copy_only=False), dtype=np.float64)
            active = np.arange(len(r))
            for step in range(1, max_steps + 1):
                if not len(active):
                    break
                r[active] = _advance(r[active], g, epsilon)
                t = b.take(pa.array(active))
                yield pa.RecordBatch.from_arrays(
                    [*[t.column(k) for k in keys], pa.array(np.full(len(active), step, dtype=np.int32)),
                     pa.array(r[active])], names=schema.names)
                active = active[r[active] >= tol]

    return df.select(*keys, r0).mapInArrow(run, schema)


def path_at(x, q, r0, drift) -> Column:
    """Position on the way to the target at a given distance from it."""
    part = F.when(c(r0) < EPS, F.lit(1.0)).otherwise(c(drift) / c(r0))
    return between(q, x, part)


def recursive(df: DataFrame, r0: str, field: str = "normalize", epsilon: float = 0.1, tol: float = 1e-3,
              max_iterations: int = 100, inner_steps: int = 50, fixed_point_tol: float = 1e-4) -> DataFrame:
    """Repeat blocks of inner steps, without a cap at the target, until the block hits the target, stops moving or runs out.

    Adds iterations, termination, the signed final coordinate rho on the line from the target to the start, and the outer
    ``trace``: rho after every block, at most ``max_iterations`` values. Its absolute values are the drifts, differences
    of neighbours the distances moved, and ``path_at`` gives the positions.
    """
    g = GAINS[field]
    schema = T.StructType([*df.schema.fields, T.StructField("iterations", T.LongType()),
                           T.StructField("termination", T.StringType()), T.StructField("rho", T.DoubleType()),
                           T.StructField("trace", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            rho = np.array(b.column(r0).to_numpy(zero_copy_only=False), dtype=np.float64)
            rounds = np.zeros(len(rho), dtype=np.int64)
            why = np.full(len(rho), "timeout", dtype=object)
            active = np.arange(len(rho))
            told = []
            for _ in range(max_iterations):
                if not len(active):
                    break
                start = rho[active].copy()
                cur, moving = start.copy(), np.arange(len(active))
                for _ in range(inner_steps):
                    if not len(moving):
                        break
                    v = cur[moving]
                    r = np.abs(v)
                    step = np.clip(epsilon * np.where(r < EPS, 0.0, g(r)), -1.0, 1.0)
                    cur[moving] = v - np.sign(v) * step
                    moving = moving[np.abs(cur[moving]) >= tol]
                rho[active] = cur
                rounds[active] += 1
                told.append((active, cur.copy()))
                hit = np.abs(cur) < tol
                still = ~hit & (np.abs(cur - start) <= fixed_point_tol)
                why[active[hit]], why[active[still]] = "attractor_reached", "fixed_point"
                active = active[~hit & ~still]
            who = np.concatenate([a for a, _ in told]) if told else np.zeros(0, np.int64)
            values = np.concatenate([v for _, v in told]) if told else np.zeros(0)
            order = np.argsort(who, kind="stable")  # rounds stay in order within a row
            trace = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rounds)]), pa.int32()), pa.array(values[order]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rounds), pa.array(why.tolist(), pa.string()),
                                              pa.array(rho), trace], names=schema.names)

    return df.mapInArrow(run, schema)


def coupled(df: DataFrame, group: str, vec_id: str, x: str, q: str, field: str = "normalize", epsilon: float = 0.1,
            tol: float = 1e-3, max_steps: int = 500, coupling: float = 0.05, fix_every: int = 3) -> DataFrame:
    """Relaxation in which every step also draws each row toward its group's softmax-weighted centroid.

    Each round needs the groups' centroids, so it is one aggregation over the whole table, built up before the shuffle,
    and one join. The weights are relative, so the group's best distance of the round before serves as their shift. The
    state is written out every ``fix_every`` rounds; the loop ends once all rows are within tol.
    """
    check_parameters(epsilon, tol, max_steps)

    def part(r):
        g = gain(field, r)
        return F.when(r < EPS, F.lit(0.0)).otherwise(F.least(F.abs(epsilon * g), F.lit(1.0)) * F.signum(g) / r)

    state = df.select(group, vec_id, doubles(x).alias("x"), doubles(q).alias("q"))
    best = state.groupBy(group).agg(F.min(l2("x", "q")).alias("_best"))
    state = join_groups(state, best, group)
    for step in range(1, max_steps + 1):
        state = state.withColumn("x", between("x", "q", let(l2("x", "q"), part))).withColumn("d", l2("x", "q"))
        mean = materialize(state.withColumn("_w", F.exp(F.col("_best") - F.col("d"))).groupBy(group).agg(
            mean_vector("x", "_w").alias("_c"), F.min("d").alias("_next"), F.max("d").alias("_far")))
        state = join_groups(state, mean.drop("_far"), group, row_bytes=8 * 1024, fixed=True).select(
            group, vec_id, between("x", "_c", F.lit(coupling)).alias("x"), "q", F.col("_next").alias("_best"))
        if (mean.agg(F.max("_far")).first()[0] or 0.0) < tol:
            break
        if step % fix_every == 0:
            state = materialize(state)
    return state.drop("_best").withColumn("d", l2("x", "q"))


def flow_with(df: DataFrame, x: str, q: str, fn, epsilon: float = 0.1, tol: float = 1e-3, max_steps: int = 1000, last: int = 0) -> DataFrame:
    """Relaxation under a user function ``fn(X, Q) -> delta`` on (n, d) matrices.

    Non-finite rows of delta count as zero, a step is at most 1 long and never passes the target. With ``last``, the column
    ``tail`` holds the distances after each row's last steps, as many at most.
    """
    check_parameters(epsilon, tol, max_steps)
    fields = [*df.schema.fields, T.StructField("x_final", T.ArrayType(T.DoubleType())),
              T.StructField("steps", T.LongType()), T.StructField("converged", T.BooleanType())]
    schema = T.StructType([*fields, T.StructField("tail", T.ArrayType(T.DoubleType()))] if last else fields)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            pos, goal = matrix(b.column(x)).copy(), matrix(b.column(q))
            steps = np.zeros(len(pos), dtype=np.int64)
            done = np.zeros(len(pos), dtype=bool)
            held = np.zeros((len(pos), last))
            active = np.arange(len(pos))
            for _ in range(max_steps):
                if not len(active):
                    break
                cur, to = pos[active], goal[active]
                delta = epsilon * np.asarray(fn(cur, to), dtype=np.float64)
                delta[~np.isfinite(delta).all(1)] = 0.0
                size = np.sqrt((delta * delta).sum(1))
                left = np.sqrt(((to - cur) ** 2).sum(1))
                want = np.minimum(size, 1.0)
                want = np.where((want > EPS) & (want > left), left, want)
                pos[active] = cur + delta * (want / np.maximum(size, EPS))[:, None]
                apart = np.sqrt(((goal[active] - pos[active]) ** 2).sum(1))
                if last:
                    held[active, steps[active] % last] = apart
                steps[active] += 1
                near = apart < tol
                done[active[near]] = True
                active = active[~near]
            tails = [[h[k % last] for k in range(max(0, n - last), n)] for h, n in zip(held.tolist(), steps.tolist())] if last else None
            yield pa.RecordBatch.from_arrays([*b.columns, vectors(pos), pa.array(steps), pa.array(done), *([pa.array(tails, pa.list_(pa.float64()))] if last else [])],
                                             names=schema.names)

    return df.mapInArrow(run, schema)


# Convergence tier and Lipschitz bound of each field (1 provable, 2 empirical, 3 non-convergent)
CONTRACTS = {"normalize": (1, 0.1), "damped": (1, 0.1), "sin": (2, None), "adaptive": (2, None), "repulsive": (3, None)}


def contracts(spark, rows: list[tuple]) -> DataFrame:
    """A table (field, tier, lipschitz_bound, justification) of user contracts, checked: tiers are 1 to 3, and tier 1 needs
    a bound below 1."""
    for field, tier, bound, _ in rows:
        if tier not in (1, 2, 3):
            raise ValueError(f"{field}: tier {tier} is not 1, 2 or 3")
        if tier == 1 and (bound is None or not 0 <= bound < 1):
            raise ValueError(f"{field}: a provable contract needs a Lipschitz bound below 1")
    return spark.createDataFrame(rows, "field string, tier int, lipschitz_bound double, justification string")


def check_contract(df: DataFrame, field: str = "field", strict: bool = False, known: DataFrame | None = None) -> DataFrame:
    """Hold each run (steps, converged, r_final) against the contract of its field.

    Adds tier, lipschitz_bound, tier_honored and failure_signal. ``known``: a table made by ``contracts`` that is asked
    before the built-in ones. Other fields are empirical. With ``strict`` a violation raises.
    """
    spark = df.sparkSession
    table = spark.createDataFrame([(f, t, b) for f, (t, b) in CONTRACTS.items()], "field string, tier int, lipschitz_bound double")
    if known is not None:
        own = known.select("field", "tier", "lipschitz_bound")
        table = own.unionByName(table.join(own.select("field"), "field", "left_anti"))
    out = join_groups(df.withColumn("_field", F.col(field)), table.withColumnRenamed("field", "_field"), "_field", how="left").drop("_field")
    out = out.withColumn("tier", F.coalesce("tier", F.lit(2)))
    broken = (F.col("tier") == 1) & ~F.col("converged")
    expected = (F.col("tier") == 3) & ~F.col("converged")
    out = out.withColumns({
        "tier_honored": ~broken,
        "failure_signal": F.when(broken, F.lit("tier 1 violated")).when(expected, F.lit("tier 3 expected"))
        .otherwise(F.lit(""))})
    if strict and not out.where(broken).isEmpty():
        raise RuntimeError("a run declared provably convergent did not converge")
    return out
