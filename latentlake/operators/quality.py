"""Rules on vectors: repair, norm limits, audit of corrections, input checks, soft constraints, potentials."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latentlake.functions.vec import c, dot, doubles, l2, let, norm, scale, subspace_residual, vec_literal
from latentlake.operators.blocks import BLOCK_ROWS
from latentlake.operators.classify import ReferenceSet, against_blocks, reference_set, summed_over_many, with_distances
from latentlake.operators.flow import MAX_DIM, check_parameters
from latentlake.operators.kernels import matrix, pairwise, pieces, vectors
from latentlake.operators.ordered import kth_smallest

INF = float("inf")


def is_bad(v: Column) -> Column:
    return F.isnan(v) | (v == INF) | (v == -INF)


def has_bad(x) -> Column:
    return F.exists(doubles(x), is_bad)


def repair(x) -> Column:
    """NaN to 0, +Inf to 1, -Inf to -1."""
    return F.transform(doubles(x), lambda v: F.when(F.isnan(v), F.lit(0.0)).when(v == INF, F.lit(1.0))
                       .when(v == -INF, F.lit(-1.0)).otherwise(v))


# The diagnosis texts of the finite and norm rules below
def finite_rule(x) -> Column:
    """Rule struct (ok, diagnosis, correction) for non-finite values."""
    bad = has_bad(x)
    return F.struct((~bad).alias("ok"), F.when(bad, F.lit("NaN/Inf detected")).otherwise(F.lit("clean")).alias("diagnosis"),
                    F.when(bad, repair(x)).alias("correction"))


def norm_rule(x, max_norm: float = 10.0) -> Column:
    """Rule struct for vectors longer than max_norm: shorten to max_norm."""
    def rule(n):
        over = n > max_norm
        said = F.when(over, F.format_string("norm=%.2f > " + str(max_norm), n)).otherwise(F.format_string("norm=%.2f ok", n))
        return F.struct((~over).alias("ok"), said.alias("diagnosis"), F.when(over, scale(x, max_norm / n)).alias("correction"))

    return let(norm(x), rule)


def memory_norm_rule(x, h, max_norm: float = 10.0, max_memory_norm: float = 50.0) -> Column:
    """Rule struct on a vector and its memory: shorten the vector, else damp it by 0.9 if the memory is too long."""
    def rule(p):
        long_state, long_memory = p["n"] > max_norm, p["m"] > max_memory_norm
        fix = F.when(long_state, scale(x, max_norm / p["n"])).when(long_memory, scale(x, F.lit(0.9)))
        said = F.when(long_state, F.lit("state norm")).when(long_memory, F.lit("memory norm")).otherwise(F.lit("ok"))
        return F.struct((~long_state & ~long_memory).alias("ok"), said.alias("diagnosis"), fix.alias("correction"))

    return let(F.struct(norm(x).alias("n"), F.coalesce(norm(h), F.lit(0.0)).alias("m")), rule)


def audit(df: DataFrame, vec_id: str, x: str, rule: Column, interval: int = 1, max_corrections: int | None = None,
          step: str | None = None) -> DataFrame:
    """Apply a rule to the rows whose step is a multiple of ``interval``; correct at most ``max_corrections`` of them.

    The budget goes to the failing rows with the smallest ids. Adds checked, ok, diagnosis, corrected and replaces x.
    """
    checked = (F.col(step or vec_id) % interval) == 0
    out = df.withColumn("checked", checked).withColumn("_r", F.when(F.col("checked"), rule))
    failing = F.col("checked") & ~F.col("_r.ok") & F.col("_r.correction").isNotNull()
    if max_corrections is None:
        out = out.withColumn("corrected", F.coalesce(failing, F.lit(False)))
    else:
        # the budget-th smallest failing id bounds the corrected ids: one value, not a list of all failures
        failed = df.withColumn("checked", checked).withColumn("_r", rule).where(failing).select(vec_id)
        last = kth_smallest(failed, vec_id, max_corrections)
        in_budget = F.lit(False) if last is None else (F.col(vec_id) <= last)
        out = out.withColumn("corrected", F.coalesce(failing & in_budget, F.lit(False)))
    return out.withColumns({
        x: F.when(F.col("corrected"), F.col("_r.correction")).otherwise(doubles(x)),
        "ok": F.col("_r.ok"), "diagnosis": F.col("_r.diagnosis")}).drop("_r")


def validate(df: DataFrame, x: str, epsilon: float = 0.1, tol: float = 1e-3, max_steps: int = 1000) -> int:
    """Check run parameters and that all vectors share one dimension within the limit. Returns the dimension."""
    check_parameters(epsilon, tol, max_steps)
    lo, hi = df.agg(F.min(F.size(x)), F.max(F.size(x))).first()
    if lo != hi:
        raise ValueError(f"vectors differ in dimension: {lo} to {hi}")
    if hi is not None and hi > MAX_DIM:
        raise ValueError(f"dimension {hi} exceeds {MAX_DIM}")
    return hi or 0


def split_valid(df: DataFrame, x: str, d: int) -> tuple[DataFrame, DataFrame]:
    """Rows of dimension d, and the quarantined rest."""
    ok = F.coalesce((F.size(x) == d) & F.lit(d <= MAX_DIM), F.lit(False))
    return df.where(ok), df.where(~ok)


def fold_with(df: DataFrame, x: str, rule: Column) -> DataFrame:
    """Apply a user rule, a struct (ok, diagnosis, correction), keeping the diagnosis."""
    out = df.withColumn("_r", rule)
    return out.withColumns({x: F.when(~F.col("_r.ok") & F.col("_r.correction").isNotNull(), F.col("_r.correction"))
                           .otherwise(doubles(x)), "ok": F.col("_r.ok"), "diagnosis": F.col("_r.diagnosis")}).drop("_r")


def fold_with_batches(df: DataFrame, x: str, rule, others: list[str] | None = None) -> DataFrame:
    """Apply a user rule written on arrays: ``rule(vectors, other columns)`` gets the rows of a batch as a matrix, and the
    named other columns (a memory, a history) as lists, and returns (ok, diagnosis, corrections or None) for the batch."""
    kept = [f for f in df.schema.fields if f.name not in (x, "ok", "diagnosis")]
    schema = T.StructType([*kept, T.StructField(x, T.ArrayType(T.DoubleType())), T.StructField("ok", T.BooleanType()), T.StructField("diagnosis", T.StringType())])

    def run(batches):
        for b in batches:
            if b.num_rows:
                m = matrix(b.column(x))
                ok, said, better = rule(m, {c: b.column(c).to_pylist() for c in others or []})
                ok = np.asarray(ok, bool)
                out = m if better is None else np.where(ok[:, None], m, better)
                yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], vectors(out), pa.array(ok), pa.array(list(said), pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def constraint(x, kind: str, slack: float = 2.0, target=None, radius: float = 0.0, reference=None, tolerance: float = 0.0,
               lower: float = 0.0, upper: float = 0.0, basis=None) -> Column:
    """Whether one soft constraint holds; ``slack`` widens its bound."""
    if kind == "proximity":
        return l2(x, vec_literal(target)) <= radius * slack
    if kind == "orthogonality":
        return F.abs(dot(x, vec_literal(reference))) <= tolerance * slack
    if kind == "norm_bound":
        return let(norm(x), lambda n: (n >= lower / slack) & (n <= upper * slack))
    if kind == "subspace":
        return subspace_residual(x, basis) <= tolerance * slack
    return F.lit(False)


def check_constraints(df: DataFrame, x: str, constraints: list[dict], slack: float = 2.0) -> DataFrame:
    """Add one flag per constraint (``ok``), n_satisfied and n_total."""
    flags = [constraint(x, slack=slack, **spec) for spec in constraints]
    return df.withColumn("ok", F.array(*flags)).withColumns({
        "n_satisfied": F.size(F.filter("ok", lambda v: v)), "n_total": F.size("ok")})


def soft_penalty(df: DataFrame, x: str, targets: ReferenceSet, radius: float, name: str = "penalty") -> DataFrame:
    """Minus the total distance by which a row stays outside the balls around the targets."""
    out = with_distances(df, x, targets, "_d")
    over = F.aggregate("_d", F.lit(0.0), lambda s, v: s + F.greatest(F.lit(0.0), v - radius))
    return out.withColumn(name, -over).drop("_d")


def balance(df: DataFrame, x: str, refs: ReferenceSet, first: int = 0, second: int = 1) -> DataFrame:
    """balance = -|d1 - d2| to two references, mean_distance over all of them."""
    out = with_distances(df, x, refs, "_d")
    return out.withColumns({"balance": -F.abs(F.col("_d")[first] - F.col("_d")[second]),
                            "mean_distance": F.aggregate("_d", F.lit(0.0), lambda s, v: s + v) / F.size("_d")}).drop("_d")


def potential(df: DataFrame, x: str, centers: ReferenceSet, strengths: list[float], widths: list[float]) -> DataFrame:
    """Add value (``potential``) and ``gradient`` of a sum of Gaussian wells."""
    points, s, w2 = centers.points, np.array(strengths, dtype=float), np.array(widths, dtype=float) ** 2
    schema = T.StructType([*df.schema.fields, T.StructField("potential", T.DoubleType()),
                           T.StructField("gradient", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in (piece for batch in batches for piece in pieces(batch, len(points))):
            m = matrix(b.column(x))
            e = s * np.exp(-pairwise(m, points) ** 2 / (2 * w2))
            pull = e / w2
            grad = pull.sum(1)[:, None] * m - pull @ points
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(-e.sum(1)), vectors(grad)], names=schema.names)

    return df.mapInArrow(run, schema)


def balance_of_many(df: DataFrame, vec_id: str, x: str, references: DataFrame, key: str, q: str, first, second, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """balance and mean_distance (with vec_id) for references too many to send to every task; first and second are keys."""
    n = references.count()
    near = reference_set(references.where(F.col(key).isin(first, second)), key, q)
    two = with_distances(df.select(vec_id, x), x, near, "_d").select(vec_id, (-F.abs(F.col("_d")[0] - F.col("_d")[len(near.keys) - 1])).alias("balance"))
    whole = summed_over_many(df, vec_id, x, references, q, lambda d, _: d, block_rows=block_rows)
    return two.join(whole, vec_id).select(vec_id, "balance", (F.col("total") / n).alias("mean_distance"))


def potential_of_many(df: DataFrame, vec_id: str, x: str, wells: DataFrame, q: str, strength: str, width: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, potential, gradient) of wells (q, strength, width) too many to send to every task: sums over blocks of them."""
    def kernel(ids, m, carried, points):
        s, w2 = (np.array(carried[c].to_pylist(), dtype=float) for c in (strength, width))
        w2 = w2 ** 2
        e = s * np.exp(-pairwise(m, points) ** 2 / (2 * w2))
        pull = e / w2
        return pa.table({"id": pa.array(ids), "v": pa.array(-e.sum(1)), "g": vectors(pull.sum(1)[:, None] * m - pull @ points)})

    part = against_blocks(df, vec_id, x, wells, [strength, width], q, kernel, "id long, v double, g array<double>", block_rows)
    return part.groupBy(F.col("id").alias(vec_id)).agg(F.sum("v").alias("potential"), vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("gradient"))


def gate(rows: DataFrame, column: str, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose value is allowed, and the quarantined rest (also nulls)."""
    ok = F.coalesce(c(column).isin(*allowed), F.lit(False))
    return rows.where(ok), rows.where(~ok)
