"""Distances of every row to a reference set, nearest reference, competition between references."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latentlake.functions.vec import EPS, doubles, let, norm
from latentlake.operators.blocks import BLOCK_ROWS, on_pairs, pair_tasks
from latentlake.operators.kernels import exact_smallest, ints, matrix, pairwise, pieces, smallest, vectors
from latentlake.operators.flow import GAINS, MAX_DIM
from latentlake.plans.runtime import BROADCAST_BYTES, materialize


COSINE_SLACK = 1e-12  # what the product form of a cosine distance may be off, with room to spare


class ReferenceSet:
    """A reference table proven small enough to travel with every task: sorted keys and their vectors."""

    def __init__(self, keys: list, points: np.ndarray):
        self.keys, self.points = keys, points

    def label(self, index: Column) -> Column:
        return F.element_at(F.lit(self.keys), (index + 1).cast("int"))

    def point(self, key) -> list[float]:
        return self.points[self.keys.index(key)].tolist()


def reference_set(df: DataFrame, key: str, x: str, limit: int = BROADCAST_BYTES) -> ReferenceSet | None:
    """Collect a reference table if its size is within the limit, else None."""
    sure = limit // (8 * MAX_DIM)  # so many rows fit whatever their dimension
    rows = df.select(key, x).limit(sure + 1).collect()
    if len(rows) > sure:
        fixed = materialize(df.select(key, x))
        n, d = fixed.agg(F.count(F.lit(1)), F.max(F.size(x))).first()
        if n * (d or 1) * 8 > limit:
            return None
        rows = fixed.collect()
    rows = sorted((r[0], r[1]) for r in rows)
    return ReferenceSet([r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64))


def _bounded(refs) -> ReferenceSet:
    if refs is None:
        raise ValueError("the reference set exceeds the broadcast bound; use the form of this operator that ends in _of_many")
    return refs


def with_distances(df: DataFrame, x: str, refs: ReferenceSet, name: str = "dists") -> DataFrame:
    """Add the array of distances to all references: one matrix product per Arrow batch, no join and no shuffle."""
    points = _bounded(refs).points
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def score(batches):
        for b in (piece for batch in batches for piece in pieces(batch, len(points))):
            yield pa.RecordBatch.from_arrays([*b.columns, vectors(pairwise(matrix(b.column(x)), points))], names=schema.names)

    return df.mapInArrow(score, schema)


def verdict(d1: Column, d2: Column, tol: float) -> dict[str, Column]:
    return {"margin": d2 - d1,
            "certainty": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - d1 / F.greatest(d2, F.lit(EPS)))),
            "contested": (d2 - d1) < tol}


def nearest(df: DataFrame, x: str, refs: ReferenceSet, tol: float = 1e-2) -> DataFrame:
    """Winner, margin to the second, certainty and contested flag. A single reference always wins with certainty 1."""
    points = _bounded(refs).points
    schema = T.StructType([*df.schema.fields, T.StructField("winner_idx", T.IntegerType()),
                           T.StructField("d1", T.DoubleType()), T.StructField("d2", T.DoubleType())])

    def two_best(batches):
        for b in (piece for batch in batches for piece in pieces(batch, len(points))):
            m = matrix(b.column(x))
            d = exact_smallest(pairwise(m, points), m, points, 2)
            at = np.arange(len(d))
            first = d.argmin(1)
            d1 = d[at, first]
            d[at, first] = np.inf
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first.astype(np.int32)), pa.array(d1), pa.array(d.min(1))],
                                             names=schema.names)

    out = df.mapInArrow(two_best, schema)
    return out.withColumns({"winner": refs.label(F.col("winner_idx")), **verdict(F.col("d1"), F.col("d2"), tol)})


def nearest_of_many(df: DataFrame, vec_id: str, x: str, references: DataFrame, key: str, q: str, tol: float = 1e-2,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The same verdict when the references are too many to send to every task.

    Blocks of rows meet blocks of references; each task returns two rows per input row, merged per row afterwards.
    Returns (vec_id, winner, d1, d2, margin, certainty, contested).
    """
    key_type = dict(references.dtypes)[key]
    rows = df.select(F.col(vec_id).alias("_id"), F.col(x).cast("array<double>").alias("_x"),
                     F.lit(None).cast(key_type).alias("_key"), F.lit(True).alias("_home"))
    refs = references.select(F.lit(None).cast("long").alias("_id"), F.col(q).cast("array<double>").alias("_x"),
                             F.col(key).alias("_key"), F.lit(False).alias("_home"))
    both = rows.union(refs).withColumn("_all", F.lit(0)).withColumn("_spread", F.xxhash64("_id", "_key"))
    tasked = pair_tasks(both, ["_all"], "_spread", block_rows, within=False)

    def two_best(left, right, same):
        m, q = matrix(left.column("_x")), matrix(right.column("_x"))
        d = exact_smallest(pairwise(m, q), m, q, 2)
        keys = right.column("_key")
        rank = np.argsort(np.argsort(np.array(keys.to_pylist(), dtype=object)))
        r, at = smallest(d, rank, 2)
        return pa.table({"_id": pa.array(ints(left.column("_id"))[r].astype(np.int64)), "d": pa.array(d[r, at]),
                         "key": keys.take(pa.array(at))})

    part = materialize(on_pairs(tasked, ["_all"], two_best, f"_id long, d double, key {key_type}"))  # read twice
    pair = F.struct("d", "key")  # the two smallest, merged by aggregates of fixed size
    first = part.groupBy("_id").agg(F.min(pair).alias("one"))
    second = part.join(first, "_id").where(pair != F.col("one")).groupBy("_id").agg(F.min("d").alias("d2"))
    out = first.join(second, "_id", "left").select(F.col("_id").alias(vec_id), F.col("one.key").alias("winner"), F.col("one.d").alias("d1"),
                                                   F.coalesce("d2", F.lit(float("inf"))).alias("d2"))
    return out.withColumns(verdict(F.col("d1"), F.col("d2"), tol))


def _units(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(1))
    return np.where(n[:, None] < EPS, 0.0, m / np.maximum(n, EPS)[:, None])


def _apart(m: np.ndarray, points: np.ndarray, metric: str, tau: float) -> np.ndarray:
    """Distances (rows of m x points); columns' smallest entries, and those near tau, are direct. Cosine: 1 where a side
    has no direction."""
    if metric == "cosine":
        d = 1.0 - _units(m) @ _units(points).T
        i, j = np.nonzero((d <= d.min(0, initial=np.inf) + COSINE_SLACK) | (np.abs(d - tau) <= COSINE_SLACK))
        na, nb = np.sqrt((m * m).sum(1))[i], np.sqrt((points * points).sum(1))[j]
        blank = (na < EPS) | (nb < EPS)
        for s in range(0, len(i), 65536):
            k = slice(s, s + 65536)
            with np.errstate(invalid="ignore", divide="ignore"):
                d[i[k], j[k]] = np.where(blank[k], 1.0, 1.0 - (m[i[k]] * points[j[k]]).sum(1) / (na[k] * nb[k]))
        return d
    if metric != "l2":
        raise ValueError(f"unknown metric {metric}")
    return exact_smallest(pairwise(m, points).T.copy(), points, m).T


def best_equivalent(df: DataFrame, vec_id: str, x: str, refs: ReferenceSet, tau: float, metric: str = "l2") -> DataFrame:
    """Per target: the nearest candidate (``l2`` or ``cosine``), or -1 where even that one is beyond the tolerance.

    Each batch sends its best candidate per target only.
    """
    points = _bounded(refs).points

    def local(batches):
        for b in (piece for batch in batches for piece in pieces(batch, len(points))):
            ids = ints(b.column(vec_id))
            order = np.argsort(ids, kind="stable")
            d = _apart(matrix(b.column(x))[order], points, metric, tau)
            at = d.argmin(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(points), dtype=np.int64)), pa.array(d[at, np.arange(len(points))]),
                 pa.array(ids[order][at].astype(np.int64))], names=["idx", "d", "id"])

    best = df.select(vec_id, x).mapInArrow(local, "idx long, d double, id long").groupBy("idx").agg(
        F.min(F.struct("d", "id")).alias("b"))
    return best.select(refs.label(F.col("idx")).alias("target"), F.col("b.d").alias("d"),
                       F.when(F.col("b.d") <= tau, F.col("b.id")).otherwise(F.lit(-1)).alias("best_id"))


def against_blocks(df: DataFrame, vec_id: str, x: str, references: DataFrame, carry: list[str], q: str, kernel, schema: str,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Run ``kernel(ids, rows, references' carried columns, their vectors)`` on every block of rows with every block of references."""
    types = dict(references.dtypes)
    rows = df.select(F.col(vec_id).cast("long").alias("_id"), doubles(x).alias("_x"), *[F.lit(None).cast(types[c]).alias(c) for c in carry], F.lit(True).alias("_home"))
    refs = references.select(F.lit(None).cast("long").alias("_id"), doubles(q).alias("_x"), *carry, F.lit(False).alias("_home"))
    both = rows.union(refs).withColumn("_all", F.lit(0)).withColumn("_spread", F.xxhash64("_id", "_x"))
    tasked = pair_tasks(both, ["_all"], "_spread", block_rows, within=False)

    def run(left, right, same):
        return kernel(ints(left.column("_id")).astype(np.int64), matrix(left.column("_x")), {c: right.column(c) for c in carry}, matrix(right.column("_x")))

    return on_pairs(tasked, ["_all"], run, schema)


def best_equivalent_of_many(df: DataFrame, vec_id: str, x: str, references: DataFrame, key: str, q: str, tau: float, metric: str = "l2",
                            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """best_equivalent for targets too many to send to every task; a task returns one candidate per target of its block."""
    def kernel(ids, m, carried, points):
        order = np.argsort(ids, kind="stable")
        d = _apart(m[order], points, metric, tau)
        at = d.argmin(0)
        return pa.table({"target": carried[key], "d": pa.array(d[at, np.arange(len(points))]), "id": pa.array(ids[order][at])})

    part = against_blocks(df, vec_id, x, references, [key], q, kernel, f"target {dict(references.dtypes)[key]}, d double, id long", block_rows)
    best = part.groupBy("target").agg(F.min(F.struct("d", "id")).alias("b"))
    return best.select("target", F.col("b.d").alias("d"), F.when(F.col("b.d") <= tau, F.col("b.id")).otherwise(F.lit(-1)).alias("best_id"))


def summed_over_many(df: DataFrame, vec_id: str, x: str, references: DataFrame, q: str, score, carry: list[str] | None = None,
                     block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, total): per row the sum of ``score(distances, carried arrays)`` over references too many to send to every task."""
    def kernel(ids, m, carried, points):
        values = score(pairwise(m, points), {c: np.array(v.to_pylist(), dtype=np.float64) for c, v in carried.items()})
        return pa.table({"id": pa.array(ids), "part": pa.array(values.sum(1))})

    part = against_blocks(df, vec_id, x, references, carry or [], q, kernel, "id long, part double", block_rows)
    return part.groupBy(F.col("id").alias(vec_id)).agg(F.sum("part").alias("total"))


def competition_summary(results: DataFrame, refs: ReferenceSet) -> DataFrame:
    """One row per label, also for labels that won nothing: count, with the totals of the whole run alongside."""
    spark = results.sparkSession
    labels = spark.createDataFrame([(k,) for k in refs.keys], T.StructType([T.StructField("winner", results.schema["winner"].dataType)]))
    return _summary(results, labels)


def competition_summary_of_many(results: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """competition_summary for references too many to be collected."""
    return _summary(results, references.select(F.col(key).alias("winner")).distinct())


def _summary(results: DataFrame, labels: DataFrame) -> DataFrame:
    parts = materialize(results.groupBy("winner").agg(
        F.count(F.lit(1)).alias("n"), F.sum("certainty").alias("certainty"),
        F.count_if("contested").alias("contested")))
    whole = parts.agg(F.sum("n"), F.sum("certainty") / F.sum("n"), F.sum("contested")).first()
    return labels.join(parts.select("winner", "n"), "winner", "left").select(
        "winner", F.coalesce("n", F.lit(0)).alias("n"), F.lit(whole[1] or 0.0).alias("mean_certainty"),
        F.lit(whole[2] or 0).alias("contested"), F.lit(whole[0] or 0).alias("total"))


def compete(df: DataFrame, x: str, refs: ReferenceSet, field: str = "normalize", epsilon: float = 0.1, tol: float = 1e-2,
            max_steps: int = 500) -> DataFrame:
    """Move every row under the mean pull of all references until one captures it, then name the winner.

    Batches of rows move together; rows already captured stop taking part.
    """
    points, gain = _bounded(refs).points, GAINS[field]
    schema = T.StructType([*df.schema.fields, T.StructField("x_final", T.ArrayType(T.DoubleType())),
                           T.StructField("steps", T.IntegerType())])

    def move(batches):
        for b in (piece for batch in batches for piece in pieces(batch, len(points))):
            pos = matrix(b.column(x)).copy()
            steps = np.zeros(len(pos), dtype=np.int32)
            active = np.arange(len(pos))
            for _ in range(max_steps):
                d = pairwise(pos[active], points)
                going = d.min(1) >= tol
                active, d = active[going], d[going]
                if not len(active):
                    break
                pull = np.where(d < EPS, 0.0, gain(d) / np.maximum(d, EPS)) / len(points)
                step = epsilon * (pull @ points - pull.sum(1)[:, None] * pos[active])
                pos[active] += step / np.maximum(1.0, np.sqrt((step * step).sum(1)))[:, None]
                steps[active] += 1
            yield pa.RecordBatch.from_arrays([*b.columns, vectors(pos), pa.array(steps)], names=schema.names)

    return nearest(df.mapInArrow(move, schema), "x_final", refs, tol)


def compete_of_many(df: DataFrame, vec_id: str, x: str, references: DataFrame, key: str, q: str, field: str = "normalize", epsilon: float = 0.1, tol: float = 1e-2,
                    max_steps: int = 500, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """compete for references too many to send to every task: (vec_id, x_final, steps, winner, d1, d2, margin, ...).

    A step adds up each row's pull over the blocks of references; rows that are captured leave, and the loop ends with the
    last of them. Each round's positions are checkpointed.
    """
    gain, fixed = GAINS[field], materialize(references.select(key, doubles(q).alias(q)))
    n = fixed.count()

    def pulls(ids, m, carried, points):
        d = pairwise(m, points)
        pull = np.where(d < EPS, 0.0, gain(d) / np.maximum(d, EPS)) / n
        return pa.table({"id": pa.array(ids), "least": pa.array(d.min(1)), "sum": vectors(pull @ points - pull.sum(1)[:, None] * m)})

    moving = materialize(df.select(F.col(vec_id).cast("long").alias("id"), doubles(x).alias("x"), F.lit(0).alias("steps")))
    done = []
    for _ in range(max_steps):
        part = against_blocks(moving, "id", "x", fixed, [], q, pulls, "id long, least double, sum array<double>", block_rows)
        total = part.groupBy("id").agg(F.min("least").alias("least"), vector_to_array(Summarizer.sum(array_to_vector("sum"))).alias("sum"))
        both = materialize(moving.join(total, "id"))
        done.append(both.where(F.col("least") < tol).select("id", "x", "steps"))
        step = let(F.transform("sum", lambda v: v * epsilon), lambda s: let(F.greatest(F.lit(1.0), norm(s)), lambda size: F.zip_with("x", s, lambda a, b: a + b / size)))
        moving = materialize(both.where(F.col("least") >= tol).select("id", step.alias("x"), (F.col("steps") + 1).alias("steps")))
        if moving.isEmpty():
            break
    ended = materialize(reduce(DataFrame.unionByName, [*done, moving]))
    verdicts = nearest_of_many(ended, "id", "x", fixed, key, q, tol, block_rows)
    return ended.join(verdicts, "id").select(F.col("id").alias(vec_id), F.col("x").alias("x_final"), "steps", "winner", "d1", "d2", "margin", "certainty", "contested")
