"""Weighted candidate sets: many groups in one table, columns (group, id, vector, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentlake.functions.vec import mean_vector
from latentlake.operators.ordered import numbered, top_rows
from latentlake.plans.runtime import join_groups, materialize


def uniform(df: DataFrame, group: str, w: str = "w") -> DataFrame:
    sizes = df.groupBy(group).agg((F.lit(1.0) / F.count(F.lit(1))).alias(w))
    return join_groups(df, sizes, group)


def normalize(df: DataFrame, group: str, w: str = "w") -> DataFrame:
    """Weights scaled to sum to one per group."""
    sums = df.groupBy(group).agg(F.sum(w).alias("_sum"))
    return join_groups(df, sums, group).withColumn(w, F.col(w) / F.col("_sum")).drop("_sum")


SAFE_EXPONENT = 600.0
KEPT_PER_TASK = 1_000_000


def softmax(df: DataFrame, group: str, d: str, w: str = "w") -> DataFrame:
    """Weights from distances: closer rows weigh more.

    One aggregation serves all groups whose best distance is small enough for plain exponentials. Only if some group
    lies farther out, weights are shifted by the group's best distance first, which takes a second one.
    """
    sums = materialize(df.groupBy(group).agg(F.min(d).alias("_best"), F.sum(F.exp(-F.col(d))).alias("_sum")))
    if (sums.agg(F.max("_best")).first()[0] or 0.0) <= SAFE_EXPONENT:
        return join_groups(df, sums.drop("_best"), group, fixed=True).withColumn(w, F.exp(-F.col(d)) / F.col("_sum")).drop("_sum")
    shifted = join_groups(df, sums.drop("_sum"), group, fixed=True).withColumn(w, F.exp(F.col("_best") - F.col(d)))
    return normalize(shifted.drop("_best"), group, w)


def entropy(w: str = "w"):
    """Aggregate: Shannon entropy in bits; zero weights do not count."""
    return -F.sum(F.when(F.col(w) > 0, F.col(w) * F.log2(w)).otherwise(F.lit(0.0)))


def summary(df: DataFrame, group: str, w: str = "w") -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), entropy(w).alias("entropy"))


def centroids(df: DataFrame, group: str, x: str = "x", w: str | None = None, name: str = "q") -> DataFrame:
    return df.groupBy(group).agg(mean_vector(x, w).alias(name))


def collapse_to_best(df: DataFrame, group: str, vec_id: str, d: str) -> DataFrame:
    """The closest candidate per group; the smallest id wins ties."""
    key = F.struct(F.col(d), F.col(vec_id))
    return df.groupBy(group).agg(F.min(key).alias("_b")).select(
        group, F.col(f"_b.{vec_id}").alias(vec_id), F.col(f"_b.{d}").alias(d))


def prune(df: DataFrame, group: str, vec_id: str, keep: int, w: str = "w") -> DataFrame:
    """Heaviest ``keep`` candidates per group, weights normalised again; smaller groups stay whole."""
    top = top_rows(df, [group], [F.desc(w), F.asc(vec_id)], keep)
    if keep > KEPT_PER_TASK:
        return normalize(top, group, w)
    # at most ``keep`` rows are left per group, already together: their sum needs no further pass over the table
    return top.withColumn(w, F.col(w) / F.sum(w).over(Window.partitionBy(group)))


def reorder(df: DataFrame, group: str, vec_id: str, w: str = "w", name: str = "rank", **kw) -> DataFrame:
    """Position of every candidate by descending weight."""
    return numbered(df.withColumn("_neg", -F.col(w)), [group], ["_neg", vec_id], name, **kw).drop("_neg")


def with_memory(df: DataFrame, memory: DataFrame, vec_id: str) -> DataFrame:
    """Candidates with their memory. The key ties them together, so no reordering or pruning can part them."""
    return df.join(memory, vec_id, "left")
