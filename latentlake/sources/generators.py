"""Seeded values that depend on row keys only: the same rows get the same values under any partitioning or retry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentlake.functions.vec import add, c
from latentlake.operators.routes import encode_ranks


def uniform01(seed: int, *keys) -> Column:
    """Uniform in [0, 1) from a hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[c(k) for k in keys]), 11).cast("double") / float(1 << 53)


def gaussian(seed: int, *keys) -> Column:
    """Standard normal from two hashed uniforms."""
    u, v = uniform01(seed, *keys), uniform01(seed + 1_000_003, *keys)
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * math.pi * v)


def gaussian_vector(d: int, seed: int, *keys) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(d)), lambda i: gaussian(seed, *[c(k) for k in keys], i))


def random_candidates(df: DataFrame, keys: list[str], d: int, seed: int = 42, scale: float = 1.0, name: str = "x") -> DataFrame:
    """Normal vectors times scale, clipped to [-1, 1], one per row."""
    v = gaussian_vector(d, seed, *keys)
    return df.withColumn(name, F.transform(v, lambda a: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), a * scale))))


def random_points(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    return df.withColumns({"px": uniform01(seed, *keys, F.lit("x")), "py": uniform01(seed, *keys, F.lit("y"))})


def random_orders(df: DataFrame, route: list[str], item: str, n_candidates: int, seed: int = 42) -> DataFrame:
    """Random visiting orders as ranks in [0, 1]: (route, cand, item, rank_value)."""
    rows = df.select(*route, item, F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1))).alias("cand"))
    rows = rows.withColumn("_o", F.xxhash64(F.lit(seed), *route, "cand", item))
    return encode_ranks(rows, [*route, "cand"], ["_o", item]).drop("_o")


def clustered(df: DataFrame, vec_id: str, d: int = 32, seed: int = 42) -> DataFrame:
    """Points of a two-level cluster tree: 3 centres (spread 2), 3 sub-centres each (0.5), points around them (0.1)."""
    sub = F.pmod(F.xxhash64(F.lit(seed), vec_id), F.lit(9)).cast("int")
    out = df.select(vec_id, sub.alias("label_l1")).withColumn("label_l0", F.floor(F.col("label_l1") / 3).cast("int"))
    spread = lambda s, f, key: F.transform(gaussian_vector(d, s, key), lambda v: v * f)
    return out.withColumn("x", add(add(spread(seed, 2.0, "label_l0"), spread(seed + 1, 0.5, "label_l1")), spread(seed + 2, 0.1, vec_id)))


def low_rank(df: DataFrame, vec_id: str, d: int = 16, intrinsic: int = 4, noise: float = 0.05, seed: int = 42) -> DataFrame:
    """Points of a random intrinsic-dimensional subspace with a little noise."""
    z = F.col("_z")
    out = df.select(vec_id).withColumn("_z", gaussian_vector(intrinsic, seed, vec_id))
    mixed = F.transform(F.sequence(F.lit(1), F.lit(d)), lambda i: F.aggregate(
        F.transform(z, lambda v, j: v * gaussian(seed + 7, i, j)), F.lit(0.0), lambda s, v: s + v))
    eps = F.transform(gaussian_vector(d, seed + 9, vec_id), lambda v: v * noise)
    return out.withColumn("x", add(mixed, eps)).drop("_z")
