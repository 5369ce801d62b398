"""Dimension reduction: principal components, random projection, halving cascade, intrinsic dimension, landmark embedding.

Fits need only sums over the rows (a d x d matrix, d at most 1024), which tasks build and Spark adds up; the small
eigenproblem is solved once. Rows are projected batch by batch with one matrix product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latentlake.functions.vec import EPS, doubles, l2, mean_vector, truncate
from latentlake.operators import moments
from latentlake.operators.forest import divergence, filtration
from latentlake.operators.graph import geodesics, minimum_forest
from latentlake.operators.kernels import matrix, vectors
from latentlake.operators.paths import path_profile
from latentlake.plans.runtime import materialize


@dataclass
class Projection:
    """Rows are centred with ``mean`` and multiplied with ``components`` (k x d). ``ratio``: share of variance."""

    mean: np.ndarray
    components: np.ndarray
    ratio: np.ndarray | None = None

    @property
    def compression(self) -> float:
        return self.components.shape[1] / self.components.shape[0]

    def first(self, k: int) -> "Projection":
        return Projection(self.mean, self.components[:k], None if self.ratio is None else self.ratio[:k])


def _dimension(df: DataFrame, x: str) -> int:
    return df.select(F.size(x)).first()[0]


def identity(d: int) -> Projection:
    return Projection(np.zeros(d), np.eye(d))


def fit_pca(df: DataFrame, x: str, k: int) -> Projection:
    """The k directions of largest variance; with k >= d rows are left as they are."""
    d = _dimension(df, x)
    return identity(d) if k >= d else spectrum(df, x, k)


def spectrum(df: DataFrame, x: str, k: int) -> Projection:
    """k directions by falling variance, also for k = d."""
    n, mean, values, axes = moments.spectrum(df, x)
    if n < 2:
        return Projection(np.zeros(len(mean)), np.eye(k, len(mean)), np.full(k, 1.0 / k))
    ratio = values[:k] / values.sum() if values.sum() > 0 else np.full(k, 1.0 / k)
    return Projection(mean, axes[:k], ratio)


def random_projection(d: int, k: int, seed: int = 42) -> Projection:
    """Gaussian directions scaled so that distances keep their expected length."""
    return identity(d) if k >= d else Projection(np.zeros(d), np.random.default_rng(seed).standard_normal((k, d)) / np.sqrt(k))


def _apply(df: DataFrame, x: str, fn, name: str) -> DataFrame:
    kept = [f for f in df.schema.fields if f.name != name]
    schema = T.StructType([*kept, T.StructField(name, T.ArrayType(T.DoubleType()))])
    keep = [f.name for f in kept]

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], vectors(fn(matrix(b.column(x))))], names=schema.names)

    return df.mapInArrow(run, schema)


def squeeze(df: DataFrame, x: str, p: Projection, name: str = "z") -> DataFrame:
    mean, w = p.mean, p.components
    return _apply(df, x, lambda m: (m - mean) @ w.T, name)


def unsqueeze(df: DataFrame, z: str, p: Projection, name: str = "x") -> DataFrame:
    """Least-squares way back to the full space."""
    mean, back = p.mean, np.linalg.pinv(p.components)
    return _apply(df, z, lambda m: m @ back.T + mean, name)


def cascade_dims(d: int, levels: int, min_dim: int = 1) -> list[int]:
    """Dimension of every level: halved each time, never below min_dim; a level that cannot shrink repeats."""
    out = [d]
    for _ in range(1, levels):
        out.append(min(out[-1], max(min_dim, out[-1] // 2)))
    return out


def cascade(df: DataFrame, vec_id: str, x: str, levels: int = 3, min_dim: int = 1) -> tuple[DataFrame, DataFrame]:
    """Repeated halving by principal components: (level, dim, vec_id, z) and (level, component, ratio).

    Projected columns are uncorrelated and sorted by variance, so the components of a level are the leading columns of
    the level before: one fit serves all levels, and each level is a slice.
    """
    d = _dimension(df, x)
    dims = cascade_dims(d, levels, min_dim)
    full = spectrum(df, x, d)
    top = dims[1] if len(dims) > 1 and dims[1] < d else d
    rows = squeeze(df.select(vec_id, doubles(x).alias("x")), "x", full.first(top), "_z")
    specs, ratios = [], []
    for level, dim in enumerate(dims):
        source = F.col("x") if level == 0 or dim == d else truncate("_z", dim)
        specs.append(F.struct(F.lit(level).alias("level"), F.lit(dim).alias("dim"), source.alias("z")))
        if level and dim < dims[level - 1]:
            share = full.ratio[:dim] / full.ratio[: dims[level - 1]].sum()
            ratios += [(level, i + 1, float(v)) for i, v in enumerate(share)]
    long = rows.select(vec_id, F.inline(F.array(*specs))).select("level", "dim", vec_id, "z")
    return long, df.sparkSession.createDataFrame(ratios, "level int, component int, ratio double")


def cascade_single(df: DataFrame, vec_id: str, x: str, d: int, levels: int = 3, min_dim: int = 1) -> DataFrame:
    """Levels of single vectors by truncation: (vec_id, level, dim, z)."""
    specs = [F.struct(F.lit(i).alias("level"), F.lit(k).alias("dim"), truncate(doubles(x), k).alias("z"))
             for i, k in enumerate(cascade_dims(d, levels, min_dim))]
    return df.select(vec_id, F.inline(F.array(*specs)))


def reconstruction_error(df: DataFrame, x: str, p: Projection) -> DataFrame:
    back = unsqueeze(squeeze(df.select(doubles(x).alias("_x")), "_x", p, "_z"), "_z", p, "_back")
    return back.agg(F.avg(l2("_x", "_back")).alias("mean_error"))


def intrinsic_dimension(df: DataFrame, x: str, share: float = 0.95, max_error: float = 0.1) -> DataFrame:
    """One row: smallest k reaching the share of variance, and smallest even k (2, 4, ..) whose mean error is below
    max_error, else d.

    One fit at full dimension; the errors of all k come from the tails of each projected row in one further pass.
    """
    d = _dimension(df, x)
    p = spectrum(df, x, d)
    mean, w = p.mean, p.components
    tails = _apply(df.select(doubles(x).alias("_x")), "_x",
                   lambda m: np.sqrt(np.cumsum((((m - mean) @ w.T) ** 2)[:, ::-1], axis=1)[:, ::-1]), "_t")
    errors = [*tails.agg(vector_to_array(Summarizer.mean(array_to_vector("_t")))).first()[0], 0.0]
    by_share = int(np.searchsorted(np.cumsum(p.ratio), share)) + 1
    by_error = next((k for k in range(2, d, 2) if errors[k] < max_error), d)
    return df.sparkSession.createDataFrame([(d, min(by_share, d), by_error)], "d int, dim_by_variance int, dim_by_error int")


# --- landmark embedding and the linear map learned from it ------------------------------------------------------------


def landmark_embedding(far: DataFrame, sources: list[int], k: int, nodes: DataFrame | None = None) -> DataFrame:
    """(node, y): coordinates from path lengths to a few sources (source, node, d), for all ``nodes`` (node) if given.

    The sources are embedded by classical scaling of their own distances; every other node is placed by its distances to
    them. Unreachable counts as twice the longest path; directions of negative spread are zero.
    """
    far = materialize(far)
    top = 2.0 * (far.agg(F.max("d")).first()[0] or 0.5)
    at = {s: i for i, s in enumerate(sources)}
    between = np.full((len(sources),) * 2, top)
    for r in far.where(F.col("node").isin(*sources)).collect():  # at most sources squared
        between[at[r["source"]], at[r["node"]]] = r["d"]
    sq = np.minimum(between, between.T) ** 2
    centred = -0.5 * (sq - sq.mean(0) - sq.mean(1)[:, None] + sq.mean())
    values, axes = np.linalg.eigh(centred)
    order = np.argsort(values)[::-1][:k]
    values, axes = np.maximum(values[order], 0.0), axes[:, order]
    root = np.sqrt(values)
    real = root > 1e-6 * max(root.max(), 1e-12)  # directions without spread carry only rounding noise
    place = np.where(real, axes / np.where(real, root, 1.0), 0.0)
    if place.shape[1] < k:
        place = np.hstack([place, np.zeros((len(sources), k - place.shape[1]))])
    mean = sq.mean(0)
    index = F.create_map(*[v for s, i in at.items() for v in (F.lit(s), F.lit(i))])
    spots = far.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct(index[F.col("source")].alias("i"), "d"))).alias("m"))
    if nodes is not None:  # a node that no source reaches is placed as well
        spots = nodes.select("node").join(spots, "node", "left")
    full = spots.select("node", F.transform(F.sequence(F.lit(0), F.lit(len(sources) - 1)),
                                            lambda i: F.coalesce(F.try_element_at("m", i), F.lit(top))).alias("_d"))
    return _apply(full, "_d", lambda m: -0.5 * (m ** 2 - mean) @ place, "y").select("node", "y")


def least_squares(df: DataFrame, x: str, y: str, mean: np.ndarray) -> np.ndarray:
    """P (k x d) minimising |(x - mean) P' - y|: tasks send d partial rows of the normal equations, d^2 is solved once."""
    d = len(mean)

    def part(m, goal):
        c = m - mean
        return c.T @ np.hstack([c, goal])

    eq = moments.summed(df, [x, y], part)
    return np.linalg.lstsq(eq[:, :d], eq[:, d:], rcond=None)[0].T


def fit_topological(df: DataFrame, vec_id: str, x: str, edges: DataFrame, sources: list[int], k: int) -> Projection:
    """Linear map to k dimensions that follows path lengths over a neighbour graph."""
    d = _dimension(df, x)
    if k >= d:
        return identity(d)
    placed = landmark_embedding(geodesics(edges, sources), sources, k, df.select(F.col(vec_id).alias("node")))
    mean = np.array(df.agg(mean_vector(x)).first()[0])
    both = df.select(F.col(vec_id).alias("node"), doubles(x).alias("x")).join(placed, "node")
    return Projection(mean, least_squares(both, "x", "y", mean))


def diagnose(df: DataFrame, vec_id: str, x: str, z: str, edges: DataFrame, concentration: DataFrame) -> DataFrame:
    """One row on how well z keeps the shape of x: divergence over 20 thresholds, path distortion, component and cycle
    counts at half the range, Euler characteristic at five thresholds, density concentration, compression.

    The shape of x is that of the path lengths over its neighbour graph, between all rows; rows within a path length are
    connected exactly if edges up to that length connect them, so components come from the graph's spanning forest.
    """
    wide = [0.01 + 0.99 * i / 19 for i in range(19)] + [1.0]
    few = [0.1 + 0.7 * i / 4 for i in range(4)] + [0.8]
    levels = sorted({*wide, *few, 0.5})
    n = df.count()
    path = path_profile(edges, df, vec_id, z, levels)
    share = F.least(F.col("d") / max(path.longest, EPS), F.lit(1.0))
    tree = minimum_forest(edges.where("a < b").select("a", "b", "d"))
    joined = tree.select(*[F.count_if(share <= v).alias(f"c{i}") for i, v in enumerate(levels)]).first()
    parts = [n - joined[i] for i in range(len(levels))]
    there = df.sparkSession.createDataFrame(
        [("paths", float(v), parts[i], path.counts[i], max(0, path.counts[i] - n + parts[i])) for i, v in enumerate(levels)],
        "x string, alpha double, components long, edges long, cycles long")
    profile = materialize(filtration(df, vec_id, [z], levels).unionByName(there))
    score = divergence(profile.where(F.round("alpha", 9).isin(*[round(a, 9) for a in wide])), "paths", z)
    a = profile.where(F.col("x") == "paths").select("alpha", F.col("components").alias("ca"), F.col("cycles").alias("ya"))
    b = profile.where(F.col("x") == z).select("alpha", F.col("components").alias("cb"), F.col("cycles").alias("yb"))
    half = F.col("alpha") == 0.5
    kept = a.join(b, "alpha").agg(
        F.bool_and(F.when(half, F.col("ca") == F.col("cb"))).alias("components_kept"),
        F.bool_and(F.when(half, F.col("ya") == F.col("yb"))).alias("cycles_kept"),
        F.bool_and(F.when(F.round("alpha", 9).isin(*[round(v, 9) for v in few]), F.abs(
            (F.col("ca") - F.col("ya")) - (F.col("cb") - F.col("yb"))) <= 1)).alias("euler_kept"))
    dims = df.select(F.size(x).alias("original_dim"), F.size(z).alias("target_dim")).limit(1)
    return dims.select(
        score.select("divergence").scalar().alias("divergence"), F.lit(path.distortion).alias("distortion"),
        *[kept.select(c).scalar().alias(c) for c in ("components_kept", "cycles_kept", "euler_kept")],
        concentration.select("concentration").scalar().alias("concentration"),
        (F.col("original_dim") / F.col("target_dim")).alias("compression"), "original_dim", "target_dim")
