"""Dimension reduction, intrinsic dimension, topology-aware squeeze."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from latentlake.catalog.base import D, E, long_form, query, r, states
from latentlake.catalog.pairwork import LANDMARKS, NEAR, PATHS, spread
from latentlake.functions import vec
from latentlake.operators import graph, landmarks, pairs, reduction
from latentlake.plans.runtime import materialize
from latentlake.sources import generators

K = 8


@query("d1_pca_variance")
def _(spark, sf):
    """Share of variance per component; the variance of the squeezed columns must agree with it."""
    df = states(spark, sf)
    p = reduction.fit_pca(df, "x", K)
    ratios = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(p.ratio)], "component int, ratio double")
    total = df.select(F.posexplode(vec.doubles("x")).alias("i", "v")).groupBy("i").agg(F.var_samp("v").alias("v")).agg(F.sum("v").alias("v"))
    z = long_form(reduction.squeeze(df, "x", p), ["vec_id"], "z").groupBy(F.col("i").alias("component")).agg(
        F.avg("v").alias("mean"), (F.var_samp("v") / total.scalar()).alias("measured"))
    return ratios.join(z, "component")


def literal(m) -> str:
    """A matrix as a SQL list of rows."""
    return "[" + ", ".join("[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in row) + "]" for row in m) + "]"


SEEDED = reduction.random_projection(D, 16)
THERE_AND_BACK = SEEDED.components.T @ np.linalg.pinv(SEEDED.components).T  # rows times this: squeezed and unsqueezed


@query("d1_spectrum_moments", f"""WITH {E}, v AS (SELECT vec_id, i, x[i] AS v FROM e, unnest(range(1, {D + 1})) t(i)),
    c AS (SELECT a.i, b.i AS j, covar_samp(a.v, b.v) AS c FROM v a JOIN v b USING (vec_id) GROUP BY a.i, b.i)
    SELECT {r('sum(c) FILTER (i = j)', 'total')}, {r('sqrt(sum(c * c))', 'norm')} FROM c""")
def _(spark, sf):
    """The variances along all directions add up to the trace of the covariance, their squares to that of its square."""
    df = states(spark, sf)
    share = reduction.spectrum(df, "x", D).ratio
    total = df.select(F.posexplode(vec.doubles("x")).alias("i", "v")).groupBy("i").agg(F.var_samp("v").alias("v")).agg(F.sum("v").alias("total"))
    return total.select("total", (F.col("total") * float(np.sqrt((share ** 2).sum()))).alias("norm"))


@query("d3_unsqueeze_seeded", f"""WITH {E}, m AS (SELECT {literal(THERE_AND_BACK.T)} AS m)
    SELECT vec_id, {r('list_distance(x, list_transform(m, lambda row: list_dot_product(row, x)))', 'error')} FROM e, m""")
def _(spark, sf):
    """Distance of every row to its way back from 16 seeded directions."""
    df = states(spark, sf).withColumn("o", vec.doubles("x"))
    back = reduction.unsqueeze(reduction.squeeze(df, "x", SEEDED), "z", SEEDED, "x")
    return back.select("vec_id", vec.l2("o", "x").alias("error"))


@query("a13_seeded_error", f"""WITH {E}, m AS (SELECT {literal(THERE_AND_BACK.T)} AS m)
    SELECT {r('avg(list_distance(x, list_transform(m, lambda row: list_dot_product(row, x))))', 'mean_error')} FROM e, m""")
def _(spark, sf):
    return reduction.reconstruction_error(states(spark, sf), "x", SEEDED)


@query("d2_random_projection", f"""WITH {E}, w AS (SELECT {literal(SEEDED.components)} AS w),
    q AS (SELECT label, sqrt(list_sum(list_transform(w, lambda row: list_dot_product(row, x) ** 2))) / sqrt(list_dot_product(x, x)) AS ratio FROM e, w)
    SELECT label, count(*) AS n, {r('avg(ratio)', 'mean_ratio')}, {r('stddev_samp(ratio)', 'std_ratio')} FROM q GROUP BY label""")
def _(spark, sf):
    """Length of projected rows relative to their original length: close to one on average."""
    p = SEEDED
    z = reduction.squeeze(states(spark, sf), "x", p)
    out = z.withColumn("ratio", vec.norm("z") / vec.norm("x"))
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("ratio").alias("mean_ratio"), F.stddev("ratio").alias("std_ratio"))


@query("d3_unsqueeze")
def _(spark, sf):
    """Distance of every row to its reconstruction from K components; squeezing that again must give the same z."""
    df = states(spark, sf)
    p = reduction.fit_pca(df, "x", K)
    z = reduction.squeeze(df.withColumn("o", vec.doubles("x")), "x", p)
    back = reduction.squeeze(reduction.unsqueeze(z, "z", p, "x"), "x", p, "again")
    return back.select("vec_id", vec.l2("o", "x").alias("error"), (vec.l2("z", "again") < 1e-9).alias("stable"))


@query("d4_compression_ratio", f"WITH {E} SELECT vec_id, len(x) / 16.0::DOUBLE AS ratio FROM e")
def _(spark, sf):
    return states(spark, sf).select("vec_id", F.lit(SEEDED.compression).alias("ratio"))


@query("d5_cascade")
def _(spark, sf):
    """Levels 64, 32, 16, 8: rows, share of the previous level's variance kept, mean length of the rows."""
    long, ratios = reduction.cascade(states(spark, sf), "vec_id", "x", levels=4)
    rows = long.groupBy("level", "dim").agg(F.count(F.lit(1)).alias("n"), F.avg(vec.norm("z")).alias("mean_norm"))
    kept = ratios.groupBy("level").agg(F.sum("ratio").alias("kept"))
    return rows.join(kept, "level", "left")


LEVELS = "l AS (SELECT level::BIGINT AS level, dim::BIGINT AS dim FROM (VALUES (0, 64), (1, 32), (2, 16), (3, 8)) v(level, dim))"


@query("d6_cascade_single", f"WITH {E}, {LEVELS} SELECT vec_id, level, dim, round(list_sum(x[1:dim]), 6) + 0.0 AS total FROM e, l")
def _(spark, sf):
    out = reduction.cascade_single(states(spark, sf), "vec_id", "x", 64, levels=4)
    return out.select("vec_id", "level", "dim", vec.total("z").alias("total"))


@query("d7_intrinsic_dimension")
def _(spark, sf):
    """Rows of the table moved onto a noisy 4-dimensional subspace of 16: the known answer is 4."""
    return reduction.intrinsic_dimension(generators.low_rank(states(spark, sf), "vec_id", noise=0.01), "x")


@query("d7_table_dimension")
def _(spark, sf):
    return reduction.intrinsic_dimension(states(spark, sf), "x")


@query("a13_reconstruction_error")
def _(spark, sf):
    df = states(spark, sf)
    full = reduction.spectrum(df, "x", 32)
    out = [reduction.reconstruction_error(df, "x", full.first(k)).withColumn("k", F.lit(k)) for k in (2, 8, 32)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("d9_landmark_paths", f"""WITH RECURSIVE {NEAR}, {spread(LANDMARKS)}, {PATHS.format(sources='marks')}
    SELECT node AS vec_id, count(*) AS n, {r('min(d)', 'nearest')}, {r('max(d)', 'farthest')}, {r('sum(d)', 'total')} FROM g GROUP BY node""")
def _(spark, sf):
    """Path lengths from the landmarks to every row: what the embedding places rows by."""
    df = states(spark, sf)
    far = graph.geodesics(pairs.neighbour_graph(df, "vec_id", "x"), landmarks.farthest_first(df, "vec_id", "x", LANDMARKS).ids)
    return far.groupBy(F.col("node").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("nearest"), F.max("d").alias("farthest"), F.sum("d").alias("total"))


@query("d9_landmark_embedding")
def _(spark, sf):
    """Coordinates from the path lengths to landmarks."""
    df = states(spark, sf)
    marks = landmarks.farthest_first(df, "vec_id", "x", LANDMARKS)
    far = graph.geodesics(pairs.neighbour_graph(df, "vec_id", "x"), marks.ids)
    placed = reduction.landmark_embedding(far, marks.ids, 6, df.select(F.col("vec_id").alias("node")))
    return placed.select(F.col("node").alias("vec_id"), F.size("y").alias("dim"), vec.norm("y").alias("norm"))


@query("d8_topological_squeeze")
def _(spark, sf):
    df = states(spark, sf)
    marks = landmarks.farthest_first(df, "vec_id", "x", LANDMARKS)
    p = reduction.fit_topological(df, "vec_id", "x", pairs.neighbour_graph(df, "vec_id", "x"), marks.ids, 6)
    z = reduction.squeeze(df, "x", p)
    return z.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(vec.norm("z")).alias("mean_norm"),
                                  F.max(F.size("z")).alias("dim"))


@query("d8_normal_equations", f"WITH {E}, k AS (SELECT count(*) AS n FROM e) SELECT i, j, 0.0::DOUBLE AS residual, n FROM k, unnest(range(1, {D + 1})) a(i), unnest(range(1, 7)) b(j)")
def _(spark, sf):
    """The learned map leaves nothing that a component of the rows could still explain: its normal equations hold."""
    df = states(spark, sf)
    marks = landmarks.farthest_first(df, "vec_id", "x", LANDMARKS)
    far = graph.geodesics(pairs.neighbour_graph(df, "vec_id", "x"), marks.ids)
    placed = reduction.landmark_embedding(far, marks.ids, 6, df.select(F.col("vec_id").alias("node")))
    both = df.select(F.col("vec_id").alias("node"), vec.doubles("x").alias("x")).join(placed, "node")
    mean = np.array(both.agg(vec.mean_vector("x")).first()[0])
    p = reduction.Projection(mean, reduction.least_squares(both, "x", "y", mean))
    left = reduction.squeeze(both, "x", p).withColumns({"c": vec.sub("x", vec.vec_literal(mean)), "gap": vec.sub("z", "y")})
    long = left.select(F.posexplode("c").alias("i", "c"), "gap").select("i", "c", F.posexplode("gap").alias("j", "gap"))
    return long.groupBy((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j")).agg(F.sum(F.col("c") * F.col("gap")).alias("residual"), F.count(F.lit(1)).alias("n"))


@query("g6_diagnostics")
def _(spark, sf):
    """Diagnostics of the map learned from path lengths."""
    df = states(spark, sf).select("vec_id", "x")  # as stored: half of what doubles would ship
    near = materialize(pairs.nearest_neighbours(df, "vec_id", "x"))
    edges = pairs.both_ways(near)
    p = reduction.fit_topological(df, "vec_id", "x", edges, landmarks.farthest_first(df, "vec_id", "x", LANDMARKS).ids, 16)
    return reduction.diagnose(reduction.squeeze(df, "x", p), "vec_id", "x", "z", edges, pairs.concentration(pairs.local_density(near)))
