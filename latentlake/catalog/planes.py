"""Fitted projections on vectors whose principal components SQL can state.

Every row's 64 values are added up by halves to (a, b) and lifted to eight dimensions, so that the rows fill a plane: two
variances, which are the eigenvalues of a 2 x 2 matrix, and six times none.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from latentlake.catalog.base import D, E, query, r, states
from latentlake.functions import vec
from latentlake.operators import reduction, spectra
from latentlake.operators.weights import centroids
from latentlake.plans import jobs
from latentlake.plans.runtime import scratch_path

LIFT = ((1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, -1.0), (2.0, 0.0), (0.0, -1.0), (0.5, 0.5), (1.0, 2.0))
AA, AB, BB = (sum(u[i] * u[j] for u in LIFT) for i, j in ((0, 0), (0, 1), (1, 1)))
WIDE = len(LIFT)


def lifted(spark, sf):
    """(vec_id, label, x): the rows on the plane."""
    half = D // 2
    a, b = vec.total(F.slice(vec.doubles("x"), 1, half)), vec.total(F.slice(vec.doubles("x"), half + 1, half))
    rows = states(spark, sf).select("vec_id", "label", a.alias("a"), b.alias("b"))
    return rows.select("vec_id", "label", F.array(*[F.col("a") * u + F.col("b") * v for u, v in LIFT]).alias("x"))


# p: rows; c: their covariance; v: the larger variance (l1) and all (l1 + l2) on the lifted rows; u: (wa, wb), whose lift is
# the first direction, of length wn; k: per row its squared length around the mean (c2) and its place along the direction (z1)
PLANE = f"""{E}, h AS (SELECT vec_id, label, list_sum(x[1:{D // 2}]) AS a, list_sum(x[{D // 2 + 1}:{D}]) AS b FROM e),
    m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS saa, covar_samp(a, b) AS sab, var_samp(b) AS sbb FROM h),
    t AS (SELECT *, saa * {AA} + sab * {AB} AS p11, saa * {AB} + sab * {BB} AS p12, sab * {AA} + sbb * {AB} AS p21, sab * {AB} + sbb * {BB} AS p22 FROM m),
    v AS (SELECT *, p11 + p22 AS whole, (p11 + p22 + sqrt(pow(p11 - p22, 2) + 4 * p12 * p21)) / 2 AS l1 FROM t),
    u AS (SELECT *, p12 AS wa, l1 - p11 AS wb, sqrt({AA} * p12 * p12 + 2 * {AB} * p12 * (l1 - p11) + {BB} * pow(l1 - p11, 2)) AS wn FROM v),
    k AS (SELECT vec_id, label, a, b, {AA} * pow(a - ma, 2) + 2 * {AB} * (a - ma) * (b - mb) + {BB} * pow(b - mb, 2) AS c2,
        ({AA} * (a - ma) * wa + {AB} * ((a - ma) * wb + (b - mb) * wa) + {BB} * (b - mb) * wb) / wn AS z1, l1 / whole AS share FROM h, u)"""


@query("d1_squeeze_model", f"""WITH {PLANE} SELECT vec_id, {r('abs(z1)', 'along')}, {r('sqrt(greatest(0, c2 - z1 * z1))', 'across')},
    {r('share', 'share')}, 1.0::DOUBLE AS kept FROM k""")
def _(spark, sf):
    """A projection fitted from bounded summaries, saved, loaded again and applied."""
    df, path = lifted(spark, sf), scratch_path(spark, "squeeze")
    spectra.Squeeze(k=2, method="summary", rows=WIDE).fit(df).save(path)
    model = spectra.SqueezeModel.load(path)
    return model.transform(df).select("vec_id", F.abs(F.col("z")[0]).alias("along"), F.abs(F.col("z")[1]).alias("across"),
                                      F.lit(float(model.projection.ratio[0])).alias("share"), F.lit(model.kept[0]).alias("kept"))


@query("d1_summary_bounds", f"""WITH {E}, g AS (SELECT i, var_samp(x[i]) AS v FROM e, unnest(range(1, {D + 1})) t(i) GROUP BY i)
    SELECT true AS in_order, true AS at_least, true AS at_most, {r('sum(v)', 'total')}, (SELECT count(*) FROM e) AS n FROM g""")
def _(spark, sf):
    """What eight directions from a summary of 32 rows keep of the table, measured, lies between the stated bounds."""
    df = states(spark, sf)
    found = spectra.fit(df, "x", 8, rows=32)
    total = df.select(F.posexplode(vec.doubles("x")).alias("i", "v")).groupBy("i").agg(F.var_samp("v").alias("v")).agg(F.sum("v").alias("total"))
    z = reduction.squeeze(df, "x", found.projection).select(F.posexplode("z").alias("i", "z")).groupBy("i").agg(
        F.var_samp("z").alias("v"), F.count(F.lit(1)).alias("n")).agg(F.sum("v").alias("v"), F.max("n").alias("n"))
    kept = F.col("v") / F.col("total")
    return z.withColumn("total", total.scalar()).select(
        F.lit(found.kept_at_least <= found.kept_at_most).alias("in_order"), (kept >= found.kept_at_least - 1e-9).alias("at_least"),
        (kept <= found.kept_at_most + 1e-9).alias("at_most"), "total", "n")


@query("d3_unsqueeze_plane", f"WITH {PLANE} SELECT vec_id, {r('sqrt(greatest(0, c2 - z1 * z1))', 'error')} FROM k")
def _(spark, sf):
    """Distance of every row to its way back from one component."""
    df = lifted(spark, sf).withColumn("o", F.col("x"))
    p = reduction.fit_pca(df, "x", 1)
    return reduction.unsqueeze(reduction.squeeze(df, "x", p), "z", p, "x").select("vec_id", vec.l2("o", "x").alias("error"))


@query("a13_plane_error", f"WITH {PLANE} SELECT {r('avg(sqrt(greatest(0, c2 - z1 * z1)))', 'mean_error')} FROM k")
def _(spark, sf):
    df = lifted(spark, sf)
    return reduction.reconstruction_error(df, "x", reduction.fit_pca(df, "x", 1))


@query("d5_cascade_plane", f"""WITH {PLANE}, l AS (SELECT * FROM (VALUES (0, 8), (1, 4), (2, 2), (3, 1)) v(level, dim))
    SELECT level::BIGINT AS level, dim::BIGINT AS dim, vec_id, {r(f'''CASE level WHEN 0 THEN sqrt({AA} * a * a + 2 * {AB} * a * b + {BB} * b * b)
        WHEN 3 THEN abs(z1) ELSE sqrt(c2) END''', 'norm')}, {r('CASE level WHEN 0 THEN NULL WHEN 3 THEN share ELSE 1 END', 'kept')} FROM k, l""")
def _(spark, sf):
    """Levels 8, 4, 2, 1: length of every row and share of the level before that is kept."""
    long, ratios = reduction.cascade(lifted(spark, sf), "vec_id", "x", levels=4)
    kept = ratios.groupBy("level").agg(F.sum("ratio").alias("kept"))
    return long.select("level", "dim", "vec_id", vec.norm("z").alias("norm")).join(F.broadcast(kept), "level", "left")  # a row per level


@query("d7_plane_dimension", f"""WITH {PLANE} SELECT {WIDE}::BIGINT AS d, CASE WHEN max(share) >= 0.95 THEN 1 ELSE 2 END::BIGINT AS dim_by_variance,
    2::BIGINT AS dim_by_error FROM k""")
def _(spark, sf):
    return reduction.intrinsic_dimension(lifted(spark, sf), "x")


FLOWN = f"""{PLANE}, q AS (SELECT label, avg(a) AS qa, avg(b) AS qb FROM h GROUP BY label),
    w AS (SELECT label, qa, qb, ({AA} * (qa - ma) * wa + {AB} * ((qa - ma) * wb + (qb - mb) * wa) + {BB} * (qb - mb) * wb) / wn AS zq,
        {AA} * pow(qa - ma, 2) + 2 * {AB} * (qa - ma) * (qb - mb) + {BB} * pow(qb - mb, 2) AS q2 FROM q, u),
    g AS (SELECT k.*, zq, q2, abs(z1 - zq) AS r0, CASE WHEN abs(z1 - zq) < 1e-3 THEN 1 ELSE greatest(1, floor((abs(z1 - zq) - 1e-3) / 0.1) + 1) END::BIGINT AS steps
        FROM k JOIN w USING (label)),
    f AS (SELECT *, greatest(0.0, r0 - steps * 0.1) AS rf FROM g),
    x AS (SELECT *, exp(min(rf) OVER (PARTITION BY label) - rf) AS ew FROM f),
    y AS (SELECT *, ew / sum(ew) OVER (PARTITION BY label) AS w FROM x)"""


@query("l1_evaluate_squeezed_plane", f"""WITH {FLOWN} SELECT label, count(*) AS n_candidates, sum(steps)::BIGINT AS total_steps, count(*) AS converged_count,
    0::BIGINT AS fold_corrections, {r('-sum(w * log2(w))', 'entropy')}, {r('''1 - sqrt(greatest(0, max(q2) - max(zq) * max(zq))
        + pow(min(rf), 2)) / 2.0''', 'quality')} FROM y GROUP BY label""")
def _(spark, sf):
    """Relaxed along one component and brought back: the quality sees what the component does not."""
    df = lifted(spark, sf)
    out = jobs.evaluate(df, centroids(df, "label"), squeeze_to=1, field="normalize", tau=2.0)
    return out.select("label", "n_candidates", "total_steps", "converged_count", "fold_corrections", "entropy", "quality")


@query("l3_full_plane", f"""WITH {FLOWN}, o AS (SELECT label, min(zq) AS zq, min(rf) AS rf, arg_min(vec_id, struct_pack(a := rf, b := vec_id)) AS vec_id FROM y GROUP BY label)
    SELECT vec_id, 0::BIGINT AS level, 1::BIGINT AS dim, {r('abs(o.zq + (k.z1 - o.zq) * rf / greatest(abs(k.z1 - o.zq), 1e-12))', 'place')} FROM o JOIN k USING (vec_id)""")
def _(spark, sf):
    """The whole recipe on one component: per label the row that ends nearest to its target, and where that is."""
    df = lifted(spark, sf)
    out = jobs.full(df, centroids(df, "label"), k=1, levels=1)
    return out.select("vec_id", "level", "dim", F.abs(F.col("z")[0]).alias("place"))
