"""Vector expressions, rules and constraints."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from latentlake.catalog.base import D, E, MEANS, TARGET, exploded, label_means, label_references, long_form, query, r, states, with_target
from latentlake.functions import vec
from latentlake.operators import classify, quality as rules
from latentlake.plans.runtime import join_groups, materialize


@query("p1_norm", f"WITH {E} SELECT vec_id, {r('sqrt(list_dot_product(x, x))', 'norm')} FROM e")
def _(spark, sf):
    return states(spark, sf).select("vec_id", vec.norm("x").alias("norm"))


@query("p2_l2_distance", f"WITH {TARGET} SELECT vec_id, {r('d', 'd')} FROM s")
def _(spark, sf):
    return with_target(spark, sf).select("vec_id", vec.l2("x", "q").alias("d"))


@query("p3_cosine_distance", f"""WITH {TARGET} SELECT vec_id, {r('''CASE WHEN list_dot_product(x, x) < 1e-24
    OR list_dot_product(q, q) < 1e-24 THEN 1.0 ELSE 1.0 - list_dot_product(x, q)
    / sqrt(list_dot_product(x, x) * list_dot_product(q, q)) END''', 'd')} FROM s""")
def _(spark, sf):
    return with_target(spark, sf).select("vec_id", vec.cosine("x", "q").alias("d"))


@query("p4_equivalent", f"WITH {TARGET} SELECT vec_id, d <= 1.0 AS equivalent FROM s")
def _(spark, sf):
    return with_target(spark, sf).select("vec_id", vec.equivalent(vec.l2("x", "q"), 1.0).alias("equivalent"))


@query("p5_quality", f"WITH {TARGET} SELECT vec_id, {r('greatest(0.0, 1 - d / 1.01)', 'quality')} FROM s")
def _(spark, sf):
    return with_target(spark, sf).select("vec_id", vec.quality(vec.l2("x", "q"), 1.01).alias("quality"))


@query("p6_dimension", f"WITH {E} SELECT vec_id, len(x) AS dim FROM e")
def _(spark, sf):
    return states(spark, sf).select("vec_id", vec.dim("x").alias("dim"))


@query("p7_truncate", f"WITH {E} {exploded('e', 'vec_id', 'x', 16)}")
def _(spark, sf):
    return long_form(states(spark, sf).withColumn("x", vec.truncate("x", 16)), ["vec_id"], "x")


def damaged(spark, sf):
    """States in which some first components are made NaN or infinite, so that repair has work to do."""
    v = F.when(F.col("vec_id") % 7 == 0, F.lit(float("nan"))).when(F.col("vec_id") % 11 == 0, F.lit(float("inf"))) \
        .when(F.col("vec_id") % 13 == 0, F.lit(float("-inf")))
    return states(spark, sf).withColumn("x", F.transform(
        vec.doubles("x"), lambda a, i: F.when(i == 0, F.coalesce(v, a)).otherwise(a)))


FIXED = """CASE WHEN vec_id % 7 = 0 THEN 0.0 WHEN vec_id % 11 = 0 THEN 1.0 WHEN vec_id % 13 = 0 THEN -1.0 END"""
BAD = "(vec_id % 7 = 0 OR vec_id % 11 = 0 OR vec_id % 13 = 0)"


@query("p8_repair", f"""WITH {E} SELECT vec_id, i, CASE WHEN {BAD} THEN 'NaN/Inf detected' ELSE 'clean' END AS diagnosis,
    {r(f'CASE WHEN i = 1 THEN coalesce({FIXED}, x[i]) ELSE x[i] END', 'v')}
    FROM e, unnest(range(1, {D + 1})) t(i)""")
def _(spark, sf):
    out = rules.fold_with(damaged(spark, sf), "x", rules.finite_rule("x"))
    return long_form(out, ["vec_id", "diagnosis"], "x")


@query("p9_norm_cap", f"""WITH {E}, g AS (SELECT vec_id, list_transform(x, lambda v: v * (vec_id % 20)) AS x FROM e),
    n AS (SELECT *, sqrt(list_dot_product(x, x)) AS n FROM g)
    SELECT vec_id, i, {r('x[i] * CASE WHEN n > 10 THEN 10 / n ELSE 1 END', 'v')} FROM n, unnest(range(1, {D + 1})) t(i)""")
def _(spark, sf):
    df = states(spark, sf).withColumn("x", vec.scale("x", F.col("vec_id") % 20))
    return long_form(rules.fold_with(df, "x", rules.norm_rule("x", 10.0)), ["vec_id"], "x")


@query("p10_memory_rule", f"""WITH {E}, g AS (SELECT vec_id, list_transform(x, lambda v: v * (vec_id % 20)) AS x,
    list_transform(x, lambda v: v * (vec_id % 90)) AS h FROM e),
    n AS (SELECT *, sqrt(list_dot_product(x, x)) AS n, sqrt(list_dot_product(h, h)) AS m FROM g),
    f AS (SELECT *, CASE WHEN n > 10 THEN 'state norm' WHEN m > 50 THEN 'memory norm' ELSE 'ok' END AS diagnosis,
        CASE WHEN n > 10 THEN 10 / n WHEN m > 50 THEN 0.9 ELSE 1 END AS factor FROM n)
    SELECT vec_id, diagnosis, {r('sqrt(list_dot_product(x, x)) * factor', 'norm')}, {r('x[1] * factor', 'first')} FROM f""")
def _(spark, sf):
    base = states(spark, sf)
    state = base.withColumn("x", vec.scale("x", F.col("vec_id") % 20))
    memory = base.select("vec_id", vec.scale("x", F.col("vec_id") % 90).alias("h"))
    out = rules.fold_with(state.join(memory, "vec_id", "left"), "x", rules.memory_norm_rule("x", "h"))
    return out.select("vec_id", "diagnosis", vec.norm("x").alias("norm"), F.col("x")[0].alias("first"))


@query("p11_audit", f"""WITH {E}, f AS (SELECT vec_id, vec_id % 2 = 0 AS checked, {BAD} AS bad FROM e),
    k AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn FROM f WHERE checked AND bad)
    SELECT vec_id, checked, CASE WHEN checked THEN NOT bad END AS ok,
    CASE WHEN checked THEN CASE WHEN bad THEN 'NaN/Inf detected' ELSE 'clean' END END AS diagnosis,
    coalesce(rn <= 40, false) AS corrected FROM f LEFT JOIN k USING (vec_id)""")
def _(spark, sf):
    out = rules.audit(damaged(spark, sf), "vec_id", "x", rules.finite_rule("x"), interval=2, max_corrections=40)
    return out.select("vec_id", "checked", "ok", "diagnosis", "corrected")


@query("p12_validate", f"""WITH {E}, f AS (SELECT vec_id, label, CASE WHEN vec_id % 9 = 0 THEN 63 ELSE len(x) END AS dim FROM e)
    SELECT label, count(*) FILTER (WHERE dim = 64) AS accepted, count(*) FILTER (WHERE dim <> 64) AS quarantined FROM f GROUP BY label""")
def _(spark, sf):
    d = rules.validate(states(spark, sf), "x")
    mixed = states(spark, sf).withColumn("x", F.when(F.col("vec_id") % 9 == 0, vec.truncate("x", d - 1)).otherwise(F.col("x")))
    good, bad = rules.split_valid(mixed, "x", d)
    return good.withColumn("_g", F.lit(True)).union(bad.withColumn("_g", F.lit(False))).groupBy("label").agg(
        F.count_if("_g").alias("accepted"), F.count_if(~F.col("_g")).alias("quarantined"))


NEXT = f"""{TARGET}, nx AS (SELECT s.*, means.q AS p FROM s JOIN means ON means.label = (s.label + 1) % 10)"""


def with_next(spark, sf):
    """States with their own label's mean q and the next label's mean p."""
    means = materialize(label_means(spark, sf))
    nxt = means.select(((F.col("label") + 9) % 10).alias("label"), F.col("q").alias("p"))
    both = means.join(nxt, "label")
    return join_groups(states(spark, sf), both, "label", row_bytes=16 * 1024)


@query("p13_analogy", f"""WITH {NEXT} SELECT vec_id, i, {r('x[i] - q[i] + p[i]', 'v')} FROM nx, unnest(range(1, {D + 1})) t(i)""")
def _(spark, sf):
    return long_form(with_next(spark, sf).withColumn("x", vec.analogy("x", "q", "p")), ["vec_id"], "x")


@query("p14_interpolate", f"""WITH {TARGET} SELECT vec_id, i, {r('x[i] * 0.75 + q[i] * 0.25', 'v')},
    {r('(x[i] + q[i]) / 2', 'mid')} FROM s, unnest(range(1, {D + 1})) t(i)""")
def _(spark, sf):
    both = F.arrays_zip(vec.interpolate("x", "q", 0.25).alias("v"), vec.interpolate("x", "q", 0.5).alias("mid"))
    df = with_target(spark, sf).select("vec_id", F.posexplode(both).alias("i", "z"))
    return df.select("vec_id", (F.col("i") + 1).alias("i"), F.col("z.v").alias("v"), F.col("z.mid").alias("mid"))


def axis(k: int) -> list[float]:
    return [1.0 if j == k else 0.0 for j in range(D)]


@query("p15_constraints", f"""WITH {MEANS}, m AS (SELECT q FROM means WHERE label = 0), n AS (SELECT q AS o FROM means WHERE label = 1),
    f AS (SELECT vec_id, [list_distance(x, q) <= 0.5 * 2, abs(list_dot_product(x, o)) <= 0.01 * 2,
        sqrt(list_dot_product(x, x)) BETWEEN 0.9 / 2 AND 0.4 * 2,
        sqrt(list_dot_product(x, x) - x[1] * x[1] - x[2] * x[2]) <= 0.49 * 2] AS ok FROM e, m, n)
    SELECT vec_id, ok[1] AS proximity, ok[2] AS orthogonality, ok[3] AS norm_bound, ok[4] AS subspace,
    len(list_filter(ok, lambda v: v)) AS n_satisfied, 4::BIGINT AS n_total FROM f""")
def _(spark, sf):
    refs = label_references(spark, sf)
    specs = [dict(kind="proximity", target=refs.point(0), radius=0.5),
             dict(kind="orthogonality", reference=refs.point(1), tolerance=0.01),
             dict(kind="norm_bound", lower=0.9, upper=0.4),
             dict(kind="subspace", basis=[axis(0), axis(1)], tolerance=0.49)]
    out = rules.check_constraints(states(spark, sf), "x", specs)
    return out.select("vec_id", *[F.col("ok")[i].alias(s["kind"]) for i, s in enumerate(specs)], "n_satisfied", "n_total")


PENALTY = f"""WITH {MEANS} SELECT vec_id, {r('-sum(greatest(0.0, list_distance(x, q) - 1.0))', 'penalty')}
    FROM e, means GROUP BY vec_id"""


@query("p16_soft_penalty", PENALTY)
def _(spark, sf):
    return rules.soft_penalty(states(spark, sf), "x", label_references(spark, sf), 1.0).select("vec_id", "penalty")


@query("p16_penalty_of_many", PENALTY)
def _(spark, sf):
    """The plan for targets that don't fit into every task."""
    out = classify.summed_over_many(states(spark, sf), "vec_id", "x", label_means(spark, sf), "q", lambda d, _: -np.maximum(0.0, d - 1.0))
    return out.withColumnRenamed("total", "penalty")


@query("p17_balance", f"""WITH {MEANS} SELECT vec_id, {r('''-abs(sum(CASE WHEN means.label = 0 THEN list_distance(x, q)
    WHEN means.label = 1 THEN -list_distance(x, q) ELSE 0 END))''', 'balance')},
    {r('avg(list_distance(x, q))', 'mean_distance')} FROM e, means GROUP BY vec_id""")
def _(spark, sf):
    return rules.balance(states(spark, sf), "x", label_references(spark, sf)).select("vec_id", "balance", "mean_distance")


@query("p18_potential", f"""WITH {MEANS}, basin AS (SELECT q, 0.5 + 0.1 * label AS s, 0.4 + 0.05 * label AS w FROM means),
    t AS (SELECT vec_id, x, q, w, s * exp(-pow(list_distance(x, q), 2) / (2 * w * w)) AS e FROM e, basin)
    SELECT vec_id, {r('-sum(e)', 'potential')}, {r('sum(e * (x[1] - q[1]) / (w * w))', 'g_first')},
    {r(f'sum(e * (x[{D}] - q[{D}]) / (w * w))', 'g_last')} FROM t GROUP BY vec_id""")
def _(spark, sf):
    refs = label_references(spark, sf)
    s, w = [0.5 + 0.1 * k for k in refs.keys], [0.4 + 0.05 * k for k in refs.keys]
    out = rules.potential(states(spark, sf), "x", refs, s, w)
    return out.select("vec_id", "potential", F.col("gradient")[0].alias("g_first"), F.col("gradient")[D - 1].alias("g_last"))


@query("p19_subspace_residual", f"""WITH {E} SELECT vec_id, {r('''sqrt(list_dot_product(x, x) - x[1] * x[1] - x[2] * x[2]
    - x[3] * x[3])''', 'residual')}, {r('x[2]', 'coordinate_2')} FROM e""")
def _(spark, sf):
    basis = [axis(0), axis(1), axis(2)]
    return states(spark, sf).select("vec_id", vec.subspace_residual("x", basis).alias("residual"),
                                    vec.project("x", basis)[1].alias("coordinate_2"))
