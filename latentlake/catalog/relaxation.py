"""Relaxation toward targets: fields, step counts, traces, contracts, acceptance gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from latentlake.catalog.base import D, MEANS, TARGET, label_references, query, r, states, with_target
from latentlake.functions import vec
from latentlake.operators import classify, flow

# steps and final distance of the closed-form fields for eps = 0.1, tol = 1e-3, at most 1000 steps
NORMALIZE = f"""{TARGET}, f AS (SELECT *, CASE WHEN d < 1e-3 THEN 1 ELSE greatest(1, floor((d - 1e-3) / 0.1) + 1)::BIGINT END
    AS steps FROM s), z AS (SELECT *, greatest(0.0, d - steps * 0.1) AS r_final FROM f)"""


def relaxed(spark, sf, field="normalize", **kw):
    return flow.relax(with_target(spark, sf), "x", "q", field, **kw)


@query("flagship_label_convergence", f"""WITH {NORMALIZE} SELECT label, count(*) AS n, {r('avg(steps)', 'mean_steps')},
    100.0::DOUBLE AS converged_pct, {r('avg(d)', 'mean_drift')}, {r('avg(r_final)', 'mean_final')} FROM z GROUP BY label""")
def label_convergence(spark, sf):
    """Per label: how far its rows lie from their mean and how many steps they need to reach it."""
    return relaxed(spark, sf, final=False).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("steps").alias("mean_steps"),
        (F.avg(F.col("converged").cast("double")) * 100).alias("converged_pct"), F.avg("r0").alias("mean_drift"),
        F.avg("r_final").alias("mean_final"))


GAIN = {"normalize": "1", "damped": "least(d, 1)", "adaptive": "least(d, 1)", "sin": "sin(d) / greatest(d, 1e-6)",
        "repulsive": "-1"}


@query("f1_fields", f"""WITH {TARGET} SELECT vec_id, i, """ + ", ".join(
    r(f"CASE WHEN d < 1e-12 THEN 0 ELSE ({g}) * (q[i] - x[i]) / d END", f) for f, g in GAIN.items())
    + f" FROM s, unnest(range(1, {D + 1})) t(i)")
def _(spark, sf):
    zipped = F.arrays_zip(*[flow.field_vector(f, "x", "q").alias(f) for f in GAIN])
    df = with_target(spark, sf).select("vec_id", F.posexplode(zipped).alias("i", "z"))
    return df.select("vec_id", (F.col("i") + 1).alias("i"), *[F.col(f"z.{f}").alias(f) for f in GAIN])


@query("f2_normalize", f"""WITH {NORMALIZE} SELECT vec_id, steps, true AS converged, {r('d', 'r0')}, {r('r_final', 'r_final')},
    {r('q[1] + (x[1] - q[1]) * r_final / d', 'first')} FROM z""")
def _(spark, sf):
    return relaxed(spark, sf).select("vec_id", "steps", "converged", "r0", "r_final", F.col("x_final")[0].alias("first"))


# a row three times as far out starts in the linear regime of the damped field and ends in the geometric one
DAMPED = f"""{TARGET}, o AS (SELECT vec_id, label, 3 * d AS r0 FROM s),
    f AS (SELECT *, greatest(0, ceil((r0 - 1) / 0.1)) AS far FROM o),
    g AS (SELECT *, r0 - far * 0.1 AS r1 FROM f),
    h AS (SELECT *, (far + CASE WHEN r1 < 1e-3 THEN 0 ELSE floor(ln(1e-3 / r1) / ln(1 - 0.1)) + 1 END)::BIGINT AS need FROM g),
    z AS (SELECT *, least(need, 1000) AS steps, need <= 1000 AS converged FROM h)"""


def stretched(spark, sf, factor=3.0):
    return with_target(spark, sf).withColumn("x", vec.between("q", "x", F.lit(factor)))


@query("f2_damped", f"""WITH {DAMPED} SELECT vec_id, steps, converged, {r('r0', 'r0')},
    {r('r1 * pow(1 - 0.1, steps - far)', 'r_final')} FROM z""")
def _(spark, sf):
    return flow.relax(stretched(spark, sf), "x", "q", "damped", final=False).select(
        "vec_id", "steps", "converged", "r0", "r_final")


SIN = f"""{TARGET}, o AS (SELECT vec_id, label, (1 + 4 * (label % 2)) * d AS r0 FROM s),
    loop AS (SELECT vec_id, label, 0 AS step, r0 AS r FROM o UNION ALL
      SELECT vec_id, label, step + 1, abs(r - sign(sin(r)) * CASE WHEN least(abs(0.1 * sin(r) / greatest(r, 1e-6)), 1) > r THEN r
        ELSE least(abs(0.1 * sin(r) / greatest(r, 1e-6)), 1) END) FROM loop
      WHERE step < 300 AND (step = 0 OR r >= 1e-3))"""


def waved(spark, sf):
    """Odd labels start five times as far out, where the sin field traps them on a ring."""
    factor = F.lit(1.0) + 4.0 * (F.col("label") % 2)
    return with_target(spark, sf).withColumn("x", vec.between("q", "x", factor))


@query("f2_sin", f"""WITH RECURSIVE {SIN} SELECT vec_id, max(step)::BIGINT AS steps, min(r) FILTER (WHERE step > 0) < 1e-3 AS converged,
    {r('arg_max(r, step)', 'r_final')} FROM loop GROUP BY vec_id""")
def _(spark, sf):
    return flow.relax(waved(spark, sf), "x", "q", "sin", max_steps=300, final=False).select(
        "vec_id", "steps", "converged", "r_final")


@query("f2_repulsive", f"""WITH {TARGET} SELECT vec_id, 100::BIGINT AS steps, false AS converged, {r('d + 100 * 0.1', 'r_final')} FROM s""")
def _(spark, sf):
    return relaxed(spark, sf, "repulsive", max_steps=100, final=False).select("vec_id", "steps", "converged", "r_final")


@query("f3_trace", f"""WITH {NORMALIZE} SELECT vec_id, k AS step, {r('greatest(0.0, d - k * 0.1)', 'drift')}
    FROM z, unnest(range(1, steps + 1)) t(k)""")
def _(spark, sf):
    df = with_target(spark, sf).withColumn("r0", vec.l2("x", "q"))
    return flow.trace(df, ["vec_id"], "r0")


@query("f3_trace_totals", f"""WITH {NORMALIZE} SELECT label, sum(steps)::BIGINT AS total_steps, count(*) AS converged,
    {r('sum(d * steps - 0.1 * steps * (steps + 1) / 2 + greatest(0.0, 0.1 * steps - d))', 'drift_sum')} FROM z GROUP BY label""")
def _(spark, sf):
    """Totals over the long trace: steps taken, rows converged, summed drift."""
    df = with_target(spark, sf).withColumn("r0", vec.l2("x", "q"))
    return flow.trace(df, ["label", "vec_id"], "r0").groupBy("label").agg(
        F.count(F.lit(1)).alias("total_steps"), F.count_if(F.col("drift") < 1e-3).alias("converged"),
        F.sum("drift").alias("drift_sum"))


@query("f4_gradient_descent", f"""WITH {TARGET}, f AS (SELECT vec_id, d, greatest(1, floor(ln(1e-3 / d) / ln(1 - 0.1)) + 1)::BIGINT
    AS steps FROM s) SELECT vec_id, steps, true AS converged, {r('d * pow(1 - 0.1, steps)', 'r_final')} FROM f""")
def _(spark, sf):
    return relaxed(spark, sf, "descent", final=False).select("vec_id", "steps", "converged", "r_final")


RECURSIVE = f"""WITH RECURSIVE {TARGET},
    inn AS (SELECT vec_id, d AS start, 0 AS step, d AS rho FROM s UNION ALL
        SELECT vec_id, start, step + 1, rho - sign(rho) * CASE WHEN abs(rho) < 1e-12 THEN 0 ELSE 0.1 END FROM inn
        WHERE step < 200 AND (step = 0 OR abs(rho) >= 1e-3)),
    mark AS (SELECT vec_id, step, rho, lag(rho, 10) OVER (PARTITION BY vec_id ORDER BY step) AS prev FROM inn),
    stop AS (SELECT vec_id, min(step) FILTER (WHERE step > 0 AND abs(rho) < 1e-3) AS hit,
        min(step) FILTER (WHERE step > 0 AND step % 10 = 0 AND abs(rho - prev) <= 1e-4) AS fix FROM mark GROUP BY vec_id),
    fin AS (SELECT vec_id, CASE WHEN hit IS NOT NULL AND (fix IS NULL OR hit <= fix) THEN 'attractor_reached'
        WHEN fix IS NOT NULL THEN 'fixed_point' ELSE 'timeout' END AS termination,
        CASE WHEN hit IS NOT NULL AND (fix IS NULL OR hit <= fix) THEN hit WHEN fix IS NOT NULL THEN fix ELSE 200 END AS stop_at FROM stop)"""


@query("f5_recursive", f"""{RECURSIVE} SELECT vec_id, termination, ceil(stop_at / 10.0)::BIGINT AS iterations, {r('rho', 'rho')} FROM fin JOIN mark USING (vec_id)
    WHERE mark.step = fin.stop_at""")
def _(spark, sf):
    df = with_target(spark, sf).withColumn("r0", vec.l2("x", "q")).select("vec_id", "r0")
    return flow.recursive(df, "r0", max_iterations=20, inner_steps=10).select("vec_id", "termination", "iterations", "rho")


@query("f5_outer_trace", f"""{RECURSIVE} SELECT vec_id, ceil(step / 10.0)::BIGINT AS round, {r('abs(rho)', 'drift')} FROM fin JOIN mark USING (vec_id)
    WHERE step > 0 AND (step = stop_at OR step < stop_at AND step % 10 = 0)""")
def _(spark, sf):
    """The drift after every outer round."""
    df = with_target(spark, sf).withColumn("r0", vec.l2("x", "q")).select("vec_id", "r0")
    out = flow.recursive(df, "r0", max_iterations=20, inner_steps=10)
    return out.select("vec_id", F.posexplode("trace").alias("i", "rho")).select("vec_id", (F.col("i") + 1).alias("round"), F.abs("rho").alias("drift"))


def coupled_steps(n: int) -> str:
    """SQL: n coupled steps, one after the other."""
    out = ["k0 AS (SELECT label, vec_id, x, q FROM s)"]
    for i in range(n):
        out += [f"""m{i} AS (SELECT *, list_transform(range(1, {D + 1}), lambda i: x[i] + (q[i] - x[i]) * 0.1 / list_distance(x, q)) AS y FROM k{i})""",
                f"""c{i} AS (SELECT label, list(v ORDER BY i) AS c FROM (SELECT label, i, sum(exp(-list_distance(y, q)) * y[i])
                    / sum(exp(-list_distance(y, q))) AS v FROM m{i}, unnest(range(1, {D + 1})) t(i) GROUP BY label, i) GROUP BY label)""",
                f"""k{i + 1} AS (SELECT label, vec_id, list_transform(range(1, {D + 1}), lambda i: y[i] + 0.05 * (c[i] - y[i])) AS x, q
                    FROM m{i} JOIN c{i} USING (label))"""]
    return ", ".join(out)


@query("f6_coupled", f"""WITH {TARGET}, {coupled_steps(5)} SELECT k5.label, count(*) AS n, {r('avg(list_distance(k5.x, k5.q))', 'coupled_drift')},
    {r('avg(greatest(0.0, s.d - 0.5))', 'plain_drift')} FROM k5 JOIN s USING (vec_id) GROUP BY k5.label""")
def _(spark, sf):
    """After coupled steps every label is tighter around its target than the plain relaxation leaves it."""
    out = flow.coupled(with_target(spark, sf), "label", "vec_id", "x", "q", max_steps=5)
    plain = relaxed(spark, sf, max_steps=5, final=False).select("vec_id", "r_final")
    return out.join(plain, "vec_id").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("coupled_drift"), F.avg("r_final").alias("plain_drift"))


@query("f7_competition_flow", f"""WITH RECURSIVE {MEANS}, al AS (SELECT list(q ORDER BY label) AS a FROM means),
    loop AS (SELECT vec_id, 0 AS step, x, list_transform(a, lambda p: list_distance(x, p)) AS ds FROM e, al UNION ALL
        SELECT vec_id, step + 1, y, list_transform(a, lambda p: list_distance(y, p)) FROM (
            SELECT vec_id, step, a, list_transform(range(1, {D + 1}), lambda i: x[i] + 0.1 * list_sum(list_transform(range(1, 11),
                lambda k: (a[k][i] - x[i]) / ds[k])) / 10) AS y FROM loop, al WHERE step < 25 AND list_min(ds) >= 0.01)),
    f AS (SELECT vec_id, max(step)::BIGINT AS steps, arg_max(ds, step) AS ds FROM loop GROUP BY vec_id),
    v AS (SELECT vec_id, steps, (list_position(ds, list_min(ds)) - 1)::BIGINT AS winner, list_sort(ds)[1] AS d1, list_sort(ds)[2] AS d2 FROM f)
    SELECT vec_id, winner, {r('d1', 'd1')}, {r('d2 - d1', 'margin')}, {r('greatest(0.0, 1 - d1 / d2)', 'certainty')}, d2 - d1 < 0.01 AS contested, steps FROM v""")
def _(spark, sf):
    out = classify.compete(states(spark, sf), "x", label_references(spark, sf), max_steps=25)
    return out.select("vec_id", "winner", "d1", "margin", "certainty", "contested", "steps")


@query("u1_user_flow", f"""WITH {NORMALIZE} SELECT vec_id, steps, true AS converged,
    {r('q[1] + (x[1] - q[1]) * r_final / d', 'first')} FROM z""")
def _(spark, sf):
    """A field written by the user in matrix form; here it equals the built-in normalize field."""
    import numpy as np

    def pull(x, q):
        diff = q - x
        return diff / np.maximum(np.sqrt((diff * diff).sum(1, keepdims=True)), 1e-12)

    out = flow.flow_with(with_target(spark, sf), "x", "q", pull)
    return out.select("vec_id", "steps", "converged", F.col("x_final")[0].alias("first"))


CONTRACT = f"""{NORMALIZE}, runs AS (
    SELECT vec_id, 'normalize' AS field, steps <= 10 AS converged FROM z UNION ALL
    SELECT vec_id, 'repulsive', false FROM s UNION ALL SELECT vec_id, 'custom', false FROM s)"""


@query("f8_user_contracts", f"""WITH {CONTRACT} SELECT field, CASE field WHEN 'custom' THEN 1 ELSE 3 END::BIGINT AS tier, CASE field WHEN 'custom' THEN 0.5 END::DOUBLE AS lipschitz_bound,
    count(*) AS n, count(*) FILTER (WHERE NOT (field = 'custom' AND NOT converged)) AS honored FROM runs WHERE field <> 'normalize' GROUP BY field""")
def _(spark, sf):
    """A contract that the user declares for a field of their own, next to the built-in ones."""
    p = relaxed(spark, sf, "repulsive", max_steps=10, final=False).select("vec_id", "steps", "converged", "r_final")
    runs = p.withColumn("field", F.lit("repulsive")).unionByName(p.withColumn("field", F.lit("custom")))
    own = flow.contracts(spark, [("custom", 1, 0.5, "declared for the test")])
    return flow.check_contract(runs, known=own).groupBy("field", "tier", "lipschitz_bound").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("tier_honored").alias("honored"))


@query("f8_contracts", f"""WITH {CONTRACT} SELECT field, CASE field WHEN 'normalize' THEN 1 WHEN 'repulsive' THEN 3 ELSE 2 END::BIGINT AS tier,
    count(*) AS n, count(*) FILTER (WHERE NOT (field = 'normalize' AND NOT converged)) AS honored,
    count(*) FILTER (WHERE (field = 'normalize' AND NOT converged) OR (field = 'repulsive' AND NOT converged)) AS signals FROM runs GROUP BY field""")
def _(spark, sf):
    """Ten steps are too few for some rows: the provable contract of normalize is broken there."""
    cols = ["vec_id", "steps", "converged", "r_final"]
    n = relaxed(spark, sf, "normalize", max_steps=10, final=False).select(*cols).withColumn("field", F.lit("normalize"))
    p = relaxed(spark, sf, "repulsive", max_steps=10, final=False).select(*cols)
    runs = n.unionByName(p.withColumn("field", F.lit("repulsive"))).unionByName(p.withColumn("field", F.lit("custom")))
    return flow.check_contract(runs).groupBy("field", "tier").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("tier_honored").alias("honored"),
        F.count_if(F.col("failure_signal") != "").alias("signals"))
