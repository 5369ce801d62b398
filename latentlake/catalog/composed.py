"""Composed jobs, stages and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from latentlake.catalog.base import D, TARGET, exploded, label_means, label_references, long_form, query, r, states, table
from latentlake.catalog.diagnosis import ORDER, POINTS, candidate_routes
from latentlake.catalog.relaxation import NORMALIZE
from latentlake.functions import vec
from latentlake.operators import quality as rules
from latentlake.plans import jobs, stages
from latentlake.plans.runtime import scratch_path
from latentlake.streaming import memory, triggers


def literal(m) -> str:
    return "[" + ", ".join("[" + ", ".join(repr(float(v)) for v in row) + "]" for row in m) + "]"


@query("l1_evaluate", f"""WITH {TARGET}, f AS (SELECT *, d * pow(0.9, 30) AS r FROM s),
    ex AS (SELECT *, exp(min(r) OVER (PARTITION BY label) - r) AS ew FROM f),
    w AS (SELECT *, ew / sum(ew) OVER (PARTITION BY label) AS w FROM ex),
    g AS (SELECT label, count(*) AS n, -sum(w * log2(w)) AS entropy, arg_min(vec_id, r) AS winner, min(d) AS d, min(r) AS e FROM w GROUP BY label),
    t AS (SELECT g.*, (SELECT avg(pow(0.9, k)) FROM unnest(range(21, 31)) u(k)) * d AS mean_recent FROM g)
    SELECT label, winner, CASE WHEN entropy < 0.5 THEN 'entropy_low' WHEN mean_recent < 0.066 THEN 'drift_stable' ELSE 'forced_best' END AS reason,
    {r('entropy', 'entropy')}, {r('mean_recent', 'mean_recent')}, n AS n_candidates, (n * 30)::BIGINT AS total_steps, 0::BIGINT AS converged_count,
    0::BIGINT AS fold_corrections, {r('greatest(0.0, 1 - e / 0.05)', 'quality')}, e <= 0.05 AS is_equivalent, 3::BIGINT AS n_levels FROM t""")
def _(spark, sf):
    out = jobs.evaluate(states(spark, sf), label_means(spark, sf), field="damped", max_steps=30, drift_threshold=0.066)
    return out.withColumn("n_levels", F.size("level_dims")).drop("committed", "level_dims")


OWN = memory.Memory(D, scale=1)
CAP = 0.17


@query("l1_evaluate_own_parts", f"""WITH {TARGET}, m AS (SELECT {literal(OWN.matrices()[0])} AS wi, {literal(OWN.matrices()[2][:1])} AS wo),
    f AS (SELECT s.*, list_transform(range(1, {D + 1}), lambda i: q[i] + (x[i] - q[i]) * pow(0.9, 30)) AS z FROM s),
    k AS (SELECT *, sqrt(list_dot_product(z, z)) AS nz FROM f),
    y AS (SELECT *, list_distance(list_transform(z, lambda v: CASE WHEN nz > {CAP} THEN v * {CAP} / nz ELSE v END), q) AS r FROM k),
    ex AS (SELECT *, exp(min(r) OVER (PARTITION BY label) - r) AS ew FROM y),
    w AS (SELECT *, ew / sum(ew) OVER (PARTITION BY label) AS w FROM ex),
    g AS (SELECT label, count(*) AS n, count(*) FILTER (nz > {CAP}) AS folded, -sum(w * log2(w)) AS entropy, arg_min(vec_id, r) AS winner, arg_min(d, r) AS d, min(r) AS e,
        arg_min(z, r) AS z FROM w GROUP BY label),
    t AS (SELECT g.*, (SELECT avg(pow(0.9, k)) FROM unnest(range(21, 31)) u(k)) * d AS mean_recent, list_transform(wi, lambda row: 0.3 * tanh(list_dot_product(row, z))) AS h, wo FROM g, m)
    SELECT label, winner, CASE WHEN entropy < 0.5 THEN 'entropy_low' WHEN mean_recent < 0.066 THEN 'drift_stable' ELSE 'forced_best' END AS reason,
    {r('entropy', 'entropy')}, {r('mean_recent', 'mean_recent')}, n AS n_candidates, (n * 30)::BIGINT AS total_steps, 0::BIGINT AS converged_count,
    folded AS fold_corrections, {r('greatest(0.0, 1 - e / 0.05)', 'quality')}, e <= 0.05 AS is_equivalent, {r('list_dot_product(wo[1], h)', 'memory')} FROM t""")
def _(spark, sf):
    """The same job with a field, a repair rule and a memory of the user's own."""
    out = jobs.evaluate(states(spark, sf), label_means(spark, sf), max_steps=30, drift_threshold=0.066, fn=lambda x, q: q - x,
                        rule=rules.norm_rule("x_final", CAP), memory=OWN)
    return out.withColumn("memory", F.get("memory", 0)).drop("committed", "level_dims")


@query("l1_levels", f"""WITH {TARGET}, w AS (SELECT label, arg_min(vec_id, struct_pack(a := d, b := vec_id)) AS vec_id FROM s GROUP BY label),
    c AS (SELECT s.label, list_transform(range(1, {D + 1}), lambda i: q[i] + (x[i] - q[i]) * pow(0.9, 30)) AS z FROM s JOIN w USING (vec_id))
    SELECT label, level::BIGINT AS level, dim::BIGINT AS dim, {r('list_sum(z[1:dim])', 'total')} FROM c, (VALUES (0, {D}), (1, {D // 2}), (2, {D // 4})) v(level, dim)""")
def _(spark, sf):
    """The committed vectors at every level of abstraction."""
    out = jobs.evaluate(states(spark, sf), label_means(spark, sf), field="damped", max_steps=30, drift_threshold=0.066)
    return jobs.committed_levels(out, D).select("label", "level", "dim", vec.total("z").alias("total"))


@query("l1_evaluate_squeezed")
def _(spark, sf):
    out = jobs.evaluate(states(spark, sf), label_means(spark, sf), squeeze_to=16, field="normalize", tau=1.0)
    return out.withColumn("n_levels", F.size("level_dims")).drop("committed", "level_dims")


@query("l2_stage_chain", f"""WITH {NORMALIZE}, g AS (SELECT label, arg_min(vec_id, struct_pack(a := r_final, b := vec_id)) AS vec_id FROM z GROUP BY label)
    SELECT g.label, g.vec_id, z.steps, true AS converged, 'clean' AS diagnosis, {r('greatest(0.0, 1 - r_final / 0.05)', 'quality')},
    {r('q[1] + (x[1] - q[1]) * r_final / d', 'first')} FROM g JOIN z USING (vec_id)""")
def _(spark, sf):
    """Superpose, flow, fold, equiv, commit as one chain: the row that ends nearest to its target is taken."""
    goal = label_means(spark, sf)
    out = (states(spark, sf).transform(stages.superpose()).transform(stages.flow(goal)).transform(stages.fold())
           .transform(stages.equiv(goal, 0.05)).transform(stages.commit(goal)))
    return out.select("label", "vec_id", "steps", "converged", "diagnosis", "quality", F.col("x")[0].alias("first"))


@query("l2_other_stages")
def _(spark, sf):
    """Squeeze, recurse, remember and compete in one chain."""
    goal = label_means(spark, sf)
    out = states(spark, sf).transform(stages.superpose()).transform(stages.recurse(goal, inner_steps=4, max_iterations=2))
    out = out.transform(stages.remember(D)).transform(stages.compete(label_references(spark, sf), max_steps=3)).transform(stages.squeeze(4))
    return out.groupBy("label", "termination").agg(
        F.count(F.lit(1)).alias("n"), F.avg("certainty").alias("certainty"), F.avg(vec.norm("memory")).alias("memory_norm"),
        F.avg(vec.norm("x")).alias("squeezed_norm"))


@query("l3_converge", f"""WITH {NORMALIZE} SELECT label, vec_id, {r('q[2] + (x[2] - q[2]) * r_final / d', 'second')} FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY r_final, vec_id) AS rn FROM z) WHERE rn = 1""")
def _(spark, sf):
    return jobs.converge(states(spark, sf), label_means(spark, sf)).select("label", "vec_id", F.col("x")[1].alias("second"))


@query("l3_low_entropy_commit", f"""WITH {TARGET}, f AS (SELECT *, greatest(0, d - 0.5) AS rf FROM s),
    ex AS (SELECT *, exp(min(rf) OVER (PARTITION BY label) - rf) AS ew FROM f),
    w AS (SELECT *, ew / sum(ew) OVER (PARTITION BY label) AS w FROM ex),
    g AS (SELECT label, -sum(w * log2(w)) AS entropy, arg_min(vec_id, rf) AS vec_id FROM w GROUP BY label)
    SELECT label, vec_id, {r('entropy', 'entropy')} FROM g WHERE entropy < 5.65""")
def _(spark, sf):
    out = jobs.low_entropy_commit(states(spark, sf), label_means(spark, sf), 5.65, max_steps=5)
    return out.select("label", "vec_id", "entropy")


@query("l3_cascade_after_flow", f"""WITH {NORMALIZE}, g AS (SELECT label, vec_id, list_transform(range(1, 65), lambda i: q[i] + (x[i] - q[i]) * r_final / d) AS q FROM (
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY r_final, vec_id) AS rn FROM z) WHERE rn = 1),
    l AS (SELECT level::BIGINT AS level, dim::BIGINT AS dim FROM (VALUES (0, 64), (1, 32), (2, 16)) v(level, dim))
    SELECT vec_id, level, dim, {r('list_sum(q[1:dim])', 'total')} FROM g, l""")
def _(spark, sf):
    out = jobs.cascade_after_flow(states(spark, sf), label_means(spark, sf), D)
    return out.select("vec_id", "level", "dim", vec.total("z").alias("total"))


@query("l3_full")
def _(spark, sf):
    out = jobs.full(states(spark, sf), label_means(spark, sf))
    return out.groupBy("level", "dim").agg(F.count(F.lit(1)).alias("n"), F.avg(vec.norm("z")).alias("mean_norm"))


@query("l4_pull_routes", f"""WITH {POINTS}, c AS (SELECT label, vec_id, px, py, cand, CASE cand WHEN 0 THEN vec_id ELSE x[cand] END AS o
    FROM pt, unnest(range(0, 4)) t(cand)),
    rk AS (SELECT *, (row_number() OVER (PARTITION BY label, cand ORDER BY o, vec_id) - 1)
        / greatest(count(*) OVER (PARTITION BY label, cand) - 1, 1) AS rank_value FROM c),
    j AS (SELECT a.*, b.rank_value AS goal FROM rk a JOIN rk b ON a.vec_id = b.vec_id AND b.cand = 1),
    gp AS (SELECT label, cand, sqrt(sum(pow(rank_value - goal, 2))) AS r0 FROM j GROUP BY label, cand),
    st AS (SELECT *, least(10, CASE WHEN r0 < 1e-3 THEN 1 ELSE greatest(1, floor((r0 - 1e-3) / 0.1) + 1) END)::BIGINT AS steps FROM gp),
    mv AS (SELECT j.*, steps, goal + (rank_value - goal) * CASE WHEN r0 < 1e-12 THEN 1 ELSE greatest(0.0, r0 - steps * 0.1) / r0 END AS v
        FROM j JOIN st USING (label, cand)),
    sg AS (SELECT label, cand, steps, px, py, coalesce(lead(px) OVER a, first_value(px) OVER a) AS qx, coalesce(lead(py) OVER a, first_value(py) OVER a) AS qy,
        coalesce(lead(px) OVER b, first_value(px) OVER b) AS ux, coalesce(lead(py) OVER b, first_value(py) OVER b) AS uy FROM mv
        WINDOW a AS (PARTITION BY label, cand ORDER BY rank_value, vec_id), b AS (PARTITION BY label, cand ORDER BY v, vec_id)),
    le AS (SELECT label, cand, any_value(steps) AS steps, sum(sqrt(pow(qx - px, 2) + pow(qy - py, 2))) AS before,
        sum(sqrt(pow(ux - px, 2) + pow(uy - py, 2))) AS after FROM sg GROUP BY label, cand)
    SELECT label, cand, steps, {r('before', 'before')}, {r('after', 'after')}, {r('(1 - after / before) * 100', 'improvement_pct')} FROM le""")
def _(spark, sf):
    return jobs.pull_routes(candidate_routes(spark, sf), ["label"], "cand", "vec_id", ["o", "vec_id"], "px", "py", 1)


MIRRORED = f"""WITH {TARGET} SELECT vec_id, x[1] >= 0 AS ok, CASE WHEN x[1] < 0 THEN 'negative start' ELSE 'fine' END AS diagnosis,
    {r('CASE WHEN x[1] < 0 THEN -x[1] ELSE x[1] END', 'first')}, {r(f'CASE WHEN x[1] < 0 THEN -x[{D}] ELSE x[{D}] END', 'last')} FROM s"""


@query("u2_user_rule", MIRRORED)
def _(spark, sf):
    """A rule written by the user as an expression: rows that start negative are mirrored."""
    bad = F.col("x")[0] < 0
    rule = F.struct((~bad).alias("ok"), F.when(bad, "negative start").otherwise("fine").alias("diagnosis"),
                    F.when(bad, vec.scale("x", F.lit(-1.0))).alias("correction"))
    out = rules.fold_with(states(spark, sf), "x", rule)
    return out.select("vec_id", "ok", "diagnosis", F.col("x")[0].alias("first"), F.col("x")[D - 1].alias("last"))


@query("u2_batch_rule", MIRRORED)
def _(spark, sf):
    """The same rule written on arrays."""
    def mirror(m, others):
        bad = m[:, 0] < 0
        return ~bad, np.where(bad, "negative start", "fine"), -m

    out = rules.fold_with_batches(states(spark, sf), "x", mirror)
    return out.select("vec_id", "ok", "diagnosis", F.col("x")[0].alias("first"), F.col("x")[D - 1].alias("last"))


@query("u3_user_stage", f"""WITH {TARGET} SELECT label, count(*) AS n, {r('avg(sqrt(list_dot_product(x, x)) * 3)', 'mean_norm')} FROM s GROUP BY label""")
def _(spark, sf):
    """Any function from DataFrame to DataFrame is a stage."""

    def triple(df):
        return df.withColumn("x", vec.scale("x", F.lit(3.0)))

    return states(spark, sf).transform(triple).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(vec.norm("x")).alias("mean_norm"))


# --- memory and triggers ----------------------------------------------------------------------------------------------

MEM = memory.Memory(2)


def fed(df):
    """Two features per event and the kind of row: errors reset a memory, a sign-up commits it."""
    kind = F.when(F.col("event_type") == "error", "reset").when((F.col("event_type") == "signup") & (F.col("value") > 80), "commit").otherwise("step")
    return df.select("event_id", "ts", "user_id", (F.col("value") / 100).alias("f1"), (F.length("event_type") / 10.0).alias("f2"), kind.alias("kind"))


def readouts(df):
    return df.select("user_id", "event_id", "status", F.col("y")[0].alias("y1"), F.col("y")[1].alias("y2"))


W_IN, W_RES, W_OUT = (literal(m) for m in MEM.matrices())
ZERO = "[" + ", ".join(["0.0::DOUBLE"] * 8) + "]"
READOUTS = f"""WITH RECURSIVE k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
        [value / 100, len(event_type) / 10.0::DOUBLE] AS f, CASE WHEN event_type = 'error' THEN 'reset'
        WHEN event_type = 'signup' AND value > 80 THEN 'commit' ELSE 'step' END AS kind FROM events),
    w AS (SELECT {W_IN} AS wi, {W_RES} AS wr, {W_OUT} AS wo),
    m AS (SELECT user_id, 0::BIGINT AS pos, NULL::BIGINT AS event_id, {ZERO} AS before, {ZERO} AS h, false AS closed, '' AS status FROM k WHERE pos = 1
        UNION ALL
        SELECT k.user_id, k.pos, k.event_id, m.h, CASE WHEN m.closed OR kind <> 'step' THEN {ZERO} ELSE list_transform(range(1, 9), lambda i:
            0.7 * m.h[i] + 0.3 * tanh(list_dot_product(wi[i], f) + list_dot_product(wr[i], m.h))) END, m.closed OR kind = 'commit',
            CASE WHEN m.closed THEN 'rejected' WHEN kind = 'commit' THEN 'committed' ELSE kind END
        FROM m JOIN k ON k.user_id = m.user_id AND k.pos = m.pos + 1, w),
    o AS (SELECT user_id, event_id, status, CASE status WHEN 'committed' THEN before ELSE h END AS h, status IN ('step', 'committed') AS told FROM m WHERE pos > 0)
    SELECT user_id, event_id, status, {r('CASE WHEN told THEN list_dot_product(wo[1], h) END', 'y1')}, {r('CASE WHEN told THEN list_dot_product(wo[2], h) END', 'y2')} FROM o, w"""


@query("r1_memory_table", READOUTS)
def _(spark, sf):
    df = fed(table(spark, sf, "events")).withColumn("x", F.array("f1", "f2"))
    return readouts(memory.remember(df, "user_id", ORDER, "event_id", "x", MEM, "kind"))


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("r1_memory_stream", READOUTS)
def _(spark, sf):
    """The same memory run as a stream; its rows equal those of r1_memory_table."""
    path = scratch_path(spark, "readouts")
    out = memory.remember_stream(fed(event_stream(spark, sf)), "user_id", ORDER, "event_id", ["f1", "f2"], MEM, "kind")
    triggers.run_available(out, triggers.append_sink(path))
    return readouts(spark.read.schema("user_id long, event_id long, status string, y array<double>").parquet(path))


@query("r1_memory_batches", READOUTS)
def _(spark, sf):
    """The events in four files by time, so that the stream takes four micro-batches."""
    source, path = scratch_path(spark, "events"), scratch_path(spark, "readouts")
    ev = table(spark, sf, "events").withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    cuts = sorted(set(ev.approxQuantile("_at", [0.25, 0.5, 0.75], 0.01)))
    for lo, hi in zip([float("-inf"), *cuts], [*cuts, float("inf")]):
        ev.where((F.col("_at") > lo) & (F.col("_at") <= hi)).drop("_at").repartition(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(table(spark, sf, "events").schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = memory.remember_stream(fed(stream), "user_id", ORDER, "event_id", ["f1", "f2"], MEM, "kind")
    triggers.run_available(out, triggers.append_sink(path))
    return readouts(spark.read.schema("user_id long, event_id long, status string, y array<double>").parquet(path))


STATUS = """k AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN 'reset' WHEN event_type = 'signup' AND value > 80 THEN 'commit'
        ELSE 'step' END AS kind FROM events),
    b AS (SELECT *, coalesce(sum((kind = 'commit')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING), 0) AS before FROM k)"""


@query("r2_commit_status", f"""WITH {STATUS} SELECT user_id, event_id, CASE WHEN before > 0 THEN 'rejected' WHEN kind = 'commit' THEN 'committed'
    WHEN kind = 'reset' THEN 'reset' ELSE 'step' END AS status FROM b""")
def _(spark, sf):
    """What became of every row: taken, reset, committed (once per key) or rejected after the commit."""
    return memory.statuses(fed(table(spark, sf, "events")), "user_id", ORDER, "kind").select("user_id", "event_id", "status")


@query("r2_commit_best", f"""WITH k AS (SELECT user_id, event_id, value, event_type = 'error' AS closed, [value / 100, len(event_type) / 10.0::DOUBLE] AS f FROM events),
    w AS (SELECT {W_IN} AS wi, {W_OUT} AS wo),
    b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM k),
    h AS (SELECT user_id, event_id, closed, wo, list_transform(range(1, 9), lambda i: 0.3 * tanh(list_dot_product(wi[i], f))) AS h FROM b, w WHERE rn = 1)
    SELECT user_id, event_id, CASE WHEN closed THEN 'rejected' ELSE 'committed' END AS status, {r('CASE WHEN NOT closed THEN list_dot_product(wo[1], h) END', 'y1')},
    {r('CASE WHEN NOT closed THEN list_dot_product(wo[2], h) END', 'y2')} FROM h""")
def _(spark, sf):
    """Of a user's events, each with the memory of its own first step, the one of largest value reads out; closed ones are rejected."""
    df = fed(table(spark, sf, "events")).join(table(spark, sf, "events").select("event_id", "value", (F.col("event_type") == "error").alias("closed")), "event_id")
    steps = [F.lit(MEM.leak) * F.tanh(F.lit(float(a)) * F.col("f1") + F.lit(float(b)) * F.col("f2")) for a, b in MEM.matrices()[0]]
    out = memory.commit_best(df.withColumn("h", F.array(*steps)), "user_id", "event_id", "value", "h", "closed", MEM)
    return out.select("user_id", "event_id", "status", F.get("y", 0).alias("y1"), F.get("y", 1).alias("y2"))


@query("r3_reset_readout", f"""WITH {STATUS} SELECT user_id, count(*) FILTER (WHERE kind = 'reset' AND before = 0) AS resets,
    count(*) FILTER (WHERE kind = 'commit' AND before = 0) AS commits, count(*) FILTER (WHERE before > 0) AS rejected FROM b GROUP BY user_id""")
def _(spark, sf):
    """Resets, commits and rejections per key."""
    out = memory.statuses(fed(table(spark, sf, "events")), "user_id", ORDER, "kind")
    n = lambda s: F.count_if(F.col("status") == s)
    return out.groupBy("user_id").agg(n("reset").alias("resets"), n("committed").alias("commits"), n("rejected").alias("rejected"))


@query("r3_first_after_reset", f"""WITH {STATUS}, w AS (SELECT {W_IN} AS wi, {W_OUT} AS wo),
    n AS (SELECT b.*, lag(kind) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM b),
    h AS (SELECT n.user_id, n.event_id, wo, list_transform(range(1, 9), lambda i: 0.3 * tanh(list_dot_product(wi[i], [value / 100, len(event_type) / 10.0::DOUBLE]))) AS h
        FROM n JOIN events USING (event_id), w WHERE n.was = 'reset' AND n.kind = 'step' AND n.before = 0)
    SELECT user_id, event_id, {r('list_dot_product(wo[1], h)', 'y1')}, {r('list_dot_product(wo[2], h)', 'y2')} FROM h""")
def _(spark, sf):
    """The row after a reset reads out as a fresh memory's first row does."""
    df = fed(table(spark, sf, "events")).withColumn("x", F.array("f1", "f2"))
    after = F.lag("kind").over(Window.partitionBy("user_id").orderBy(*ORDER)) == "reset"
    marked = df.withColumn("after", after).where("after").select(F.col("event_id").alias("_e"))
    out = memory.remember(df, "user_id", ORDER, "event_id", "x", MEM, "kind").where("status = 'step'")
    return out.join(marked, F.col("event_id") == F.col("_e"), "left_semi").select("user_id", "event_id", F.get("y", 0).alias("y1"), F.get("y", 1).alias("y2"))


@query("r4_commit_stream", """WITH w AS (SELECT user_id, ts, event_id, avg(value) OVER p AS m, count(*) OVER p AS n FROM events
    WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
    SELECT user_id, min_by(event_id, struct_pack(a := ts, b := event_id)) AS event_id, 'drift_stable' AS reason
    FROM w WHERE n >= 10 AND m < 20 GROUP BY user_id""")
def _(spark, sf):
    """The drift trigger as a stream with a sink that takes every key once."""
    path = scratch_path(spark, "commits")
    rows = event_stream(spark, sf).select("event_id", "ts", "user_id", "value")
    out = triggers.stable_stream(rows, "user_id", ORDER, "event_id", "value", threshold=20.0)
    triggers.run_available(out, triggers.keyed_sink(path, "user_id"))
    return spark.read.schema("user_id long, event_id long, reason string").parquet(path).drop("run", "batch")
