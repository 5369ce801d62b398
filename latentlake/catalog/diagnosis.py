"""Traces, triggers, routes, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from latentlake.catalog.base import E, TARGET, query, r, states, table, with_target
from latentlake.catalog.relaxation import NORMALIZE, SIN, relaxed, waved
from latentlake.functions import vec
from latentlake.operators import flow, ordered, routes, stats, traces, weights
from latentlake.operators.commit import commit_once, decide

ORDER = ["ts", "event_id"]


def events(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")


def lows(spark, sf):
    """Every user's running minimum of value: a trace that only falls."""
    return ordered.running(events(spark, sf), ["user_id"], ORDER, {"low": ("min", "value")})


@query("w1_drift_trigger", f"""WITH w AS (SELECT user_id, ts, event_id, avg(value) OVER p AS m, count(*) OVER p AS n FROM events
    WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
    SELECT user_id, count(*) AS n, count(*) FILTER (WHERE n >= 10 AND m < 20) AS n_stable,
    min_by(event_id, struct_pack(a := ts, b := event_id)) FILTER (WHERE n >= 10 AND m < 20) AS first_event FROM w GROUP BY user_id""")
def _(spark, sf):
    out = traces.first_stable(events(spark, sf), ["user_id"], ORDER, "value", threshold=20.0)
    return out.select("user_id", "n", "n_stable", F.col("first.event_id").alias("first_event"))


DIAGNOSE = """len AS (SELECT user_id, count(*) AS length, arg_max(low, pos) AS final FROM v GROUP BY user_id),
    a AS (SELECT v.*, lead(low, 49) OVER o AS ahead, lead(pos, 50) OVER o AS more FROM v WINDOW o AS (PARTITION BY user_id ORDER BY pos)),
    st AS (SELECT user_id, min(pos - 1) FILTER (WHERE low - ahead < 1e-6 AND more IS NOT NULL) AS first FROM a GROUP BY user_id),
    stall AS (SELECT len.*, CASE WHEN length < 50 THEN 0 ELSE coalesce(first, length) END AS stall_step FROM len JOIN st USING (user_id)),
    tail AS (SELECT v.user_id, pos, low FROM v JOIN len USING (user_id) WHERE pos > length - 50),
    dl AS (SELECT *, low - lag(low) OVER o AS delta FROM tail WINDOW o AS (PARTITION BY user_id ORDER BY pos)),
    tn AS (SELECT *, delta * lag(delta) OVER o < 0 AS turn FROM dl WINDOW o AS (PARTITION BY user_id ORDER BY pos)),
    sh AS (SELECT user_id, count(*) AS n, count(delta) AS deltas, count(*) FILTER (WHERE turn) AS turns, max(low) - min(low) AS spread
        FROM tn GROUP BY user_id),
    diag AS (SELECT stall.*, spread, CASE WHEN length < 10 THEN 'plateau' WHEN n > 5 AND turns > deltas * 0.4 THEN 'saddle_oscillation'
        WHEN n > 2 AND spread < 0.01 THEN 'local_minimum' WHEN stall_step > 0 AND stall_step < length * 0.8 THEN 'boundary_stall'
        ELSE 'plateau' END AS trap_type FROM stall JOIN sh USING (user_id))"""
LOWS = f"""v AS (SELECT user_id, row_number() OVER o AS pos, min(value) OVER o AS low FROM events
        WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)), {DIAGNOSE}"""


@query("w2_stall_step", f"WITH {LOWS} SELECT user_id, length, {r('final', 'final')}, stall_step FROM stall")
def _(spark, sf):
    return traces.stall(lows(spark, sf), ["user_id"], ORDER, "low")


@query("w3_trap_type", f"WITH {LOWS} SELECT user_id, length, {r('final', 'final')}, stall_step, {r('spread', 'spread')}, trap_type FROM diag")
def _(spark, sf):
    return traces.traps(lows(spark, sf), ["user_id"], ORDER, "low")


@query("w3_trap_of_flow", f"""WITH RECURSIVE {SIN}, v AS (SELECT vec_id AS user_id, step AS pos, r AS low FROM loop WHERE step > 0), {DIAGNOSE}
    SELECT label, trap_type, count(*) AS n, {r('avg(final)', 'mean_final')} FROM diag JOIN s ON vec_id = user_id GROUP BY label, trap_type""")
def _(spark, sf):
    """Sin-field traces: odd labels start beyond the ring on which the field holds them."""
    df = waved(spark, sf).withColumn("r0", vec.l2("x", "q"))
    tr = flow.trace(df, ["label", "vec_id"], "r0", "sin", max_steps=300)
    return traces.traps(tr, ["label", "vec_id"], ["step"], "drift").groupBy("label", "trap_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("final").alias("mean_final"))


@query("w4_rank_encoding", f"""WITH {E}, p AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY x[3], vec_id) - 1 AS pos,
    count(*) OVER (PARTITION BY label) AS n FROM e)
    SELECT label, vec_id, {r('pos / greatest(n - 1, 1)', 'rank_value')}, pos AS position FROM p""")
def _(spark, sf):
    df = states(spark, sf).select("label", "vec_id", F.col("x")[2].cast("double").alias("o"))
    enc = routes.encode_ranks(df, ["label"], ["o", "vec_id"])
    return routes.decode_ranks(enc, ["label"], "rank_value", "vec_id").select("label", "vec_id", "rank_value", "position")


MOVED = f"""WITH {NORMALIZE}, k AS (SELECT vec_id, k AS step, greatest(0.0, d - k * 0.1) AS drift,
    greatest(0.0, d - (k - 1) * 0.1) AS before FROM z, unnest(range(1, steps + 1)) t(k))
    SELECT vec_id, step, {r('drift', 'drift')}, {r('before - drift', 'moved')} FROM k"""


@query("w5_movement", MOVED)
def _(spark, sf):
    df = with_target(spark, sf).withColumn("r0", vec.l2("x", "q"))
    path = flow.trace(df, ["vec_id", "x", "q", "r0"], "r0").withColumn("at", flow.path_at("x", "q", "r0", "drift"))
    return traces.movement(path, ["vec_id"], "step", "at", "x").select("vec_id", "step", "drift", "moved")


@query("w5_movement_along", MOVED)
def _(spark, sf):
    """The same from distances alone: no vector leaves the row it is in."""
    df = with_target(spark, sf).select("vec_id", vec.l2("x", "q").alias("r0"))
    path = flow.trace(df, ["vec_id", "r0"], "r0")
    return traces.movement_along(path, ["vec_id"], "step", "drift", "r0").select("vec_id", "step", "drift", "moved")


@query("w6_history", f"""WITH h AS (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS h FROM events)
    SELECT event_id, len(h) AS n, {r('h[1]', 'oldest')}, {r('h[len(h)]', 'newest')}, {r('list_sum(h)', 'total')} FROM h""")
def _(spark, sf):
    h = F.col("history")
    return traces.history(events(spark, sf), ["user_id"], ORDER, "value", 5).select(
        "event_id", F.size(h).alias("n"), h[0].alias("oldest"), F.element_at(h, -1).alias("newest"), vec.total(h).alias("total"))


@query("a12_convergence_report", f"""WITH {LOWS}, u AS (SELECT diag.*, length % 10 AS run FROM diag)
    SELECT run, count(*) AS n_total, count(*) FILTER (WHERE final < 0.5) AS n_converged,
    {r('coalesce(avg(final) FILTER (WHERE final >= 0.5), 0)', 'mean_drift')},
    coalesce(bool_or(final >= 0.5 AND trap_type = 'plateau'), false) AS plateau,
    CASE WHEN count(*) FILTER (WHERE final < 0.5) = count(*) THEN 'ok' ELSE 'non_convergent' END AS status FROM u GROUP BY run""")
def _(spark, sf):
    diag = traces.traps(lows(spark, sf), ["user_id"], ORDER, "low").withColumn("run", F.col("length") % 10)
    return traces.convergence_report(diag, ["run"], 0.5)


@query("t3_worst_first", f"""WITH {LOWS}, t AS (SELECT * FROM diag WHERE final >= 0.5)
    SELECT user_id, {r('final', 'final')}, stall_step, trap_type, greatest((SELECT count(*) FROM t) - 5, 0) AS n_more
    FROM t ORDER BY t.final DESC, user_id LIMIT 5""")
def _(spark, sf):
    diag = traces.traps(lows(spark, sf), ["user_id"], ORDER, "low")
    return traces.worst(diag, "user_id", 0.5).select("user_id", "final", "stall_step", "trap_type", "n_more")


@query("a8_step_summary", f"""WITH {NORMALIZE} SELECT label, count(*) AS n, {r('avg(steps)', 'mean_steps')}, {r('var_pop(steps)', 'var_steps')},
    {r('stddev_pop(steps)', 'std_steps')}, 100.0::DOUBLE AS converged_pct, avg(steps) < 10 AS pass_mean, var_pop(steps) < 2 AS pass_var
    FROM z GROUP BY label""")
def _(spark, sf):
    return stats.step_summary(relaxed(spark, sf, final=False), ["label"])


@query("a9_acceptance", f"""WITH {NORMALIZE}, y AS (SELECT *, greatest(1, floor(ln(1e-3 / d) / ln(1 - 0.1)) + 1) AS gd FROM z)
    SELECT label, count(*) AS n, 0.0::DOUBLE AS unconverged_pct, {r('avg((r_final > 1e-3)::INT) * 100', 'drifted_pct')},
    {r('avg((steps < gd)::INT) * 100', 'win_pct')}, true AS pass_converged, avg((r_final > 1e-3)::INT) = 0 AS pass_drift,
    avg((steps < gd)::INT) > 0.5 AS pass_wins, true AS pass_adverse FROM y GROUP BY label""")
def _(spark, sf):
    """Every row's run in one pass: the normalize field, plain descent and the repulsive field."""
    a = relaxed(spark, sf, final=False).withColumnRenamed("steps", "steps_a")
    runs = a.withColumns({"steps_b": flow.steps_needed("descent", "r0", 0.1, 1e-3),
                          "r_adverse": flow.radius_at("repulsive", "r0", F.lit(100), 0.1)})
    return stats.acceptance(runs, ["label"])


def attempts(spark, sf):
    """Orders as attempts: a returned line is a correction, an order without returns a success."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("n_corrections"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.substring("o_orderpriority", 1, 1).cast("int")
                                               .alias("difficulty"))
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).withColumn("success", F.col("n_corrections") == 0)


ATTEMPTS = """l AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS c FROM lineitem GROUP BY l_orderkey),
    t AS (SELECT o_orderstatus, c, substring(o_orderpriority, 1, 1)::INT AS dif FROM orders JOIN l ON o_orderkey = l_orderkey)"""


@query("a11_attempt_summary", f"""WITH {ATTEMPTS} SELECT o_orderstatus, count(*) AS count, {r('avg((c = 0)::INT)', 'success_rate')},
    {r('avg(c)', 'mean_corrections')}, sum(c)::BIGINT AS total_corrections, {r('avg(dif)', 'mean_difficulty')}, count(*) FILTER (WHERE c > 0) AS abandoned
    FROM t GROUP BY o_orderstatus""")
def _(spark, sf):
    return stats.attempt_summary(attempts(spark, sf), "o_orderstatus")


@query("a11_load_ratio", f"""WITH {ATTEMPTS} SELECT {r('''avg(c) FILTER (WHERE o_orderstatus = 'O')
    / greatest(avg(c) FILTER (WHERE o_orderstatus = 'F'), 0.01)''', 'ratio')} FROM t""")
def _(spark, sf):
    return stats.load_ratio(attempts(spark, sf), "o_orderstatus", "O", "F")


def points(spark, sf):
    return states(spark, sf).select("label", "vec_id", F.col("x")[0].cast("double").alias("px"), F.col("x")[1].cast("double").alias("py"),
                                    "x")


POINTS = f"""{E}, pt AS (SELECT label, vec_id, x[1] AS px, x[2] AS py, x FROM e)"""
SEGMENTS = f"""{POINTS}, sg AS (SELECT label, vec_id, row_number() OVER o - 1 AS idx, px, py,
    coalesce(lead(px) OVER o, first_value(px) OVER o) AS qx, coalesce(lead(py) OVER o, first_value(py) OVER o) AS qy
    FROM pt WINDOW o AS (PARTITION BY label ORDER BY vec_id))"""


@query("a14_route_length", f"WITH {SEGMENTS} SELECT label, {r('sum(sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py)))', 'length')} FROM sg GROUP BY label")
def _(spark, sf):
    return routes.route_lengths(points(spark, sf), ["label"], ["vec_id"], "px", "py")


def candidate_routes(spark, sf):
    """Four visiting orders per label: by id (candidate 0) and by three components."""
    orders = F.array(F.col("vec_id").cast("double"), *[F.col("x")[k].cast("double") for k in (0, 1, 2)])
    return points(spark, sf).select("label", "vec_id", "px", "py", F.posexplode(orders).alias("cand", "o"))


@query("a10_best_route", f"""WITH {POINTS}, c AS (SELECT label, vec_id, px, py, cand, CASE cand WHEN 0 THEN vec_id ELSE x[cand] END AS o
    FROM pt, unnest(range(0, 4)) t(cand)),
    s AS (SELECT label, cand, px, py, coalesce(lead(px) OVER w, first_value(px) OVER w) AS qx,
        coalesce(lead(py) OVER w, first_value(py) OVER w) AS qy FROM c WINDOW w AS (PARTITION BY label, cand ORDER BY o, vec_id)),
    l AS (SELECT label, cand, sum(sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py))) AS length FROM s GROUP BY label, cand)
    SELECT label, arg_min(cand, length) AS best, {r('min(length)', 'length')}, {r('max(length) FILTER (WHERE cand = 0)', 'baseline')},
    {r('(1 - min(length) / max(length) FILTER (WHERE cand = 0)) * 100', 'improvement_pct')} FROM l GROUP BY label""")
def _(spark, sf):
    lengths = routes.route_lengths(candidate_routes(spark, sf), ["label", "cand"], ["o", "vec_id"], "px", "py")
    return routes.best_route(lengths, ["label"], "cand", 0)


@query("j7_route_crossings", f"""WITH {SEGMENTS}, n AS (SELECT label, count(*) AS n FROM sg GROUP BY label),
    p AS (SELECT a.label, (a.qx - a.px) * (b.qy - b.py) - (a.qy - a.py) * (b.qx - b.px) AS c,
        (b.px - a.px) * (b.qy - b.py) - (b.py - a.py) * (b.qx - b.px) AS tn, (b.px - a.px) * (a.qy - a.py) - (b.py - a.py) * (a.qx - a.px) AS un
        FROM sg a JOIN sg b ON a.label = b.label AND b.idx >= a.idx + 2 JOIN n ON n.label = a.label
        WHERE NOT (a.idx = 0 AND b.idx = n.n - 1))
    SELECT label, count(*) FILTER (WHERE CASE WHEN abs(c) >= 1e-10 THEN tn / c > 0 AND tn / c < 1 AND un / c > 0 AND un / c < 1 ELSE false END) AS crossings
    FROM p GROUP BY label""")
def _(spark, sf):
    return routes.crossings(points(spark, sf), ["label"], ["vec_id"], "px", "py")


# Student's t by Simpson's rule over the angle atan(t / sqrt(df)), its quantile by bisection
def tail(lo: str, df: str = "df", n: int = 2000) -> str:
    hi = f"least(pi() / 2, {lo} + 12 / sqrt({df}))"
    weight = f"CASE WHEN k % {n} = 0 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    at = f"({lo} + ({hi} - ({lo})) * k / {n}.0)"
    return f"(({hi} - ({lo})) / {3 * n} * list_sum(list_transform(range(0, {n + 1}), lambda k: {weight} * exp(({df} - 1) * ln(greatest(cos({at}), 1e-300))))))"


def significance(groups: str, columns: str, df: str, alpha: float = 0.05) -> str:
    """SQL: comparison rows of ``groups`` (difference, std_error, t) with p value and interval; wants WITH RECURSIVE."""
    return f"""z AS (SELECT *, ({df})::DOUBLE AS df, {tail('0', f'({df})::DOUBLE')} AS whole FROM {groups}),
    q(id, step, lo, hi) AS (SELECT row_number() OVER (), 0, 0::DOUBLE, pi() / 2 FROM z
        UNION ALL SELECT id, step + 1, CASE WHEN m > {alpha} * whole THEN (lo + hi) / 2 ELSE lo END, CASE WHEN m > {alpha} * whole THEN hi ELSE (lo + hi) / 2 END
        FROM (SELECT q.*, y.whole, {tail('((lo + hi) / 2)', 'y.df')} AS m FROM q JOIN (SELECT *, row_number() OVER () AS id FROM z) y USING (id) WHERE step < 60)),
    y AS (SELECT y.*, tan((lo + hi) / 2) * sqrt(df) AS c FROM (SELECT *, row_number() OVER () AS id FROM z) y JOIN q USING (id) WHERE step = 60)
    SELECT {columns}, {r('difference', 'difference')}, {r('t', 't')}, {r('std_error', 'std_error')}, {r(f"{tail('atan(abs(t) / sqrt(df))')} / whole", 'p_value')},
    {r('difference - c * std_error', 'ci_lower')}, {r('difference + c * std_error', 'ci_upper')}, {tail('atan(abs(t) / sqrt(df))')} / whole < {alpha} AS significant FROM y"""


SIDES = """g AS (SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'A') AS na, count(*) FILTER (WHERE l_returnflag <> 'A') AS nb,
    avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS ma, avg(l_extendedprice) FILTER (WHERE l_returnflag <> 'A') AS mb,
    var_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS sa, var_samp(l_extendedprice) FILTER (WHERE l_returnflag <> 'A') AS sb,
    var_pop(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS pa, var_pop(l_extendedprice) FILTER (WHERE l_returnflag <> 'A') AS pb
    FROM lineitem GROUP BY l_linestatus),
    s AS (SELECT *, ma - mb AS difference, (ma - mb) / sqrt(((na - 1) * sa + (nb - 1) * sb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)) AS t, sqrt(sa / na + sb / nb) AS std_error FROM g)"""
DIFFERENCES = """g AS (SELECT l_returnflag, count(*) AS n, avg(l_discount) AS ma, avg(l_tax) AS mb, avg(l_discount - l_tax) AS difference,
    stddev_samp(l_discount - l_tax) AS sd FROM lineitem GROUP BY l_returnflag),
    s AS (SELECT *, sd / sqrt(n) AS std_error, difference / (sd / sqrt(n)) AS t FROM g)"""


@query("x1_two_sample", f"""WITH g AS (SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'A') AS na, count(*) FILTER (WHERE l_returnflag <> 'A') AS nb,
    avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS ma, avg(l_extendedprice) FILTER (WHERE l_returnflag <> 'A') AS mb,
    var_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS sa, var_samp(l_extendedprice) FILTER (WHERE l_returnflag <> 'A') AS sb,
    var_pop(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS pa, var_pop(l_extendedprice) FILTER (WHERE l_returnflag <> 'A') AS pb
    FROM lineitem GROUP BY l_linestatus)
    SELECT l_linestatus, na AS n_a, nb AS n_b, {r('ma', 'mean_a')}, {r('mb', 'mean_b')}, {r('ma - mb', 'difference')},
    {r('(ma - mb) / sqrt(((na - 1) * sa + (nb - 1) * sb) / (na + nb - 2) * (1.0 / na + 1.0 / nb))', 't')},
    {r('(mb - ma) / sqrt((pa + pb) / 2)', 'effect_pop')}, {r('(ma - mb) / sqrt((sa + sb) / 2)', 'effect_samp')},
    {r('sqrt(sa / na + sb / nb)', 'std_error')} FROM g""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_linestatus", "l_returnflag", "l_extendedprice")
    return stats.two_sample(lines, "l_extendedprice", F.col("l_returnflag") == "A", ["l_linestatus"])


@query("x1_two_sample_significance", f"""WITH RECURSIVE {SIDES}, {significance('s', f"l_linestatus, na AS n_a, nb AS n_b, {r('ma', 'mean_a')}, {r('mb', 'mean_b')}, "
    f"{r('(mb - ma) / sqrt((pa + pb) / 2)', 'effect_pop')}, {r('(ma - mb) / sqrt((sa + sb) / 2)', 'effect_samp')}", 'na + nb - 2')}""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_linestatus", "l_returnflag", "l_extendedprice")
    out = stats.two_sample(lines, "l_extendedprice", F.col("l_returnflag") == "A", ["l_linestatus"])
    return stats.with_significance(out, F.col("n_a") + F.col("n_b") - 2)


@query("x2_paired", f"""WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_discount) AS ma, avg(l_tax) AS mb, avg(l_discount - l_tax) AS md,
    stddev_samp(l_discount - l_tax) AS sd FROM lineitem GROUP BY l_returnflag)
    SELECT l_returnflag, n, {r('ma', 'mean_a')}, {r('mb', 'mean_b')}, {r('md', 'difference')}, {r('sd / sqrt(n)', 'std_error')},
    {r('md / (sd / sqrt(n))', 't')}, {r('md / sd', 'effect')} FROM g""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_discount", "l_tax")
    return stats.paired(lines, "l_discount", "l_tax", ["l_returnflag"])


@query("x2_paired_significance", f"""WITH RECURSIVE {DIFFERENCES}, {significance('s', f"l_returnflag, n, {r('ma', 'mean_a')}, {r('mb', 'mean_b')}, {r('difference / sd', 'effect')}", 'n - 1')}""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_discount", "l_tax")
    return stats.with_significance(stats.paired(lines, "l_discount", "l_tax", ["l_returnflag"]), F.col("n") - 1)


# the damped field stopped after a number of steps that differs by label, so that not every label has settled
SETTLED = f"""{TARGET}, sh AS (SELECT s.*, exp(-150 * (d - min(d) OVER (PARTITION BY label))) AS ew FROM s),
    sw AS (SELECT *, ew / sum(ew) OVER (PARTITION BY label) AS w FROM sh),
    ent AS (SELECT label, -sum(CASE WHEN w > 0 THEN w * log2(w) ELSE 0 END) AS entropy, arg_min(vec_id, d) AS winner, min(d) AS d FROM sw GROUP BY label),
    tl AS (SELECT label, count(*) AS n_recent, avg(d * pow(0.9, k)) AS mean_recent FROM ent, unnest(range(1, 61)) t(k)
        WHERE k <= 40 + 2 * label AND k > 30 + 2 * label GROUP BY label)"""


@query("r4_commit", f"""WITH {SETTLED} SELECT label, winner, {r('entropy', 'entropy')}, {r('mean_recent', 'mean_recent')},
    CASE WHEN entropy < 2 THEN 'entropy_low' WHEN n_recent >= 10 AND mean_recent < 0.01 THEN 'drift_stable' ELSE 'forced_best' END AS reason
    FROM ent JOIN tl USING (label)""")
def _(spark, sf):
    df = with_target(spark, sf).withColumn("d", vec.l2("x", "q")).drop("x", "q").withColumn("sharp", F.col("d") * 150)
    sharp = weights.softmax(df, "label", "sharp")
    groups = sharp.groupBy("label").agg(weights.entropy().alias("entropy"),
                                        F.min(F.struct("d", "vec_id")).alias("b"))
    best = groups.select("label", "entropy", F.col("b.vec_id").alias("winner"), F.col("b.d").alias("d"))
    steps = best.select("label", "d", F.explode(F.sequence(F.lit(1), 40 + 2 * F.col("label"))).alias("step"))
    tail = ordered.top_rows(steps, ["label"], [F.desc("step")], 10).groupBy("label").agg(
        F.count(F.lit(1)).alias("n_recent"), F.avg(flow.radius_at("damped", "d", "step", 0.1)).alias("mean_recent"))
    out = decide(best.join(tail, "label"), entropy_threshold=2.0)
    return out.select("label", "winner", "entropy", "mean_recent", "reason")


@query("r4_commit_once", """WITH f AS (SELECT user_id, min_by(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events
        WHERE value < 5 AND event_type = 'view' GROUP BY user_id),
    n AS (SELECT user_id, min_by(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events WHERE value < 5 GROUP BY user_id)
    SELECT user_id, event_id FROM f UNION ALL SELECT user_id, event_id FROM n WHERE user_id NOT IN (SELECT user_id FROM f)""")
def _(spark, sf):
    """A second wave of proposals (any event type) leaves the keys committed by the first wave (views) as they are."""
    low = events(spark, sf).where("value < 5").select("user_id", "ts", "event_id", "event_type")
    none = low.where("false").select("user_id", "ts", "event_id")
    first = commit_once(none, low.where("event_type = 'view'").select("user_id", "ts", "event_id"), "user_id", ORDER)
    return commit_once(first, low.select("user_id", "ts", "event_id"), "user_id", ORDER).select("user_id", "event_id")
