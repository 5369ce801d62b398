"""Sources and sinks on data written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from latentlake.catalog.base import E, TARGET, exploded, long_form, query, r, states, table, with_target
from latentlake.functions import vec
from latentlake.operators import flow, routes
from latentlake.plans.runtime import scratch_path
from latentlake.sources import generators, readers, writers


def csv_lines(spark, sf):
    """Order lines as delimited text with a blank cell, a word and a ragged tail."""
    t = table(spark, sf, "lineitem")
    tail = F.when(F.col("l_returnflag") == "R", F.concat(F.lit(","), F.col("l_tax").cast("string"))).otherwise(F.lit(""))
    line = F.concat_ws(",", F.col("l_quantity").cast("string"), F.concat(F.lit(" "), F.col("l_discount").cast("string")), F.lit(""),
                       F.col("l_returnflag"), F.col("l_linenumber").cast("string"))
    return t.select("l_orderkey", "l_linenumber", F.concat(line, tail).alias("line"))


CSV = """c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN [l_quantity, l_discount, l_linenumber, l_tax]
    ELSE [l_quantity, l_discount, l_linenumber, 0.0] END AS x FROM lineitem)"""


@query("s1_csv_vectors", f"""WITH {CSV} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {r('x[1]', 'c1')}, {r('x[2]', 'c2')}, {r('x[3]', 'c3')},
    {r('x[4]', 'c4')}, len(x) AS width FROM c""")
def _(spark, sf):
    out = readers.vectors_from_cells(csv_lines(spark, sf).withColumn("cells", readers.cells("line")), "cells")
    return out.select("l_orderkey", "l_linenumber", *[F.col("x")[i].alias(f"c{i + 1}") for i in range(4)], F.size("x").alias("width"))


@query("s1_csv_files", f"""WITH {CSV} SELECT count(*) AS n, {r('sum(x[1])', 's1')}, {r('sum(x[2])', 's2')}, {r('sum(x[3])', 's3')},
    {r('sum(x[4])', 's4')} FROM c""")
def _(spark, sf):
    """Written as text files and read back through the file reader."""
    path = scratch_path(spark, "csv")
    csv_lines(spark, sf).select("line").write.text(path)
    out = readers.read_csv_vectors(spark, path, header=False)
    return out.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i + 1}") for i in range(4)])


@query("s1_csv_strict", """SELECT l_returnflag, 0::BIGINT AS accepted, count(*) AS quarantined FROM lineitem GROUP BY l_returnflag""")
def _(spark, sf):
    """One cell of every line is a word: strict reading sets all lines aside."""
    lines = table(spark, sf, "lineitem").select(
        "l_returnflag", F.concat_ws(",", F.col("l_quantity").cast("string"), F.col("l_returnflag")).alias("line"))
    out = readers.vectors_from_cells(lines.withColumn("cells", readers.cells("line")), "cells", "strict")
    return out.groupBy("l_returnflag").agg(F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("quarantined"))


@query("s1_csv_accepted", """SELECT l_returnflag, count(*) FILTER (l_returnflag <> 'R') AS accepted, count(*) FILTER (l_returnflag = 'R') AS quarantined
    FROM lineitem GROUP BY l_returnflag""")
def _(spark, sf):
    """Some lines have a word in a cell: strict reading sets those aside and takes the others."""
    lines = table(spark, sf, "lineitem").select("l_returnflag", F.concat_ws(",", F.col("l_quantity").cast("string"), F.when(
        F.col("l_returnflag") == "R", "word").otherwise(F.col("l_tax").cast("string"))).alias("line"))
    out = readers.vectors_from_cells(lines.withColumn("cells", readers.cells("line")), "cells", "strict")
    return out.groupBy("l_returnflag").agg(F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("quarantined"))


def json_docs(spark, sf):
    """Events as JSON documents of five shapes."""
    t = table(spark, sf, "events").select("event_id", "value", "props", F.get_json_object("props", "$.k").alias("k"))
    v, k = F.col("value").cast("string"), F.col("k")
    doc = (F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("["), v, F.lit(", "), k, F.lit("]")))
           .when(F.col("event_id") % 5 == 1, F.concat(F.lit("[["), v, F.lit(', "text", '), k, F.lit("], ["), k, F.lit("]]")))
           .when(F.col("event_id") % 5 == 2, F.concat(F.lit('[{"b": '), v, F.lit(', "a": '), k, F.lit(', "c": true}]')))
           .when(F.col("event_id") % 5 == 3, F.concat(F.lit('{"name": "n", "points": [['), v, F.lit("], ["), k, F.lit("]]}")))
           .otherwise(F.col("props")))
    return t.select("event_id", doc.alias("doc"))


@query("s2_json_vectors", f"""WITH d AS (SELECT event_id, value, (props->>'$.k')::DOUBLE AS k FROM events),
    m AS (SELECT event_id, 0 AS row, value AS c1, k AS c2, 2 AS width FROM d WHERE event_id % 5 IN (0, 1, 2)
    UNION ALL SELECT event_id, 1, k, 0, 2 FROM d WHERE event_id % 5 = 1
    UNION ALL SELECT event_id, 0, value, NULL, 1 FROM d WHERE event_id % 5 = 3 UNION ALL SELECT event_id, 1, k, NULL, 1 FROM d WHERE event_id % 5 = 3
    UNION ALL SELECT event_id, 0, k, NULL, 1 FROM d WHERE event_id % 5 = 4)
    SELECT event_id, row::BIGINT AS row, {r('c1', 'c1')}, {r('c2', 'c2')}, width::BIGINT AS width FROM m""")
def _(spark, sf):
    out = readers.vectors_from_json(json_docs(spark, sf), "doc", "event_id")
    return out.select("event_id", "row", F.get("x", 0).alias("c1"), F.get("x", 1).alias("c2"), F.size("x").alias("width"))


@query("s3_to_candidates", f"""WITH {E} SELECT vec_id, label, len(x) AS dim, {r('x[1]', 'first')},
    {r('1.0 / count(*) OVER (PARTITION BY label)', 'w')} FROM e""")
def _(spark, sf):
    out = readers.to_candidates(states(spark, sf), "label", "vec_id", "x")
    return out.select("vec_id", "label", F.size("x").alias("dim"), F.col("x")[0].alias("first"), "w")


@query("s4_superpose", f"""WITH {TARGET}, t AS (SELECT label, sum(d) AS t FROM s GROUP BY label) SELECT vec_id, {r('d / t', 'w')} FROM s JOIN t USING (label)""")
def _(spark, sf):
    """A table that already carries weights keeps them."""
    from latentlake.operators.weights import normalize

    df = normalize(with_target(spark, sf).withColumn("w", vec.l2("x", "q")), "label")
    once = readers.to_candidates(df, "label", "vec_id", "x")
    return readers.to_candidates(once, "label", "vec_id", "x").select("vec_id", "w")


@query("s5_random_candidates")
def _(spark, sf):
    out = generators.random_candidates(states(spark, sf).select("vec_id", "label"), ["vec_id"], 8)
    long = long_form(out, ["vec_id", "label"], "x")
    return long.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lowest"), F.max("v").alias("highest"),
                                     F.avg("v").alias("mean"))


@query("s5_candidate_shape", f"""WITH {E} SELECT label, 8 * count(*) AS n, true AS clipped, true AS spread FROM e GROUP BY label""")
def _(spark, sf):
    """What is certain about random candidates: eight values per row, none outside [-1, 1], not all alike."""
    out = generators.random_candidates(states(spark, sf).select("vec_id", "label"), ["vec_id"], 8)
    return long_form(out, ["vec_id", "label"], "x").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.abs("v") <= 1).alias("clipped"), (F.stddev("v") > 0.1).alias("spread"))


@query("s6_constant_and_ramp", f"""WITH {E} SELECT vec_id, i, 0.0::DOUBLE AS zero, 1.0::DOUBLE AS one, {r('-1 + 2.0 * (i - 1) / 4', 'ramp')},
    {r('x[i] * (-1 + 2.0 * (i - 1) / 4)', 'tilted')} FROM e, unnest(range(1, 6)) t(i)""")
def _(spark, sf):
    z = F.arrays_zip(vec.constant(5, 0.0).alias("zero"), vec.constant(5, 1.0).alias("one"), vec.ramp(-1.0, 1.0, 5).alias("ramp"),
                     F.zip_with(vec.truncate(vec.doubles("x"), 5), vec.ramp(-1.0, 1.0, 5), lambda a, b: a * b).alias("tilted"))
    return states(spark, sf).select("vec_id", F.posexplode(z).alias("i", "z")).select("vec_id", (F.col("i") + 1).alias("i"), "z.*")


@query("s7_random_routes")
def _(spark, sf):
    """Random points for every row and three random orders per label: ranks cover [0, 1] exactly once each."""
    pts = generators.random_points(states(spark, sf).select("label", "vec_id"), ["vec_id"])
    orders = generators.random_orders(pts, ["label"], "vec_id", 3)
    ranks = orders.groupBy("label", "cand").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rank_value").alias("distinct_ranks"),
                                                F.min("rank_value").alias("low"), F.max("rank_value").alias("high"))
    length = routes.route_lengths(orders.join(pts.select("vec_id", "px", "py"), "vec_id"), ["label", "cand"], ["rank_value"], "px", "py")
    return ranks.join(length, ["label", "cand"])


@query("s7_order_shape", f"""WITH {E} SELECT label, cand, count(*) AS n, count(*) AS distinct_ranks, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
    FROM e, unnest(range(0, 3)) t(cand) GROUP BY label, cand""")
def _(spark, sf):
    """What is certain about random orders: every rank from 0 to 1 once per label and candidate."""
    pts = generators.random_points(states(spark, sf).select("label", "vec_id"), ["vec_id"])
    return generators.random_orders(pts, ["label"], "vec_id", 3).groupBy("label", "cand").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("rank_value").alias("distinct_ranks"), F.min("rank_value").alias("low"), F.max("rank_value").alias("high"))


@query("s8_trace_log", f"""WITH {TARGET}, f AS (SELECT *, greatest(1, floor((d - 1e-3) / 0.1) + 1)::BIGINT AS steps FROM s)
    SELECT vec_id::VARCHAR AS label, steps, true AS converged, steps AS n_trace, {r('greatest(0.0, d - steps * 0.1)', 'final_drift')},
    {r('greatest(0.0, d - 0.1)', 'first_drift')} FROM f""")
def _(spark, sf):
    """Trace records appended as JSON lines and read back."""
    df = with_target(spark, sf).withColumn("r0", vec.l2("x", "q"))
    tr = flow.trace(df, ["vec_id"], "r0").groupBy("vec_id").agg(
        F.sort_array(F.collect_list(F.struct("step", "drift"))).alias("t"))
    tr = tr.select("vec_id", F.size("t").alias("steps"), (F.element_at("t", -1)["drift"] < 1e-3).alias("converged"),
                   F.col("t.drift").alias("drift_trace"))
    path = scratch_path(spark, "traces")
    writers.append_traces(tr, "vec_id", path)
    back = spark.read.schema("timestamp string, label string, steps long, converged boolean, drift_trace array<double>, final_drift double").json(path)
    return back.select("label", "steps", "converged", F.size("drift_trace").alias("n_trace"), "final_drift", F.col("drift_trace")[0].alias("first_drift"))


def label_results(spark, sf):
    """Per label a nested result: counts and the list of rows with their distance."""
    df = with_target(spark, sf).withColumn("d", vec.l2("x", "q"))
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_drift"),
                                   F.struct(F.min("d").alias("low"), F.max("d").alias("high")).alias("range"))


RESULT = f"{TARGET} SELECT label, count(*) AS n, {r('avg(d)', 'mean_drift')}"


@query("s9_export_json", f"WITH {RESULT}, {r('min(d)', 'low')}, {r('max(d)', 'high')} FROM s GROUP BY label")
def _(spark, sf):
    path = scratch_path(spark, "results")
    writers.write_json(label_results(spark, sf), path)
    back = spark.read.schema("label int, n long, mean_drift double, range struct<low: double, high: double>").json(path)
    return back.select("label", "n", "mean_drift", "range.low", "range.high")


@query("s10_export_csv", f"WITH {RESULT} FROM s GROUP BY label")
def _(spark, sf):
    path = scratch_path(spark, "flat")
    writers.write_csv(label_results(spark, sf), path)
    return spark.read.csv(path, schema="label int, n long, mean_drift double", header=True)


@query("s11_validated_append", """SELECT event_type IN ('click', 'view', 'purchase') AS accepted, event_type, count(*) AS n
    FROM events GROUP BY event_type""")
def _(spark, sf):
    log, aside = scratch_path(spark, "log"), scratch_path(spark, "quarantine")
    writers.append_validated(table(spark, sf, "events").select("event_id", "event_type"), "event_type", log, aside,
                             ["click", "view", "purchase"])
    schema = "event_id long, event_type string"
    both = spark.read.schema(schema).json(log).withColumn("accepted", F.lit(True)).unionByName(
        spark.read.schema(schema).json(aside).withColumn("accepted", F.lit(False)))
    return both.groupBy("accepted", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("s12_clustered_points")
def _(spark, sf):
    """Every row placed in a two-level cluster tree: mean distance to its own and to its sub-cluster's centre."""
    df = generators.clustered(states(spark, sf), "vec_id")
    out = df
    for level in ("label_l0", "label_l1"):
        mean = df.groupBy(level).agg(vec.mean_vector("x").alias("_m"))
        out = out.join(mean, level).withColumn(f"d_{level}", vec.l2("x", "_m")).drop("_m")
    return out.groupBy("label_l0", "label_l1").agg(F.count(F.lit(1)).alias("n"), F.avg("d_label_l0").alias("to_centre"),
                                                  F.avg("d_label_l1").alias("to_sub_centre"))


@query("s12_cluster_shape", f"""WITH {E}, n AS (SELECT count(*) AS n FROM e) SELECT label_l0::BIGINT AS label_l0, 3::BIGINT AS sub_clusters, n AS n_all,
    32::BIGINT AS dim, true AS nested, true AS tight FROM n, unnest(range(0, 3)) t(label_l0)""")
def _(spark, sf):
    """What is certain about clustered points: three clusters of three, every row in one, closer to its sub-cluster's
    centre than sub-clusters are wide."""
    df = generators.clustered(states(spark, sf), "vec_id")
    mean = df.groupBy("label_l1").agg(vec.mean_vector("x").alias("_m"))
    out = df.join(F.broadcast(mean), "label_l1").withColumn("_d", vec.l2("x", "_m"))  # nine centres
    whole = out.groupBy("label_l0").agg(
        F.countDistinct("label_l1").alias("sub_clusters"), F.count(F.lit(1)).alias("_n"), F.max(F.size("x")).alias("dim"),
        F.bool_and(F.floor(F.col("label_l1") / 3) == F.col("label_l0")).alias("nested"), (F.max("_d") < 0.1 * 32).alias("tight"))
    return whole.withColumn("n_all", df.agg(F.count(F.lit(1))).scalar()).drop("_n")
