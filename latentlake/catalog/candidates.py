"""Weighted candidates, nearest references, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from latentlake.catalog.base import (MEANS, TARGET, WEIGHTED, exploded, label_means, label_references, long_form, query, r,
                                     states, with_target)
from latentlake.functions import vec
from latentlake.operators import classify, weights
from latentlake.plans.runtime import join_groups, materialize


def weighted(spark, sf):
    """States with distance d to their label's mean and softmax weight w within the label."""
    df = with_target(spark, sf).withColumn("d", vec.l2("x", "q"))
    return weights.softmax(df, "label", "d")


@query("a0_normalized_weights", f"""WITH {TARGET}, t AS (SELECT label, sum(d) AS t, count(*) AS n FROM s GROUP BY label)
    SELECT vec_id, {r('d / t', 'w')}, {r('1.0 / n', 'uniform')} FROM s JOIN t USING (label)""")
def _(spark, sf):
    df = with_target(spark, sf).withColumn("w", vec.l2("x", "q"))
    return weights.normalize(weights.uniform(df, "label", "uniform"), "label").select("vec_id", "w", "uniform")


@query("a1_softmax_weights", f"WITH {WEIGHTED} SELECT vec_id, {r('w', 'w')} FROM wt")
def _(spark, sf):
    return weighted(spark, sf).select("vec_id", "w")


@query("a2_entropy", f"WITH {WEIGHTED} SELECT label, count(*) AS n, {r('-sum(w * log2(w))', 'entropy')} FROM wt WHERE w > 0 GROUP BY label")
def _(spark, sf):
    return weights.summary(weighted(spark, sf), "label")


@query("a3_weighted_centroid", f"""WITH {WEIGHTED} SELECT label, i, {r('sum(w * x[i]) / sum(w)', 'v')}
    FROM wt, unnest(range(1, 65)) t(i) GROUP BY label, i""")
def _(spark, sf):
    return long_form(weights.centroids(weighted(spark, sf), "label", "x", "w"), ["label"], "q")


@query("a4_centroid", f"WITH {MEANS} {exploded('means', 'label', 'q')}")
def _(spark, sf):
    return long_form(label_means(spark, sf), ["label"], "q")


@query("a5_collapse_to_best", f"""WITH {TARGET} SELECT label, vec_id, {r('d', 'd')} FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS rn FROM s) WHERE rn = 1""")
def _(spark, sf):
    return weights.collapse_to_best(with_target(spark, sf).withColumn("d", vec.l2("x", "q")), "label", "vec_id", "d")


@query("a6_candidate_count", "SELECT label::BIGINT AS label, count(*) AS n FROM embeddings GROUP BY label")
def _(spark, sf):
    return states(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


TOP = f"""{WEIGHTED}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY w DESC, vec_id) AS rank
    FROM wt) WHERE rank <= 10), pt AS (SELECT label, sum(w) AS t FROM top GROUP BY label)"""


@query("t1_prune", f"WITH {TOP} SELECT label, vec_id, {r('w / pt.t', 'w')} FROM top JOIN pt USING (label)")
def _(spark, sf):
    return weights.prune(weighted(spark, sf), "label", "vec_id", 10).select("label", "vec_id", "w")


@query("t2_reorder", f"""WITH {WEIGHTED} SELECT vec_id, {r('w', 'w')}, row_number() OVER (PARTITION BY label
    ORDER BY -w, vec_id) AS rank, {r('-x[1]', 'memory')} FROM wt""")
def _(spark, sf):
    df = weighted(spark, sf)
    memory = states(spark, sf).select("vec_id", vec.scale("x", F.lit(-1.0)).alias("h"))
    out = weights.with_memory(weights.reorder(df, "label", "vec_id"), memory, "vec_id")
    return out.select("vec_id", "w", "rank", F.col("h")[0].alias("memory"))


@query("r5_attached_memory", f"""WITH {TOP} SELECT label, vec_id, rank, {r('w / pt.t', 'w')}, {r('x[1] * 2', 'memory')}
    FROM top JOIN pt USING (label)""")
def _(spark, sf):
    memory = states(spark, sf).select("vec_id", vec.scale("x", F.lit(2.0)).alias("h"))
    kept = weights.with_memory(weights.prune(weighted(spark, sf), "label", "vec_id", 10), memory, "vec_id")
    return kept.select("label", "vec_id", F.col("rn").alias("rank"), "w", F.col("h")[0].alias("memory"))


@query("j1_static_drift", f"""WITH {TARGET} SELECT label, count(*) AS n, {r('avg(d)', 'mean_drift')}, {r('min(d)', 'min_drift')},
    {r('max(d)', 'max_drift')} FROM s GROUP BY label""")
def _(spark, sf):
    df = with_target(spark, sf).withColumn("d", vec.l2("x", "q"))
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_drift"),
                                   F.min("d").alias("min_drift"), F.max("d").alias("max_drift"))


@query("j2_best_equivalent", f"""WITH {MEANS}, c AS (SELECT means.label AS target, vec_id, list_distance(x, q) AS d FROM e, means),
    k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY d, vec_id) AS rn FROM c)
    SELECT target, {r('d', 'd')}, CASE WHEN d <= 0.95 THEN vec_id ELSE -1 END AS best_id FROM k WHERE rn = 1""")
def _(spark, sf):
    return classify.best_equivalent(states(spark, sf), "vec_id", "x", label_references(spark, sf), 0.95)


def equivalents(distance: str) -> str:
    return f"""WITH {MEANS}, c AS (SELECT means.label AS target, vec_id, {distance} AS d FROM e, means),
    k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY d, vec_id) AS rn FROM c)
    SELECT target, {r('d', 'd')}, CASE WHEN d <= 0.95 THEN vec_id ELSE -1 END AS best_id FROM k WHERE rn = 1"""


@query("j2_best_equivalent_cosine", equivalents("1 - list_cosine_similarity(x, q)"))
def _(spark, sf):
    return classify.best_equivalent(states(spark, sf), "vec_id", "x", label_references(spark, sf), 0.95, "cosine")


@query("j2_best_of_many", equivalents("list_distance(x, q)"))
def _(spark, sf):
    """The plan for targets that don't fit into every task."""
    return classify.best_equivalent_of_many(states(spark, sf), "vec_id", "x", label_means(spark, sf), "label", "q", 0.95)


NEAREST = f"""{MEANS}, c AS (SELECT vec_id, e.label AS own, means.label AS lab, list_distance(x, q) AS d FROM e, means),
    k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, lab) AS rn FROM c),
    v AS (SELECT vec_id, any_value(own) AS own, max(lab) FILTER (WHERE rn = 1) AS winner, max(d) FILTER (WHERE rn = 1) AS d1,
        max(d) FILTER (WHERE rn = 2) AS d2 FROM k GROUP BY vec_id)"""
VERDICT = f"""{r('d2 - d1', 'margin')}, {r('greatest(0.0, least(1.0, 1 - d1 / greatest(d2, 1e-12)))', 'certainty')},
    d2 - d1 < 0.01 AS contested"""


@query("j3_nearest_centroid", f"""WITH {NEAREST} SELECT vec_id, winner, winner AS winner_idx, {r('d1', 'd1')}, {r('d2', 'd2')}, {VERDICT} FROM v""")
def _(spark, sf):
    out = classify.nearest(states(spark, sf), "x", label_references(spark, sf))
    return out.select("vec_id", "winner", "winner_idx", "d1", "d2", "margin", "certainty", "contested")


@query("j3_nearest_of_many", f"WITH {NEAREST} SELECT vec_id, winner, {r('d1', 'd1')}, {r('d2', 'd2')}, {VERDICT} FROM v")
def _(spark, sf):
    return classify.nearest_of_many(states(spark, sf), "vec_id", "x", label_means(spark, sf), "label", "q")


@query("a7_competition_summary", f"""WITH {NEAREST}, z AS (SELECT winner, count(*) AS n FROM v GROUP BY winner)
    SELECT means.label AS winner, coalesce(n, 0) AS n, {r('''(SELECT avg(greatest(0.0, least(1.0, 1 - d1
    / greatest(d2, 1e-12)))) FROM v)''', 'mean_certainty')}, (SELECT count(*) FILTER (WHERE d2 - d1 < 0.01) FROM v) AS contested,
    (SELECT count(*) FROM v) AS total FROM means LEFT JOIN z ON z.winner = means.label""")
def _(spark, sf):
    refs = label_references(spark, sf)
    return classify.competition_summary(classify.nearest(states(spark, sf), "x", refs), refs)


@query("l5_two_class_check", f"""WITH {MEANS}, c AS (SELECT vec_id, e.label AS own, means.label AS lab, list_distance(x, q) AS d
    FROM e, means WHERE means.label IN (0, 1)),
    v AS (SELECT vec_id, any_value(own) AS own, min(d) AS d1, max(d) AS d2, min_by(lab, struct_pack(a := d, b := lab)) AS winner
        FROM c GROUP BY vec_id)
    SELECT own, winner, count(*) AS n, {r('avg(greatest(0.0, 1 - d1 / d2))', 'mean_certainty')} FROM v GROUP BY own, winner""")
def _(spark, sf):
    """Two references compete for every row; counted by the row's own label."""
    refs = label_references(spark, sf)
    two = classify.ReferenceSet(refs.keys[:2], refs.points[:2])
    out = classify.nearest(states(spark, sf), "x", two)
    return out.groupBy(F.col("label").alias("own"), "winner").agg(F.count(F.lit(1)).alias("n"),
                                                                 F.avg("certainty").alias("mean_certainty"))
