"""Closed forms against the stepwise definition, and the fixed acceptance figures."""

import numpy as np
import pytest
from helpers import vectors
from pyspark.sql import functions as F

from latentlake.functions import vec
from latentlake.operators import classify, flow, ordered, quality, weights


def radii(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "vec_id long, r0 double")


R0 = [0.0, 1e-13, 5e-4, 0.05, 0.0501, 0.3, 0.96, 1.0, 1.07, 2.345, 7.7, 31.0]


@pytest.mark.parametrize("field", ["normalize", "damped", "adaptive", "repulsive"])
def test_closed_form_equals_recurrence(spark, field):
    df = radii(spark, R0)
    step = {r.vec_id: r for r in flow.relax_by_steps(df, "r0", field, 0.1, 1e-3, 120).collect()}
    need = flow.steps_needed(field, "r0", 0.1, 1e-3)
    closed = df.withColumn("steps", F.coalesce(F.least(need, F.lit(120)), F.lit(120))).withColumn("ok", F.coalesce(need <= 120, F.lit(False)))
    for r in closed.withColumn("r", flow.radius_at(field, "r0", "steps", 0.1)).collect():
        assert (r.steps, r.ok) == (step[r.vec_id].steps, step[r.vec_id].converged), (field, r)
        assert abs(r.r - step[r.vec_id].r_final) < 1e-9


def test_vector_loop_equals_radial_form(spark):
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((40, 6)) * 2, rng.standard_normal(6)
    df = vectors(spark, x).withColumn("q", vec.vec_literal(q))
    for field in ("normalize", "damped", "sin"):
        g = flow.GAINS[field]

        def fn(a, b, g=g):
            diff = b - a
            r = np.sqrt((diff * diff).sum(1, keepdims=True))
            return np.where(r < 1e-12, 0.0, g(r) * diff / np.maximum(r, 1e-12))

        loop = {r.vec_id: r for r in flow.flow_with(df, "x", "q", fn, max_steps=200).collect()}
        for r in flow.relax(df, "x", "q", field, max_steps=200).collect():
            assert (r.steps, r.converged) == (loop[r.vec_id].steps, loop[r.vec_id].converged)
            assert np.allclose(r.x_final, loop[r.vec_id].x_final, atol=1e-9)


def test_two_dimensional_toy_takes_eight_steps(spark):
    df = vectors(spark, [[0.0, 0.0]]).withColumn("q", vec.vec_literal([1.0, 1.0]))
    r = flow.relax(df, "x", "q", "normalize", epsilon=0.2).first()
    assert r.steps == 8 and r.converged


def test_sin_field_traps_on_a_ring(spark):
    out = flow.relax_by_steps(radii(spark, [2.0, 4.0, 8.0, 10.0]), "r0", "sin", 0.1, 1e-3, 5000).collect()
    assert out[0].converged and not out[1].converged
    assert abs(out[1].r_final - 2 * np.pi) < 0.1 and abs(out[3].r_final - 4 * np.pi) < 0.1


def test_trace_matches_summary(spark):
    df = radii(spark, [0.05, 0.96, 2.3, 5.5])
    for field in ("normalize", "damped", "sin", "descent"):
        tr = flow.trace(df, ["vec_id"], "r0", field, max_steps=80).groupBy("vec_id").agg(
            F.max("step").alias("n"), F.max_by("drift", "step").alias("last")).collect()
        by = {r.vec_id: r for r in tr}
        if field == "sin":
            want = {r.vec_id: r.steps for r in flow.relax_by_steps(df, "r0", field, 0.1, 1e-3, 80).collect()}
        else:
            want = {r.vec_id: r.s for r in df.withColumn("s", F.least(flow.steps_needed(field, "r0", 0.1, 1e-3), F.lit(80))).collect()}
        assert {k: by[k].n for k in want} == want


def test_repulsive_drift_grows(spark):
    r = radii(spark, [0.02, 1.0]).withColumn("r", flow.radius_at("repulsive", "r0", F.lit(50), 0.1)).collect()
    assert all(x.r > x.r0 for x in r)


def test_recursive_terminations(spark):
    out = {r.vec_id: r for r in flow.recursive(radii(spark, [0.0005, 1.0, 1.05, 300.0]), "r0", max_iterations=5, inner_steps=50).collect()}
    assert out[0].termination == "attractor_reached" and out[1].termination == "attractor_reached"
    assert out[2].termination == "fixed_point" and abs(out[2].rho) > 1e-3  # swings around the target for ever
    assert out[3].termination == "timeout" and out[3].iterations == 5


def test_coupled_flow_tightens_and_stops(spark):
    rng = np.random.default_rng(2)
    df = vectors(spark, rng.standard_normal((30, 3)), g=["a"] * 15 + ["b"] * 15).withColumn("q", vec.vec_literal([0.0, 0.0, 0.0]))
    one = flow.coupled(df, "g", "vec_id", "x", "q", max_steps=3, fix_every=2)
    plain = flow.relax(df, "x", "q", max_steps=3)
    assert one.agg(F.avg("d")).first()[0] < plain.agg(F.avg("r_final")).first()[0]
    done = flow.coupled(df, "g", "vec_id", "x", "q", field="damped", epsilon=0.9, max_steps=40, fix_every=4)
    assert done.agg(F.max("d")).first()[0] < 1e-3


def test_bad_parameters_and_dimensions(spark):
    for kw in (dict(epsilon=1.0), dict(epsilon=0.0), dict(tol=0.0), dict(max_steps=0)):
        with pytest.raises(ValueError):
            flow.check_parameters(**{**dict(epsilon=0.1, tol=1e-3, max_steps=10), **kw})
    mixed = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, x array<double>")
    with pytest.raises(ValueError):
        quality.validate(mixed, "x")
    wide = spark.range(1).select("id", F.array_repeat(F.lit(1.0), 1025).alias("x"))
    with pytest.raises(ValueError):
        quality.validate(wide, "x")


def test_strict_contract_raises(spark):
    run = spark.createDataFrame([(1, "normalize", False)], "vec_id long, field string, converged boolean")
    with pytest.raises(RuntimeError):
        flow.check_contract(run, strict=True)


def test_user_function_with_bad_values_stays_put(spark):
    df = vectors(spark, [[1.0, 2.0], [3.0, 4.0]]).withColumn("q", vec.vec_literal([0.0, 0.0]))
    out = flow.flow_with(df, "x", "q", lambda a, b: np.full_like(a, np.nan), max_steps=5).collect()
    assert [r.x_final for r in out] == [[1.0, 2.0], [3.0, 4.0]] and not any(r.converged for r in out)


def test_two_clusters_are_told_apart(spark):
    rng = np.random.default_rng(42)
    x = np.vstack([rng.standard_normal((20, 4)) * 0.3, 5 + rng.standard_normal((20, 4)) * 0.3])
    df = vectors(spark, x, own=["legit"] * 20 + ["anomalous"] * 20)
    refs = classify.ReferenceSet(["anomalous", "legit"], np.array([[5.0] * 4, [0.0] * 4]))
    for out in (classify.nearest(df, "x", refs), classify.compete(df, "x", refs, "damped", max_steps=3)):
        assert out.where("winner = own").count() == 40
    assert classify.nearest(df, "x", refs).agg(F.avg("certainty")).first()[0] > 0.5


def test_tie_and_single_reference(spark):
    df = vectors(spark, [[2.5] * 4])
    refs = classify.ReferenceSet(["a", "b"], np.array([[0.0] * 4, [5.0] * 4]))
    r = classify.nearest(df, "x", refs).first()
    assert r.winner == "a" and r.contested and r.margin == 0.0
    one = classify.nearest(df, "x", classify.ReferenceSet(["a"], refs.points[:1])).first()
    assert one.certainty == 1.0 and one.d2 == float("inf")


def test_many_references_in_small_blocks(spark):
    rng = np.random.default_rng(4)
    x, q = rng.standard_normal((50, 3)), rng.standard_normal((33, 3))
    refs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "key int, q array<double>")
    got = classify.nearest_of_many(vectors(spark, x), "vec_id", "x", refs, "key", "q", block_rows=6)
    d = np.sqrt(((x[:, None] - q[None, :]) ** 2).sum(2))
    for r in got.collect():
        assert r.winner == d[r.vec_id].argmin() and abs(r.d2 - np.sort(d[r.vec_id])[1]) < 1e-9
    assert got.count() == 50


def test_reference_set_refuses_what_is_too_large(spark):
    refs = spark.createDataFrame([(i, [0.0] * 8) for i in range(100)], "key int, q array<double>")
    assert classify.reference_set(refs, "key", "q", limit=1000) is None
    assert len(classify.reference_set(refs, "key", "q").keys) == 100


def test_weights_of_far_rows_do_not_underflow(spark):
    df = spark.createDataFrame([("a", 1, 5000.0), ("a", 2, 5001.0)], "g string, vec_id long, d double")
    w = sorted(r.w for r in weights.softmax(df, "g", "d").collect())
    assert abs(w[1] / w[0] - np.e) < 1e-9 and abs(sum(w) - 1) < 1e-12


def test_audit_budget(spark):
    df = vectors(spark, [[float("nan"), 1.0]] * 10)
    out = quality.audit(df, "vec_id", "x", quality.finite_rule("x"), max_corrections=3)
    assert sorted(r.vec_id for r in out.where("corrected").collect()) == [0, 1, 2]
    assert quality.audit(df, "vec_id", "x", quality.finite_rule("x")).where("corrected").count() == 10
    assert quality.audit(df, "vec_id", "x", quality.finite_rule("x"), max_corrections=0).where("corrected").count() == 0
    assert quality.audit(df, "vec_id", "x", quality.finite_rule("x"), max_corrections=99).where("corrected").count() == 10


def test_kth_smallest(spark):
    rng = np.random.default_rng(6)
    some = [*rng.integers(-2**62, 2**62, 40).tolist(), *rng.integers(-50, 50, 60).tolist(), -2**63, 2**63 - 1, 7, 7, 7]
    df = spark.createDataFrame([(v,) for v in [*some, None]], "id long")
    for bits, places in ((8, (1, 53, 104)), (16, (2, 80, 200))):
        for k in places:
            assert ordered.kth_smallest(df, "id", k, bits) == sorted(some)[min(k, len(some)) - 1]
    assert ordered.kth_smallest(df, "id", 0) is None and ordered.kth_smallest(df.where("false"), "id", 3) is None
