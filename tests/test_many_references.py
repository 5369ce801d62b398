"""Operators on reference sets too large to broadcast give what the broadcast ones give; ties of cosine distances."""

import numpy as np
import pytest
from helpers import vectors
from pyspark.sql import functions as F

from latentlake.operators import classify, flow, quality
from latentlake.plans import jobs
from latentlake.streaming.memory import Memory


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    m, q = rng.standard_normal((40, 5)), rng.standard_normal((17, 5))
    refs = spark.createDataFrame([(int(k) * 3, v.tolist(), 0.5 + k / 10, 0.4 + k / 20) for k, v in enumerate(q)], "k long, q array<double>, s double, w double")
    return vectors(spark, m), refs, m, q


def same(a, b, *cols):
    a, b = ({r.vec_id: [np.asarray(r[c], dtype=float) for c in cols] for r in df.collect()} for df in (a, b))
    assert a.keys() == b.keys()
    for k in a:
        for u, v in zip(a[k], b[k]):
            assert np.allclose(u, v, atol=1e-9, equal_nan=True), k


def test_balance(tables):
    df, refs, *_ = tables
    many = quality.balance_of_many(df, "vec_id", "x", refs, "k", "q", 0, 3, block_rows=6)
    same(quality.balance(df, "x", classify.reference_set(refs, "k", "q")), many, "balance", "mean_distance")


def test_potential_and_gradient(tables):
    df, refs, *_ = tables
    held = sorted(refs.collect())
    small = quality.potential(df, "x", classify.reference_set(refs, "k", "q"), [r.s for r in held], [r.w for r in held])
    same(small, quality.potential_of_many(df, "vec_id", "x", refs, "q", "s", "w", block_rows=6), "potential", "gradient")


@pytest.mark.parametrize("field", ["normalize", "damped"])
def test_competition(tables, field):
    df, refs, *_ = tables
    small = classify.compete(df, "x", classify.reference_set(refs, "k", "q"), field, 0.3, 0.5, 6)
    many = classify.compete_of_many(df, "vec_id", "x", refs, "k", "q", field, 0.3, 0.5, 6, block_rows=9)
    same(small, many, "x_final", "steps", "winner", "d1", "margin", "certainty")
    a = classify.competition_summary(small, classify.reference_set(refs, "k", "q"))
    b = classify.competition_summary_of_many(many, refs, "k")
    key = lambda r: (r.winner, r.n, round(r.mean_certainty, 9), r.contested, r.total)
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


def test_cosine_ties_go_to_the_smaller_id(spark):
    """Many candidates in the same direction: their product forms differ in the last digit, their direct ones hardly."""
    rng = np.random.default_rng(9)
    m = np.repeat(rng.standard_normal((6, 24)), 8, axis=0) * 2.0 ** rng.integers(-3, 4, 48)[:, None]
    points = rng.standard_normal((5, 24))
    refs = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(points)], "k long, q array<double>")
    direct = np.array([[1 - (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())) for b in points] for a in m])
    want = {k: int(np.argmin(direct[:, k])) for k in range(5)}
    one = classify.best_equivalent(vectors(spark, m), "vec_id", "x", classify.reference_set(refs, "k", "q"), 2.0, "cosine")
    many = classify.best_equivalent_of_many(vectors(spark, m), "vec_id", "x", refs, "k", "q", 2.0, "cosine", block_rows=7)
    assert {r.target: r.best_id for r in one.collect()} == want == {r.target: r.best_id for r in many.collect()}
    least = {k: float(direct[:, k].min()) for k in range(5)}
    at = classify.best_equivalent(vectors(spark, m), "vec_id", "x", classify.reference_set(refs.where("k = 2"), "k", "q"), least[2], "cosine")
    assert at.first().best_id == want[2]


def test_tails_of_a_user_field(spark, tables):
    df, _, m, _ = tables
    rows = df.withColumn("q", F.array(*[F.lit(0.0)] * 5))
    out = flow.flow_with(rows, "x", "q", lambda x, q: q - x, 0.1, 1e-3, 25, last=4).collect()
    for r in out:
        start = np.linalg.norm(m[r.vec_id])
        assert r.steps == 25 and np.allclose(r.tail, [start * 0.9 ** k for k in range(22, 26)])
    short = flow.flow_with(rows, "x", "q", lambda x, q: q - x, 0.1, 1e-3, 2, last=4).collect()
    assert all(len(r.tail) == 2 for r in short)


def test_the_job_with_own_parts(spark, tables):
    """A field, a rule that looks at the memory, and a memory of the caller's own; plain numpy beside it."""
    _, _, m, q = tables
    df = vectors(spark, m, label=[int(i % 2) for i in range(len(m))])
    goal = spark.createDataFrame([(0, q[0].tolist()), (1, q[1].tolist())], "label long, q array<double>")
    mem = Memory(5, scale=2)
    w_in, _, w_out = mem.matrices()
    high = 0.08
    rule = quality.memory_norm_rule("x_final", "h", 10.0, high)
    out = {r.label: r for r in jobs.evaluate(df, goal, max_steps=8, fn=lambda x, to: to - x, rule=rule, memory=mem).collect()}
    for label in (0, 1):
        end = q[label] + (m[label::2] - q[label]) * 0.9 ** 8
        h = mem.leak * np.tanh(end @ w_in.T)
        bad = np.linalg.norm(h, axis=1) > high
        left = np.linalg.norm(np.where(bad[:, None], end * 0.9, end) - q[label], axis=1)
        best = int(np.argmin(left))
        r = out[label]
        assert r.winner == 2 * best + label and r.fold_corrections == bad.sum() and r.total_steps == 8 * len(end)
        assert np.allclose(r.memory, h[best] @ w_out.T)
        assert r.mean_recent == pytest.approx(np.mean([np.linalg.norm(m[label::2][best] - q[label]) * 0.9 ** k for k in range(1, 9)]))
