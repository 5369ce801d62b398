import numpy as np
import pytest
from helpers import brute, vectors

from latentlake.operators import farfield, pairs


@pytest.fixture(scope="module")
def clusters():
    """Tight and wide clusters, far apart and near, with copies."""
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((9, 5)) * 20
    m = np.vstack([c + rng.standard_normal((30, 5)) * s for c, s in zip(centres, [0.1, 0.1, 0.5, 1, 1, 2, 5, 9, 0.01])])
    m[10:20] = m[10]
    return m


def amplitudes(n):
    return {"re": [0.1 + 0.01 * i for i in range(n)], "im": [0.2] * n}


@pytest.mark.parametrize("error", [0.0, 0.02, 0.1, 0.5])
def test_every_score_is_within_the_error(spark, clusters, error):
    n = len(clusters)
    df = vectors(spark, clusters, g=["a" if i % 3 else "b" for i in range(n)], **amplitudes(n))
    d = brute(clusters)
    g = np.arange(n) % 3 > 0
    loss = np.where(g[:, None] == g[None, :], (1 / (d + 1e-12)) ** 2, 0)
    np.fill_diagonal(loss, 0)
    for cell, block in ((8, 7), (40, 1024)):
        got = farfield.isolation_within(df, "g", "vec_id", "x", error, cell_rows=cell, block_rows=block).collect()
        assert len(got) == n
        for r in got:
            exact = ((0.1 + 0.01 * r.vec_id) ** 2 + 0.04) / loss[r.vec_id].sum()
            assert abs(r.isolation / exact - 1) <= r.off + 1e-6 and r.off <= error + 1e-6


def test_far_cells_are_not_compared(spark, clusters):
    """Clusters far apart: few rows visit the cells of others."""
    base = vectors(spark, clusters[:60], g=["a"] * 60, n=[1] * 60)
    homes = farfield.metric_cells(base, "x", clusters[[0, 30]], None).drop("_core", "_reach")
    seen = farfield._seen(homes, farfield._cells(homes, "g", "x"), "g", "vec_id", "x", 0.05, 1.0).collect()
    assert len(seen) == 60 and all(not r.near and 0 < r.low <= r.high <= r.low * 1.1 for r in seen)


def test_equals_the_exact_form_where_nothing_is_far(spark):
    m = np.random.default_rng(1).standard_normal((80, 16))
    m /= np.linalg.norm(m, axis=1)[:, None]
    df = vectors(spark, m, g=["a"] * 80, **amplitudes(80))
    want = {r.vec_id: r.isolation for r in pairs.isolation(df, "g", "vec_id", "x").collect()}
    for r in farfield.isolation_within(df, "g", "vec_id", "x", 0.01, cell_rows=10).collect():
        assert abs(r.isolation / want[r.vec_id] - 1) <= r.off + 1e-9


def test_edges(spark):
    schema = "vec_id long, x array<double>, g string, re double, im double"
    one = spark.createDataFrame([(1, [1.0, 0.0], None, 1.0, 0.0), (2, [0.0, 3.0], None, 1.0, 0.0), (3, [0.0, 0.0], "a", 1.0, 0.0)], schema)
    got = {r.vec_id: r.isolation for r in farfield.isolation_within(one, "g", "vec_id", "x").collect()}
    assert np.isclose(got[1], 10) and np.isclose(got[2], 10) and np.isclose(got[3], 1e12)
    assert farfield.isolation_within(one.where("false"), "g", "vec_id", "x").collect() == []
    with pytest.raises(ValueError, match="error"):
        farfield.isolation_within(one, "g", "vec_id", "x", 1.0)
