import numpy as np
from helpers import brute, vectors

from latentlake.operators import graph, pairs, reduction
from latentlake.sources import generators


def test_pca_against_eigenvalues(spark):
    rng = np.random.default_rng(0)
    m = rng.standard_normal((80, 6)) * np.array([5, 3, 2, 1, 0.5, 0.1])
    p = reduction.fit_pca(vectors(spark, m), "x", 3)
    values = np.sort(np.linalg.eigvalsh(np.cov(m, rowvar=False)))[::-1]
    assert np.allclose(p.ratio, values[:3] / values.sum())
    z = np.array([r.z for r in reduction.squeeze(vectors(spark, m), "x", p).orderBy("vec_id").collect()])
    assert np.allclose(z.mean(0), 0, atol=1e-9) and np.allclose(z.var(0, ddof=1), values[:3])
    back = np.array([r.b for r in reduction.unsqueeze(reduction.squeeze(vectors(spark, m), "x", p), "z", p, "b").orderBy("vec_id").collect()])
    c = m - m.mean(0)
    _, axes = np.linalg.eigh(np.cov(m, rowvar=False))
    top = axes[:, ::-1][:, :3]
    assert np.allclose(back, c @ top @ top.T + m.mean(0))
    assert p.compression == 2.0


def test_pca_of_one_row_and_of_equal_rows(spark):
    p = reduction.fit_pca(vectors(spark, [[1.0, 2.0, 3.0]]), "x", 2)
    assert p.ratio.tolist() == [0.5, 0.5] and reduction.squeeze(vectors(spark, [[1.0, 2.0, 3.0]]), "x", p).first().z == [1.0, 2.0]
    assert reduction.fit_pca(vectors(spark, [[1.0, 2.0, 3.0]] * 4), "x", 2).ratio.tolist() == [0.5, 0.5]


def test_pca_far_from_the_origin(spark):
    m = np.random.default_rng(5).standard_normal((60, 4)) * [3, 2, 1, 0.5] + 1e6
    values = np.sort(np.linalg.eigvalsh(np.cov(m, rowvar=False)))[::-1]
    assert np.allclose(reduction.fit_pca(vectors(spark, m), "x", 2).ratio, values[:2] / values.sum(), rtol=1e-6)


def test_no_squeeze_needed(spark):
    m = np.arange(8.0).reshape(2, 4)
    p = reduction.fit_pca(vectors(spark, m), "x", 9)
    assert [r.z for r in reduction.squeeze(vectors(spark, m), "x", p).orderBy("vec_id").collect()] == m.tolist()


def test_cascade_equals_repeated_fits(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((60, 16)) * np.linspace(4, 0.5, 16)
    long, ratios = reduction.cascade(vectors(spark, m), "vec_id", "x", levels=4, min_dim=3)
    got = {(r.level, r.component): r.ratio for r in ratios.collect()}
    current = m
    for level, dim in ((1, 8), (2, 4), (3, 3)):
        values, axes = np.linalg.eigh(np.cov(current, rowvar=False))
        values, axes = values[::-1], axes[:, ::-1]
        assert np.allclose([got[level, i + 1] for i in range(dim)], values[:dim] / values.sum())
        current = (current - current.mean(0)) @ axes[:, :dim]
        z = np.array([r.z for r in long.where(f"level = {level}").orderBy("vec_id").collect()])
        assert np.allclose(np.abs(z), np.abs(current), atol=1e-8)
    assert reduction.cascade_dims(64, 8, 10) == [64, 32, 16, 10, 10, 10, 10, 10]


def test_intrinsic_dimension_of_a_known_subspace(spark):
    df = generators.low_rank(spark.range(300).withColumnRenamed("id", "vec_id"), "vec_id", noise=0.01)
    r = reduction.intrinsic_dimension(df, "x").first()
    assert r.d == 16 and r.dim_by_variance <= 4 and r.dim_by_error == 4


def test_random_projection_keeps_lengths(spark):
    rng = np.random.default_rng(2)
    m = rng.standard_normal((50, 200))
    z = reduction.squeeze(vectors(spark, m), "x", reduction.random_projection(200, 64)).orderBy("vec_id").collect()
    ratio = brute(np.array([r.z for r in z]))[np.triu_indices(50, 1)] / brute(m)[np.triu_indices(50, 1)]
    assert abs(ratio.mean() - 1) < 0.1


def test_landmarks_recover_a_plane(spark):
    """Straight distances to landmarks in a plane: the embedding reproduces all distances."""
    rng = np.random.default_rng(3)
    m = rng.random((40, 2))
    d = brute(m)
    src = [0, 5, 9, 20, 31]
    far = spark.createDataFrame([(s, i, float(d[s, i])) for s in src for i in range(40)], "source long, node long, d double")
    y = np.array([r.y for r in reduction.landmark_embedding(far, src, 3).orderBy("node").collect()])
    assert y.shape == (40, 3) and np.allclose(brute(y), d, atol=1e-6)


def test_least_squares_and_geodesics(spark):
    rng = np.random.default_rng(4)
    m = rng.standard_normal((70, 5))
    w = rng.standard_normal((2, 5))
    df = vectors(spark, m)
    y = spark.createDataFrame([(i, (w @ (v - m.mean(0))).tolist()) for i, v in enumerate(m)], "vec_id long, y array<double>")
    assert np.allclose(reduction.least_squares(df.join(y, "vec_id"), "x", "y", m.mean(0)), w)
    edges = pairs.neighbour_graph(df, "vec_id", "x", 4)
    g = np.full((70, 70), np.inf)
    for r in edges.collect():
        g[r.a, r.b] = r.d
    np.fill_diagonal(g, 0)
    for k in range(70):
        g = np.minimum(g, g[:, [k]] + g[[k], :])
    for r in graph.geodesics(edges, [3, 11]).collect():
        assert abs(g[r.source, r.node] - r.d) < 1e-9
    assert graph.geodesics(edges, [3, 11]).count() == np.isfinite(g[[3, 11]]).sum()
