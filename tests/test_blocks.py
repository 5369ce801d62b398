"""Pair searches return results only, whatever the number of blocks."""

import numpy as np
import pytest
from helpers import brute, vectors

from latentlake.operators import graph, sketch
from latentlake.operators.kernels import forest_edges, join_sets, parts_of


def cloud(n=240):
    m = np.random.default_rng(6).standard_normal((n, 12))
    return m / np.linalg.norm(m, axis=1)[:, None]


@pytest.mark.parametrize("cell", [10**6, 60])
def test_searches_return_no_candidates(spark, cell):
    """Exactly k neighbours a row and exactly the pairs within, with distances, from blocks of 20 rows."""
    m, k = cloud(), 5
    d = brute(m)
    index = sketch.Index(vectors(spark, m), "vec_id", "x", cell_rows=cell, block_rows=20)
    near = index.nearest(k).collect()
    assert len(near) == k * len(m)
    np.fill_diagonal(d, np.inf)
    assert {(r.a, r.b) for r in near} == {(i, int(j)) for i in range(len(m)) for j in np.argsort(d[i])[:k]}
    assert all(abs(r.d - d[r.a, r.b]) < 1e-12 for r in near)
    assert {(r.a, r.b) for r in index.within(0.9).collect()} == {(i, j) for i, j in zip(*np.nonzero(np.triu(d <= 0.9)))}


def test_a_forest_holds_the_tree_in_few_edges(spark):
    m = cloud()
    d = brute(m)
    index = sketch.Index(vectors(spark, m), "vec_id", "x", block_rows=20)
    edges = index.forest().collect()
    blocks = int(index.cells.blocks.sum())
    assert len(edges) <= blocks * len(m) + len(m)  # below two edges a row and block
    a, b, w = (np.array([r[c] for r in edges]) for c in range(3))
    i, j = np.triu_indices(len(m), 1)
    want = join_sets(i, j, np.argsort(d[i, j]))[2]
    assert np.allclose(np.sort(w[forest_edges(a, b, w, len(m))]), np.sort(d[i, j][want]), atol=1e-12)


def test_forests_and_parts_of_edge_lists():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n, m = rng.integers(2, 60), rng.integers(1, 90)
        a, b, w = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 5, m).astype(float)
        nodes, root, _ = join_sets(a, b)
        assert (parts_of(a, b, n)[nodes] == root).all()
        keep, used = forest_edges(a, b, w, n), join_sets(a, b, np.argsort(w, kind="stable"))[2]
        assert len(keep) == used.sum() and w[keep].sum() == w[used].sum()


def test_shape_of_a_table_in_one_large_block(spark):
    """All pairs linked: as many edges as pairs, one component, in blocks of two sizes."""
    m = cloud(90)
    for block in (None, 11):
        got = graph.shape_at(vectors(spark, m), "vec_id", "x", 2.0, block_rows=block).first()
        assert (got["edges"], got["components"]) == (90 * 89 // 2, 1)
