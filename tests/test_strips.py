"""Strips of pairs in single precision: what they can't tell apart is decided by the vectors themselves."""

import numpy as np
import pytest
from helpers import brute, vectors

from latentlake.operators import forest, sketch
from latentlake.operators.sketch import Block


def clouds():
    """Ordinary vectors, distances that differ beyond single precision, vectors far from the origin, numbers that it can't hold, copies of two points."""
    rng = np.random.default_rng(11)
    m = rng.standard_normal((150, 8))
    near = np.repeat(m[:30], 5, 0) + rng.standard_normal((150, 8)) * 1e-9
    return {"plain": m, "close": near, "away": m + 1e6, "tiny": m * 1e-25, "huge": m * 1e18, "grid": rng.integers(0, 3, (150, 8)) / 2.0}


@pytest.mark.parametrize("name", list(clouds()))
def test_counts_are_those_of_direct_distances(name, monkeypatch):
    m = clouds()[name]
    d = brute(m)
    top = d.max()
    levels = np.array(sorted([0.0, 0.25, 0.5, 0.75, *np.sort((d / top).ravel())[::4001], 1.0]))
    p, q, one = Block.of(m), Block.of(m[:70]), np.ones(150, np.int64)
    many = np.arange(1, 151)
    for pairs in (1 << 18, 100):
        monkeypatch.setattr(forest, "STRIP", pairs)
        got = forest._pairs_within(p, p, True, one, one, levels, top)
        assert got == [int(((d / top <= v) & ~np.eye(150, dtype=bool)).sum()) // 2 if v < 1 else 150 * 149 // 2 for v in levels]
        got = forest._pairs_within(p, q, False, many, one[:70], levels, top)
        assert got == [int(many @ (d[:, :70] / top <= v).sum(1)) if v < 1 else int(many.sum()) * 70 for v in levels]


@pytest.mark.parametrize("name", list(clouds()))
def test_tree_and_farthest_pair_in_one_pass(spark, name):
    m = np.unique(clouds()[name], axis=0)
    d = brute(m)
    tree, far = forest.spanned(vectors(spark, m), "vec_id", "x", len(m), 0, block_rows=40)
    want = sum(sorted(w for _, _, w in zip(*forest.spanning_forest(np.where(np.eye(len(m), dtype=bool), np.inf, d)))))
    assert far == d.max() and tree.count() == len(m) - 1
    assert sum(r.d for r in tree.collect()) == pytest.approx(want, rel=1e-12)
    assert sketch.Index(vectors(spark, m), "vec_id", "x", block_rows=40).farthest() == d.max()


def test_strips_are_single_precision_within_their_room():
    m = clouds()["plain"] + 3.0
    a, b, n = Block.of(m[:100]), Block.of(m[100:]), 0
    for s, t, sq, room in sketch.strips(a, b, False, 500):
        assert sq.dtype == np.float32 and sq.size <= 500 and room < 1e-3
        assert np.abs(sq - brute(m)[:100, 100:][s:s + sq.shape[0], t:t + sq.shape[1]] ** 2).max() <= room
        n += sq.size
    assert n == 100 * 50
