"""Paths between all rows when the edges are too many to be sent with the tasks."""

import os

import numpy as np
import pytest
from helpers import vectors

from latentlake.operators import kernels, pairs, paths
from latentlake.plans import runtime


def links(rng, n, m):
    """Edges both ways, sorted by the node they enter; a few nodes have none."""
    a, b = rng.integers(0, n - 3, (2, m))
    a, b, w = a[a != b], b[a != b], rng.random(m)[a != b] + 0.1
    a, b, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    order = np.argsort(b, kind="stable")
    return a[order], b[order], w[order]


def test_many_edges_are_files_and_not_tables_of_paths(spark, monkeypatch):
    """Edges and points are written once; what else is kept does not grow with rows times rows."""
    m = np.random.default_rng(4).standard_normal((400, 6))
    df = vectors(spark, m).selectExpr("vec_id * 3 - 50 AS vec_id", "x", "slice(x, 1, 2) AS z")
    edges = runtime.materialize(pairs.neighbour_graph(df, "vec_id", "x", 5))
    few = paths.path_profile(edges, df, "vec_id", "z", [0.25, 0.5, 1.0])
    kept = []
    monkeypatch.setattr(paths, "materialize", lambda t: kept.append(runtime.materialize(t)) or kept[-1])
    many = paths.path_profile(edges, df, "vec_id", "z", [0.25, 0.5, 1.0], 0)
    assert (many.pairs, many.counts, many.longest) == (few.pairs, few.counts, few.longest) and many.distortion == pytest.approx(few.distortion, abs=1e-12)
    assert max(t.count() for t in kept) <= edges.count()
    place = [p for p in runtime._scratch if "/paths-" in p][-1].removeprefix("file://")
    assert sum(os.path.getsize(f"{place}/{f}") for f in os.listdir(place)) < 28 * edges.count() + 24 * 400 + 1


def test_blocks_hold_few_paths(spark, monkeypatch):
    """A task's paths are bounded, whatever the number of rows."""
    m = np.random.default_rng(4).standard_normal((90, 6))
    df = vectors(spark, m).selectExpr("vec_id", "x", "slice(x, 1, 2) AS z")
    edges = pairs.neighbour_graph(df, "vec_id", "x", 5)
    want = paths.path_profile(edges, df, "vec_id", "z", [0.5])
    for cells in (90 * 7, 1):
        monkeypatch.setattr(paths, "CELLS", cells)
        got = paths.path_profile(edges, df, "vec_id", "z", [0.5])
        assert (got.pairs, got.counts, got.longest) == (want.pairs, want.counts, want.longest) and got.distortion == pytest.approx(want.distortion, abs=1e-12)


@pytest.mark.parametrize("dear", [0.0, 6.0, 1e9])
def test_both_ways_to_relax_give_the_same_paths(dear):
    """Paths one by one along leaving edges, all paths along entering edges, and whichever is cheaper: digit by digit."""
    rng = np.random.default_rng(7)
    n = 300
    a, b, w = links(rng, n, 700)
    own = np.array([0, 5, 17, 298])
    want = np.full((n, len(own)), np.inf)
    want[own, np.arange(len(own))] = 0.0
    for _ in range(n):
        last = want.copy()
        np.minimum.at(want, b, last[a] + w[:, None])
        if (want == last).all():
            break
    assert (kernels.relax(own, kernels.Links.of(a, b, w, n), n, 16, 8, dear) == want).all()


def test_a_block_is_profiled_in_strips(monkeypatch):
    """Strips of any size give the counts and sums of all paths at once; what is held beside the paths is a strip."""
    rng = np.random.default_rng(3)
    n, own, levels = 90, np.array([3, 50, 89]), np.array([0.0, 0.3, 0.9, 1.0])
    path, points = rng.random((n, 3)) * 5, rng.standard_normal((n, 2))
    path[own, np.arange(3)], path[7], path[8, 1] = 0.0, np.inf, 0.0
    straight = np.sqrt(((points[:, None] - points[own][None]) ** 2).sum(2))
    good, off = np.isfinite(path) & (path > 0), np.ones((n, 3), bool)
    off[own, np.arange(3)] = False
    want = [int((path[off & np.isfinite(path)] / 5 <= v).sum()) for v in levels]
    for strip in (1 << 16, 10, 1):
        monkeypatch.setattr(paths, "STRIP", strip)
        got, gap, top, counts = paths._profiled(path.copy(), points, own, levels, 5.0, 4.0)
        assert (got, top, counts.tolist()) == (good.sum(), path[good].max(), want)
        assert gap == pytest.approx(np.abs(path[good] / 5 - straight[good] / 4).sum(), abs=1e-9)


def test_diagnostics_ship_vectors_as_they_are_stored(spark, sf, monkeypatch):
    from __spark_entry__ import queries

    seen, real = [], pairs.nearest_neighbours
    monkeypatch.setattr(pairs, "nearest_neighbours", lambda df, *a, **kw: seen.append(dict(df.dtypes)["x"]) or real(df, *a, **kw))
    row = queries()["g6_diagnostics"](spark, sf).first()
    assert seen == ["array<float>"] and (row.original_dim, row.target_dim) == (64, 16)
