"""Sketches, spanning trees, hashing, landmarks and all-pairs paths against plain versions, on every way they can take."""

import re
import tracemalloc

import numpy as np
import pytest
from helpers import brute, vectors
from pyspark.sql import functions as F

from latentlake.operators import blocks, forest, graph, hashing, kernels, landmarks, pairs, paths, sketch
from latentlake.operators.kernels import join_sets


def clusters(n=90, seed=2):
    """Five far clusters of different sizes, one of them nearly a point."""
    rng = np.random.default_rng(seed)
    at = rng.choice(5, n, p=[0.5, 0.2, 0.15, 0.1, 0.05])
    return rng.standard_normal((5, 6))[at] * 20 + rng.standard_normal((n, 6)) * np.where(at == 0, 0.01, 0.5)[:, None]


def lattice():
    return np.array([[i * 0.1, j * 0.1, 0.3] for i in range(8) for j in range(8)])


def uniform(n=80):
    m = np.random.default_rng(4).standard_normal((n, 16))
    return m / np.linalg.norm(m, axis=1)[:, None]


CLOUDS = {"clusters": clusters, "lattice": lattice, "uniform": uniform}


def tree_weights(d):
    """Weights of a minimum spanning tree of a full distance matrix, sorted."""
    n = len(d)
    i, j = np.triu_indices(n, 1)
    order = np.argsort(d[i, j], kind="stable")
    _, _, used = join_sets(i, j, order)
    return np.sort(d[i, j][used])


@pytest.mark.parametrize("keep", [0.5, 0.9, 1.0])
@pytest.mark.parametrize("name", CLOUDS)
def test_bounds_hold(spark, name, keep):
    m = CLOUDS[name]()
    index = sketch.Index(vectors(spark, m), "vec_id", "x", keep=keep, cell_rows=20)
    rows = sketch.Side(index.placed.orderBy("vec_id").toArrow(), "vec_id")
    lower, upper = sketch.bounds(rows, rows, slice(None), index.sketch.step)
    d = brute(m)
    assert (lower <= d + 1e-12).all() and (d <= upper + 1e-12).all()
    cell = rows.table.column("_cell").to_numpy()
    assert (index.cells.apart()[np.ix_(cell, cell)] <= d + 1e-12).all()
    assert index.cells.rows.sum() == len(m) and index.farthest() == pytest.approx(d.max(), abs=1e-12)


@pytest.mark.parametrize("name", CLOUDS)
@pytest.mark.parametrize("k,cell,block,one_task", [(3, 10**6, None, 10**6), (2, 12, 5, 0), (200, 30, 16, 10**6)])
def test_one_tree(spark, name, k, cell, block, one_task):
    m = CLOUDS[name]()
    tree = forest.spanning_tree(vectors(spark, m), "vec_id", "x", k, cell, block, one_task).collect()
    want = tree_weights(brute(m))
    assert len(tree) == len(m) - 1
    assert np.allclose(sorted(r.d for r in tree), want, atol=1e-12)
    assert len({frozenset((r.a, r.b)) for r in tree}) == len(tree)


@pytest.mark.parametrize("name", CLOUDS)
def test_all_thresholds_from_one_tree(spark, name):
    m = np.vstack([CLOUDS[name](), CLOUDS[name]()[:7]])  # with copies
    d = brute(m)
    taus = [0.0, *np.quantile(d[d > 0], [0.02, 0.2]).tolist(), float(d.max())]
    want = {}
    for t in taus:
        a, b = np.nonzero(np.triu(d <= t, 1))
        nodes, root, _ = join_sets(a, b)
        top = dict(zip(nodes.tolist(), root.tolist()))
        want[t] = {i: top.get(i, i) for i in range(len(m))}
    for one_block in (10**6, 0):
        got = {}
        for r in forest.hierarchy(vectors(spark, m), "vec_id", "x", taus, one_block=one_block, cell_rows=25).collect():
            got.setdefault(r.tau, {})[r.vec_id] = r.component
        assert got == want
        counts = {r.tau: r.components for r in forest.level_counts(vectors(spark, m), "vec_id", "x", taus, one_block=one_block).collect()}
        assert counts == {t: len(set(v.values())) for t, v in want.items()}


def test_levels_are_joined_by_id(spark):
    """Copies find their representative once; no further level ships the vectors again."""
    m = np.vstack([lattice(), lattice()[:7]])
    got = forest.hierarchy(vectors(spark, m), "vec_id", "x", [0.05, 0.1, 0.2])
    assert not re.search(r"\bx#", got.groupBy().count()._jdf.queryExecution().executedPlan().toString())
    want = {0.05: [i % 64 for i in range(len(m))], 0.1: None, 0.2: [0] * len(m)}
    for tau, parts in want.items():
        found = [r.component for r in got.where(F.col("tau") == tau).orderBy("vec_id").collect()]
        assert len(found) == len(m) and all(found[i] == found[i - 64] for i in range(64, len(m)))
        assert parts is None or found == parts


@pytest.mark.parametrize("one_block", [10**6, 1])
def test_all_pairs_are_within_the_largest_distance(spark, one_block):
    """Two columns whose largest distance many pairs share."""
    m = lattice()
    df = vectors(spark, m).withColumn("z", F.slice("x", 1, 2))
    got = {(r.x, r.alpha): r for r in forest.filtration(df, "vec_id", ["x", "z"], [0.25, 0.5, 1.0], 20, one_block).collect()}
    n = len(m)
    for x in ("x", "z"):
        assert (got[x, 1.0].components, got[x, 1.0].edges) == (1, n * (n - 1) // 2)
        assert got[x, 0.5].edges < n * (n - 1) // 2


def test_few_vectors_are_shipped(spark, sf):
    """On the given vectors: those of the pairs that the bounds leave, against a copy per block met."""
    reps = blocks.collapse_copies(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").alias("x")), "vec_id", "x")
    shipped = blocks.radius_tasks(reps.select("vec_id", "x"), "vec_id", "x", 1.1, block_rows=64).count()
    index = sketch.Index(reps, "vec_id", "x")
    assert 0 < 2 * index.within(1.1).count() <= shipped / 10
    assert index.nearest(12).count() <= 4 * 12 * index.rows  # a few times k candidates per row
    assert index.placed.agg(F.max(F.length("_code"))).first()[0] <= 65


def test_dense_results_come_from_blocks(spark):
    m = uniform(60)
    d = brute(m)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(d <= 1.5, 1)))}
    for dense in (10**6, 0.0):
        got = blocks.similar_pairs(vectors(spark, m), "vec_id", "x", 1.5, dense=dense, block_rows=16).collect()
        assert {(r.a, r.b) for r in got} == want and all(abs(r.d - d[r.a, r.b]) < 1e-12 for r in got)


# --- hashing -----------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("block", [1024, 8])
def test_hashing_finds_most_and_nothing_wrong(spark, block):
    rng = np.random.default_rng(8)
    m = rng.standard_normal((300, 12))
    m[100:160] = m[100] + rng.standard_normal((60, 12)) * 0.05  # a hot bucket
    d, tau = brute(m), 1.2
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(d <= tau, 1)))}
    got = hashing.similar_pairs_by_hashing(vectors(spark, m), "vec_id", "x", tau, block_rows=block).collect()
    found = {(r.a, r.b) for r in got}
    assert len(found) == len(got) and found <= want and len(found) >= 0.9 * len(want)
    assert all(abs(r.d - d[r.a, r.b]) < 1e-12 for r in got)


def test_schemes_reach_their_recall(spark):
    for tau in (0.3, 1.0):
        s = hashing.choose(vectors(spark, uniform()), "vec_id", "x", tau, 0.95)
        assert s.expected_recall(tau) >= 0.95 and s.expected_recall(tau / 2) > s.expected_recall(tau)
    rng = np.random.default_rng(0)
    a = rng.standard_normal((200_000, 3))
    b = a + np.array([0.6, 0.0, 0.8])
    dirs, off = rng.standard_normal((200_000, 3)), rng.random(200_000) * 2
    same = np.floor(((a * dirs).sum(1) + off) / 2) == np.floor(((b * dirs).sum(1) + off) / 2)
    assert same.mean() == pytest.approx(hashing.together(np.array([1.0]), 2.0)[0], abs=0.005)


# --- landmarks and paths -----------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", CLOUDS)
def test_landmarks_are_farthest_first(spark, name):
    m = np.vstack([CLOUDS[name](), CLOUDS[name]()[:3]])
    d = brute(m)
    ids, near, radius = [0], d[0].copy(), []
    while len(ids) < 6:
        radius.append(near.max())
        ids.append(int(np.argmax(near)))
        near = np.minimum(near, d[ids[-1]])
    got = landmarks.farthest_first(vectors(spark, m).repartition(3), "vec_id", "x", 6)
    assert got.radius == pytest.approx([*radius, near.max()], abs=1e-12)
    if name != "lattice":  # there many rows are equally far, and the last digit decides
        assert got.ids == ids


def test_no_more_landmarks_than_points(spark):
    df = vectors(spark, np.array([[0.0], [1.0], [1.0], [3.0]]))
    got = landmarks.farthest_first(df, "vec_id", "x", 9)
    assert got.ids == [0, 3, 1] and got.radius == [3.0, 1.0, 0.0]
    assert landmarks.farthest_first(df.limit(0), "vec_id", "x", 2).ids == []


def all_paths(n, edges):
    g = np.full((n, n), np.inf)
    np.fill_diagonal(g, 0)
    for a, b, w in edges:
        g[a, b] = min(g[a, b], w)
    for k in range(n):
        g = np.minimum(g, g[:, k:k + 1] + g[k:k + 1, :])
    return g


@pytest.mark.parametrize("name", ["clusters", "uniform"])
def test_path_profile_of_all_pairs(spark, name, monkeypatch):
    m = np.vstack([CLOUDS[name](), CLOUDS[name]()[:4]])  # clusters: not connected; copies have paths of length 0
    df = vectors(spark, m).withColumn("z", F.slice("x", 1, 2))
    edges = pairs.neighbour_graph(df, "vec_id", "x", 5)
    g, e = all_paths(len(m), [tuple(r) for r in edges.select("a", "b", "d").collect()]), brute(m[:, :2])
    good, levels = np.isfinite(g) & (g > 1e-12), [0.0, 0.3, 0.5, 1.0]
    top = g[np.isfinite(g)].max()
    off = ~np.eye(len(m), dtype=bool)
    want = (int(good.sum()), pytest.approx(np.abs(g[good] / top - e[good] / (e.max() + 1e-12)).mean(), abs=1e-9))
    monkeypatch.setattr(paths, "SOURCES", 17)
    for limit, batch in ((1 << 26, 512), (0, 40)):
        got = paths.path_profile(edges, df, "vec_id", "z", levels, limit, batch)
        assert got.longest == pytest.approx(top) and (got.pairs, got.distortion) == want
        assert got.counts[1:] == [int((g[off] / top <= v + 1e-12).sum()) // 2 for v in levels[1:]]
        assert got.counts[0] == int((g[off] == 0).sum()) // 2


def test_paths_in_one_task_and_in_rounds(spark):
    df = vectors(spark, clusters())
    edges = pairs.neighbour_graph(df, "vec_id", "x", 4)
    one, many = (graph.geodesics(edges, [0, 7, 7, 30, 999], one_task=n) for n in (10**6, 0))
    a, b = ({(r.source, r.node): r.d for r in far.collect()} for far in (one, many))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)


def test_paths_over_nodes_of_all_degrees():
    """A hub, chains and nodes out of reach, the node that all others enter included; every block size gives the same paths."""
    rng = np.random.default_rng(5)
    n = 90
    links = {(i, j): rng.random() + 0.1 for i, j in zip(rng.integers(0, 80, 150), rng.integers(0, 80, 150)) if i != j}
    links |= {(i, 7): 0.01 * i + 0.5 for i in range(n - 1) if i != 7} | {(80, 81): 1.0, (81, 82): 1.0}
    a, b, w = np.array([k[0] for k in links]), np.array([k[1] for k in links]), np.array(list(links.values()))
    order = np.argsort(b, kind="stable")
    a, b, w = a[order], b[order], w[order]
    want = all_paths(n, zip(a, b, w))
    sources = np.array([0, 7, 80, 89])
    for at_once, hub in ((2_048, 128), (2_048, 4), (3, 4), (1, 0)):
        assert np.allclose(kernels.relaxed(sources, a, b, w, n, at_once, hub), want[sources], atol=1e-12)


def test_paths_hold_few_edges_at_a_time():
    """Three nodes that all others enter: what is held beside the paths is bounded by the nodes of a step, not by their edges."""
    n, own = 20_000, np.arange(32)
    a, b = np.tile(np.arange(3, n), 3), np.repeat(np.arange(3), n - 3)
    tracemalloc.start()
    got = kernels.relaxed(own, a, b, np.ones(len(a)), n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got[3:, :3] == 1.0).all() and np.isinf(got[0, 1:]).all()
    assert peak < 3 * got.nbytes


def test_hashing_returns_a_pair_once_and_is_counted_without_pairs(spark):
    """A pair that all tables bring together comes from the first; sums over blocks say the same as the pairs themselves."""
    m = uniform(120)
    df, d = vectors(spark, m), brute(m)
    schemes = {tau: hashing.Scheme(5, 1, 4.0) for tau in (0.9, 1.2)}
    exact = {r.tau: r for r in hashing.against_exact(df, "vec_id", "x", schemes, block_rows=32).collect()}
    for tau, scheme in schemes.items():
        for block in (None, 16):
            got = hashing.similar_pairs_by_hashing(df, "vec_id", "x", tau, scheme=scheme, block_rows=block)
            shuffles = got.groupBy().count()._jdf.queryExecution().executedPlan().toString()
            pairs_found = [(r.a, r.b) for r in got.collect()]
            dealt = [line for line in shuffles.splitlines() if "hashpartitioning" in line]
            assert not any("hashpartitioning(a#" in line for line in dealt)  # pairs stay where they are found
            assert any("_i#" in line and "_j#" in line for line in dealt)  # a bucket's blocks are many tasks
            assert len(set(pairs_found)) == len(pairs_found) == exact[tau].shared
            assert exact[tau].pairs == int((np.triu(d <= tau, 1)).sum())
            assert sum(hashing.digest(*(np.array(c) for c in p)) for p in pairs_found) == exact[tau].digest


def test_profiles_ship_vectors_as_they_are_stored(spark, sf, monkeypatch):
    """Both columns of the squeezed pair stay float, and counting strip by strip changes no count."""
    from latentlake.catalog.pairwork import squeezed_pair

    assert [t for _, t in squeezed_pair(spark, sf).dtypes[1:]] == ["array<float>"] * 2
    m = np.vstack([lattice(), lattice()[:5]])
    df, d = vectors(spark, m), brute(m)
    for strip in (65_536, 40):
        monkeypatch.setattr(forest, "STRIP", strip)
        got = forest.filtration(df, "vec_id", ["x"], [0.25, 0.5, 1.0], 20).collect()
        assert [r.edges for r in got] == [int(np.triu(d / d.max() <= r.alpha, 1).sum()) for r in got]
