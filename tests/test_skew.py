"""The paths taken for large keys, cells and graphs give the same results as the plain ones."""

import numpy as np
import pytest
from helpers import brute, vectors
from pyspark.sql import Window
from pyspark.sql import functions as F

from latentlake.operators import blocks, forest, graph, ordered, pairs, routes, traces
from latentlake.operators.kernels import join_sets

KEYS, ORDER = ["user_id"], ["ts", "event_id"]


@pytest.fixture(scope="module")
def hot(spark, sf):
    """Events in which one user holds far more rows than the others."""
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "value")
    return ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(1)).otherwise(F.col("user_id")))


def rows(df, *cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_running_aggregates_in_slices(hot):
    aggs = {"rn": ("count", None), "s": ("sum", "value"), "lo": ("min", "value"), "hi": ("max", "value")}
    plain, sliced = (ordered.running(hot, KEYS, ORDER, aggs, limit) for limit in (10**9, 40))
    assert rows(plain, "event_id", *aggs) == rows(sliced, "event_id", *aggs)


def test_windows_in_chunks(hot):
    def build(df, part, by):
        w = Window.partitionBy(*part).orderBy(*by)
        return df.withColumns({"m": F.avg("value").over(w.rowsBetween(-9, 0)), "n": F.count("value").over(w.rowsBetween(-9, 0)),
                               "l": F.lead("value", 7).over(w)})

    plain, chunked = (ordered.windows(hot, KEYS, ORDER, build, 9, 7, limit) for limit in (10**9, 20))
    assert rows(plain, "event_id", "m", "n", F.coalesce("l", F.lit(-1.0))) == rows(chunked, "event_id", "m", "n", F.coalesce("l", F.lit(-1.0)))


def test_top_rows_with_a_large_limit(hot):
    plain, parts = (ordered.top_rows(hot, KEYS, [F.desc("value"), F.asc("event_id")], 25, pushed=p) for p in (1000, 10))
    assert rows(plain, "user_id", "event_id", "rn") == rows(parts, "user_id", "event_id", "rn")


def test_traces_of_a_large_key(hot):
    plain, sliced = (traces.traps(hot, KEYS, ORDER, "value", limit) for limit in (10**9, 60))
    cols = ("user_id", "length", "stall_step", "final", "spread", "trap_type")
    assert rows(plain, *cols) == rows(sliced, *cols)


@pytest.fixture(scope="module")
def cloud():
    """Clustered points, a third of them copies of one point, some copies of another."""
    rng = np.random.default_rng(3)
    m = rng.standard_normal((8, 5))[rng.integers(0, 8, 120)] + rng.standard_normal((120, 5)) * 0.2
    m[10:50] = m[10]
    m[60:64] = m[60]
    return m


def test_similar_pairs_of_distinct_vectors(spark, cloud):
    d = brute(cloud)
    first = [int(np.flatnonzero(d[i] == 0)[0]) for i in range(len(cloud))]
    want = {(i, j) for i in set(first) for j in set(first) if i < j and d[i, j] <= 0.6}
    reps = blocks.collapse_copies(vectors(spark, cloud), "vec_id", "x")
    for cell, block in ((10**6, 1024), (10, 7), (4, 3)):
        got = blocks.similar_pairs(reps, "vec_id", "x", 0.6, ["n"], cell, block).collect()
        assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
        assert all(abs(r.d - d[r.a, r.b]) < 1e-12 and r.n_a == first.count(r.a) for r in got)


def test_neighbours_with_copies(spark, cloud):
    d, k = brute(cloud), 6
    want = {(i, int(j)) for i in range(len(cloud)) for j in
            sorted((j for j in range(len(cloud)) if j != i), key=lambda j: (round(d[i, j], 12), j))[:k]}
    for cell, block in ((10**6, 1024), (9, 5)):
        got = pairs.nearest_neighbours(vectors(spark, cloud), "vec_id", "x", k, cell_rows=cell, block_rows=block).collect()
        assert len(got) == len(cloud) * k and {(r.a, r.b) for r in got} == want


def test_neighbours_of_few_rows(spark):
    got = pairs.nearest_neighbours(vectors(spark, np.arange(6.0).reshape(3, 2)), "vec_id", "x", 12)
    assert rows(got, "a", "b") == [(a, b) for a in range(3) for b in range(3) if a != b]


def test_components_without_the_one_task_finish(spark):
    rng = np.random.default_rng(5)
    a = np.concatenate([rng.integers(0, 300, 200), np.full(100, 7), np.arange(400, 440)])
    b = np.concatenate([rng.integers(0, 300, 200), np.arange(300, 400), np.arange(401, 441)])
    keep = a != b
    nodes, root, _ = join_sets(a[keep], b[keep])
    edges = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long")
    for one_task in (10**6, 0, 60):
        got = graph.components(edges, one_task=one_task)
        assert rows(got, "node", "component") == sorted((int(n), int(r)) for n, r in zip(nodes, root))


def test_forest_by_contraction(spark):
    rng = np.random.default_rng(6)
    edges = [(int(x), int(y), float(w)) for x, y, w in zip(rng.integers(0, 40, 150), rng.integers(40, 80, 150), rng.random(150))]
    df = spark.createDataFrame(edges, "a long, b long, d double")
    one, many = (graph.minimum_forest(df, one_task=n) for n in (10**6, 0))
    assert rows(one, "a", "b", "d") == rows(many, "a", "b", "d")


def test_shape_counts_copies(spark, cloud):
    d = brute(cloud)
    a, b = np.nonzero(np.triu(d <= 0.5, 1))
    nodes, root, _ = join_sets(a, b)
    parts = len(cloud) - len(nodes) + len(set(root.tolist()))
    for cell, block in ((10**6, 1024), (10, 6)):
        got = graph.shape_at(vectors(spark, cloud), "vec_id", "x", 0.5, cell, block).first()
        assert (got.nodes, got.edges, got.components) == (len(cloud), len(a), parts)
        assert got.cycles == max(0, len(a) - len(cloud) + parts) and got.euler == parts - got.cycles
        comp = graph.components_at(vectors(spark, cloud), "vec_id", "x", 0.5, cell, block).collect()
        assert len(comp) == len(cloud) and len({r.component for r in comp}) == parts


def test_a_dense_core_is_not_compared_with_itself(spark):
    """A third of the rows lie almost on one point: they form one core, and their pairs are counted, not visited."""
    rng = np.random.default_rng(11)
    m = rng.standard_normal((150, 4))
    m[50:100] = m[50] + rng.standard_normal((50, 4)) * 1e-3
    _, pivots = blocks.choose_pivots(vectors(spark, m), "vec_id", "x", 30)
    cells = blocks.metric_cells(vectors(spark, m), "x", pivots, 0.8, core=True)
    tasked = blocks.pair_tasks(cells, ["_cell"], "vec_id", 8)
    met = tasked.where("_core").groupBy("_cell", "_i", "_j").agg(F.countDistinct("_side").alias("s"))
    assert cells.where("_core").count() >= 50 and met.where("s > 1 OR _i = _j").count() == 0
    a, b = np.nonzero(np.triu(brute(m) <= 0.8, 1))
    nodes, root, _ = join_sets(a, b)
    for cell, block in ((10**6, 1024), (30, 8), (5, 3)):
        got = graph.shape_at(vectors(spark, m), "vec_id", "x", 0.8, cell, block).first()
        assert (got.edges, got.components) == (len(a), 150 - len(nodes) + len(set(root.tolist())))


def test_filtration_counts(spark, cloud):
    alphas = [0.05, 0.2, 0.5, 1.0]
    d = brute(cloud) / brute(cloud).max()
    for block in (1024, 16):
        got = {r.alpha: r for r in forest.filtration(vectors(spark, cloud), "vec_id", ["x"], alphas, block).collect()}
        for v in alphas:
            a, b = np.nonzero(np.triu(d <= v, 1))
            nodes, root, _ = join_sets(a, b)
            parts = len(cloud) - len(nodes) + len(set(root.tolist()))
            assert (got[v].components, got[v].edges) == (parts, len(a))


def test_isolation_with_copies(spark, cloud):
    n = len(cloud)
    df = vectors(spark, cloud, g=["a"] * n, re=[0.1 + 0.01 * i for i in range(n)], im=[0.2] * n)
    loss = (1 / (brute(cloud) + 1e-12)) ** 2
    np.fill_diagonal(loss, 0)
    for block in (1024, 16):
        got = {r.vec_id: r.isolation for r in pairs.isolation(df, "g", "vec_id", "x", block_rows=block).collect()}
        for i in range(n):
            want = ((0.1 + 0.01 * i) ** 2 + 0.04) / max(loss[i].sum(), 1e-12)
            assert abs(got[i] / want - 1) < 1e-6


def test_opposite_partners_of_a_large_group(spark):
    rng = np.random.default_rng(8)
    a = rng.uniform(-np.pi, np.pi, 300)
    a[100:200] = a[100]
    df = spark.createDataFrame([(i, "g", float(np.cos(t)), float(np.sin(t))) for i, t in enumerate(a)],
                               "vec_id long, g string, re double, im double")
    gap = np.abs(np.abs(a[:, None] - a[None, :]) - np.pi) < 0.5
    for limit in (10**9, 50):
        got = {r.vec_id: r for r in pairs.opposite_partners(df, "g", "vec_id", limit=limit).collect()}
        for i in range(300):
            assert got[i].n_partners == gap[i].sum()
            assert abs(got[i].partner_re - np.cos(a[gap[i]]).sum()) < 1e-9


def test_merge_in_small_blocks(spark, cloud):
    n = len(cloud)
    d = np.sqrt((cloud ** 2).sum(1))
    df = vectors(spark, cloud, g=["a"] * n, d=[float(v) for v in d], re=[0.1 + 0.001 * i for i in range(n)], im=[0.0] * n)
    whole, cut = (pairs.merge_near(df, "g", "vec_id", "x", tau=0.05, reach=0.6, block_rows=b) for b in (1024, 5))
    assert rows(whole, "vec_id", "merged", "re") == rows(cut, "vec_id", "merged", "re")
    assert sum(r[1] for r in rows(whole, "vec_id", "merged")) == n


def test_crossings_in_small_blocks(spark):
    rng = np.random.default_rng(9)
    walk = np.cumsum(rng.standard_normal((200, 2)), axis=0)
    df = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(walk)], "r int, i long, px double, py double")
    n, want = len(walk), 0
    nxt = np.roll(walk, -1, axis=0)
    for i in range(n):
        for j in range(i + 2, n):
            if i == 0 and j == n - 1:
                continue
            u, v, w = nxt[i] - walk[i], nxt[j] - walk[j], walk[j] - walk[i]
            c = u[0] * v[1] - u[1] * v[0]
            if abs(c) >= 1e-10:
                t, s = (w[0] * v[1] - w[1] * v[0]) / c, (w[0] * u[1] - w[1] * u[0]) / c
                want += 0 < t < 1 and 0 < s < 1
    for limit, block in ((10**9, 1024), (50, 6)):
        assert routes.crossings(df, ["r"], ["i"], "px", "py", limit, block).first().crossings == want


def test_square_has_no_crossing_and_length_four(spark):
    for order, crossings in (([(0, 0), (1, 0), (1, 1), (0, 1)], 0), ([(0, 0), (1, 1), (1, 0), (0, 1)], 1)):
        df = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(order)], "r int, i long, px double, py double")
        assert routes.crossings(df, ["r"], ["i"], "px", "py").first().crossings == crossings
        if not crossings:
            assert routes.route_lengths(df, ["r"], ["i"], "px", "py").first().length == 4.0


def ties_of(k):
    """A chain of k bow ties; the route closes with one segment across all of them."""
    return np.array([p for i in range(k) for p in ((4.0 * i, 0.0), (4.0 * i + 1, 1.0), (4.0 * i + 1, 0.0), (4.0 * i, 1.0))])


def plain_crossings(pts):
    n, out = len(pts), 0
    ends = np.roll(pts, -1, axis=0)
    for i in range(n):
        for j in range(i + 2, n):
            if i == 0 and j == n - 1:
                continue
            a, b, d = ends[i] - pts[i], ends[j] - pts[j], pts[j] - pts[i]
            cross = a[0] * b[1] - a[1] * b[0]
            if abs(cross) >= 1e-10:
                out += 0 < (d[0] * b[1] - d[1] * b[0]) / cross < 1 and 0 < (d[0] * a[1] - d[1] * a[0]) / cross < 1
    return out


def route_of(spark, pts, name):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"r": name, "i": np.arange(len(pts)), "x": pts[:, 0], "y": pts[:, 1]}))


def test_crossings_in_blocks_and_small_tasks(spark):
    rng = np.random.default_rng(2)
    clouds = {"ties": ties_of(9), "random": rng.random((60, 2)), "dense": np.vstack([rng.random((50, 2)) * 1e-3, rng.random((8, 2))]), "line": np.array([[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]])}
    df = route_of(spark, clouds["ties"], "ties")
    for name in ("random", "dense", "line"):
        df = df.unionByName(route_of(spark, clouds[name], name))
    want = {name: plain_crossings(pts) for name, pts in clouds.items()}
    for block, task in ((1024, 50_000), (5, 40)):
        got = routes.crossings(df, ["r"], ["i"], "x", "y", block_rows=block, task_rows=task)
        assert {r.r: r.crossings for r in got.collect()} == want


def test_a_route_of_many_segments(spark):
    """Counts grow by the same number with every bow tie; the closing segment passes all cells."""
    few = {k: plain_crossings(ties_of(k)) for k in (20, 21, 22)}
    step = few[21] - few[20]
    assert few[22] - few[21] == step
    k = 100_000
    got = routes.crossings(route_of(spark, ties_of(k), "long"), ["r"], ["i"], "x", "y").first()
    assert got.crossings == few[20] + (k - 20) * step
