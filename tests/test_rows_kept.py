"""No switch, limit or null loses a row; thresholds and ties are those of direct distances."""

import numpy as np
import pytest
from helpers import brute, vectors
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from latentlake.operators import classify, graph, ordered, pairs, reduction, weights
from latentlake.plans import runtime
from latentlake.plans.runtime import join_groups


@pytest.fixture(scope="module")
def gaps(spark):
    """Rows whose keys and values are null now and then."""
    rows = [(i, None if i % 5 == 0 else i % 3, None if i % 4 < 2 else float(i)) for i in range(40)]
    return spark.createDataFrame(rows, "id long, k long, v double")


def same(a, b, *cols):
    return sorted(map(str, a.select(*cols).collect())) == sorted(map(str, b.select(*cols).collect()))


def test_sliced_windows_with_nulls(gaps):
    aggs = {"rn": ("count", None), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}
    plain, sliced = (ordered.running(gaps, ["k"], ["id"], aggs, limit) for limit in (10**9, 3))
    assert sliced.count() == 40 and same(plain, sliced, "id", "k", *aggs)


def test_null_groups_keep_their_rows(spark, gaps):
    sizes = gaps.groupBy("k").count()
    for limit in (0, 1 << 20):
        out = join_groups(gaps, sizes, "k", limit=limit)
        assert out.columns == ["k", "id", "v", "count"] and out.count() == 40
    assert weights.uniform(gaps, "k").count() == 40


def path(spark, n):
    return spark.createDataFrame([(i, i + 1, float(1 + i * 7919 % 101)) for i in range(n)], "a long, b long, d double")


def test_loops_end_or_raise(spark):
    edges = path(spark, 24)
    assert graph.components(edges, one_task=0).select("component").distinct().count() == 1
    assert graph.minimum_forest(edges, one_task=0).count() == 24
    assert graph.geodesics(edges, [0], one_task=0).count() == 25
    for limited in (lambda: graph.components(edges, one_task=0, max_rounds=2), lambda: graph.minimum_forest(edges, one_task=0, max_rounds=1),
                    lambda: graph.geodesics(edges, [0], max_rounds=5, one_task=0)):
        with pytest.raises(RuntimeError):
            limited().count()


def test_sources_must_exist(spark):
    assert graph.geodesics(path(spark, 3), [0, 999]).where("source = 999").isEmpty()


def test_every_node_is_placed(spark):
    rng = np.random.default_rng(0)
    m = np.vstack([rng.standard_normal((30, 4)), rng.standard_normal((30, 4)) + 100])
    df = vectors(spark, m)
    edges = pairs.neighbour_graph(df, "vec_id", "x", 4)
    far = graph.geodesics(edges, [0, 1, 2])
    assert far.select("node").distinct().count() == 30
    placed = reduction.landmark_embedding(far, [0, 1, 2], 3, df.select(F.col("vec_id").alias("node")))
    assert placed.count() == 60 and placed.where(F.size("y") == 3).count() == 60


@pytest.fixture(scope="module")
def lattice():
    return np.array([[i * 0.1, j * 0.1, 0.3] for i in range(9) for j in range(9)])


def test_threshold_links_on_a_lattice(spark, lattice):
    d = brute(lattice)
    want = int((d[np.triu_indices(len(d), 1)] <= 0.1).sum())
    assert graph.shape_at(vectors(spark, lattice), "vec_id", "x", 0.1).first()["edges"] == want
    for block in (1024, 20):
        assert graph.shape_at(vectors(spark, lattice), "vec_id", "x", 0.1, block_rows=block).first()["edges"] == want


def test_ties_go_to_the_smaller_id(spark, lattice):
    d = brute(lattice)
    df, at = vectors(spark, lattice), [10, 12, 28, 30]
    refs = spark.createDataFrame([(i, lattice[i].tolist()) for i in at], "k long, q array<double>")
    want = {i: at[int(np.argmin(d[i, at]))] for i in range(len(d))}
    got = classify.nearest(df, "x", classify.reference_set(refs, "k", "q"))
    assert {r.vec_id: r.winner for r in got.collect()} == want
    many = classify.nearest_of_many(df, "vec_id", "x", refs, "k", "q", block_rows=7)
    assert {r.vec_id: r.winner for r in many.collect()} == want
    near = pairs.nearest_neighbours(df, "vec_id", "x", 3)
    order = {i: [int(j) for j in sorted((j for j in range(len(d)) if j != i), key=lambda j: (d[i, j], j))[:3]] for i in range(len(d))}
    found = {}
    for r in near.collect():
        found.setdefault(r.a, []).append((r.d, r.b))
    assert {i: [b for _, b in sorted(v)] for i, v in found.items()} == order


def test_long_labels(spark, lattice):
    refs = classify.reference_set(spark.createDataFrame([(2**40, [0.0, 0.0, 0.3]), (2**40 + 1, [0.8, 0.8, 0.3])], "k long, q array<double>"), "k", "q")
    out = classify.competition_summary(classify.nearest(vectors(spark, lattice), "x", refs), refs)
    assert {r.winner for r in out.collect()} == {2**40, 2**40 + 1}


def test_scratch_can_be_cleared(spark, monkeypatch):
    monkeypatch.setattr(runtime, "_scratch", [])
    path = runtime.scratch_path(spark, "some")
    spark.range(3).write.parquet(path)
    assert runtime.clear_scratch(spark) == 1
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)
