import numpy as np
import pytest
from helpers import vectors
from pyspark.ml import Pipeline, PipelineModel

from latentlake.operators import reduction, spectra
from latentlake.plans.runtime import scratch_path


def product_gap(m, s):
    """Eigenvalues of what the summary's product lacks of the centred rows' product."""
    c = m - m.mean(0)
    return np.linalg.eigvalsh(c.T @ c - s.rows.T @ s.rows)


def test_summary_never_exceeds_and_lacks_no_more_than_stated():
    rng = np.random.default_rng(0)
    m = rng.standard_normal((900, 40)) * np.linspace(3, 0.1, 40) + 50
    for rows in (4, 10, 30):
        s = None
        for part in np.array_split(m, 23):
            one = spectra.summary_of(part, rows)
            s = one if s is None else spectra.merged(s, one, rows)
        gap = product_gap(m, s)
        size = np.linalg.norm(m - m.mean(0)) ** 2
        assert len(s.rows) <= 2 * rows and gap.min() > -1e-9 * size and gap.max() <= s.lost * (1 + 1e-9)
        assert np.allclose(s.mean, m.mean(0)) and np.isclose(s.total, size) and s.n == 900
        tail = np.sort(np.linalg.svd(m - m.mean(0), compute_uv=False) ** 2)[::-1]
        assert s.lost <= tail[rows // 2:].sum() / (rows - rows // 2) * (1 + 1e-9)  # the method's own bound


def test_fit_in_many_tasks(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((400, 24)) * np.linspace(4, 0.2, 24)
    values = np.sort(np.linalg.eigvalsh(np.cov(m, rowvar=False)))[::-1]
    best = values[:3].sum() / values.sum()
    for rows in (6, 12, 24):
        found = spectra.fit(vectors(spark, m).repartition(11, "vec_id"), "x", 3, rows=rows, fan_in=2)
        c = (m - m.mean(0)) @ found.projection.components.T
        kept = c.var(0, ddof=1).sum() / values.sum()
        assert found.kept_at_least - 1e-12 <= kept <= best + 1e-12 <= found.kept_at_most + 2e-12
    assert np.isclose(found.kept_at_least, best) and np.isclose(found.kept_at_most, best)  # as many rows as directions
    exact = reduction.fit_pca(vectors(spark, m), "x", 3)
    assert np.allclose(np.abs(found.projection.components @ exact.components.T), np.eye(3), atol=1e-8)


def test_summary_passes_on_few_numbers(spark):
    """What one task sends of wide vectors: under a tenth of the exact sums."""
    d, rows = 512, 16
    m = np.random.default_rng(2).standard_normal((300, d))
    s = spectra.summarise(vectors(spark, m).repartition(3, "vec_id"), "x", rows=rows)
    assert s.rows.size <= 2 * rows * d < 0.1 * d * (d + 1)


def test_far_from_the_origin_nulls_and_edges(spark):
    m = np.random.default_rng(3).standard_normal((50, 4)) * [3, 2, 1, 0.5] + 1e6
    found = spectra.fit(vectors(spark, m), "x", 2, rows=4)
    values = np.sort(np.linalg.eigvalsh(np.cov(m, rowvar=False)))[::-1]
    assert np.allclose(found.projection.ratio, values[:2] / values.sum(), rtol=1e-8)
    some = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [3.0, 4.0])], "vec_id long, x array<double>")
    s = spectra.summarise(some, "x")
    assert s.n == 2 and s.mean.tolist() == [2.0, 3.0]
    equal = spectra.fit(vectors(spark, [[1.0, 2.0, 3.0]] * 5), "x", 2)
    assert equal.kept_at_least == 1.0 and equal.projection.mean.tolist() == [1.0, 2.0, 3.0]
    one = spectra.fit(vectors(spark, [[1.0, 2.0, 3.0]]), "x", 2)
    assert one.kept_at_least == 1.0
    none = some.where("false")
    assert spectra.summarise(none, "x") is None
    with pytest.raises(ValueError, match="no vectors"):
        spectra.fit(none, "x", 1)
    with pytest.raises(ValueError, match="9 directions"):
        spectra.fit(some, "x", 9, rows=4)


@pytest.mark.parametrize("method", spectra.METHODS)
def test_model_survives_saving(spark, method):
    m = np.random.default_rng(4).standard_normal((60, 8)) * np.linspace(3, 0.3, 8)
    df = vectors(spark, m)
    path = scratch_path(spark, "model")
    model = spectra.Squeeze(k=3, method=method, rows=5, outputCol="y").fit(df)
    model.save(path)
    again = spectra.SqueezeModel.load(path)
    assert again.uid == model.uid and again.kept == model.kept and again.getOutputCol() == "y"
    assert again.projection.components.tolist() == model.projection.components.tolist()
    assert again.projection.mean.tolist() == model.projection.mean.tolist()
    want = [r.y for r in model.transform(df).orderBy("vec_id").collect()]
    assert [r.y for r in again.transform(df).orderBy("vec_id").collect()] == want
    back = again.restore(again.transform(df), "b").orderBy("vec_id").collect()
    assert np.allclose([r.b for r in back], np.array(want) @ np.linalg.pinv(model.projection.components).T + model.projection.mean)


def test_stage_of_a_pipeline(spark):
    m = np.random.default_rng(5).standard_normal((40, 6)) * np.linspace(3, 0.3, 6)
    df = vectors(spark, m)
    path = scratch_path(spark, "pipeline")
    chain = Pipeline(stages=[spectra.Squeeze(k=4, outputCol="z"), spectra.Squeeze(k=2, inputCol="z", outputCol="y", method="summary")])
    chain.fit(df).write().overwrite().save(path)
    got = np.array([r.y for r in PipelineModel.load(path).transform(df).orderBy("vec_id").collect()])
    values = np.sort(np.linalg.eigvalsh(np.cov(m, rowvar=False)))[::-1]
    assert np.allclose(got.var(0, ddof=1), values[:2])


def test_unknown_method(spark):
    with pytest.raises(ValueError, match="method"):
        spectra.Squeeze(k=1, method="other").fit(vectors(spark, [[1.0, 2.0], [2.0, 1.0]]))
