import math

import numpy as np
from pyspark.sql import functions as F

from latentlake.functions import special
from latentlake.operators import stats
from latentlake.operators.commit import commit_once, decide


def _lgamma_tail(t: float, df: float, n: int = 400_000) -> float:
    """Two-sided tail by the midpoint rule on the density."""
    u = (np.arange(n) + 0.5) / n * abs(t)
    density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(math.pi * df) - (df + 1) / 2 * np.log1p(u * u / df))
    return 1 - 2 * density.sum() * abs(t) / n


def test_student_t(spark):
    rows = [(2.228139, 10, 0.05), (12.706205, 1, 0.05), (1.697261, 30, 0.1), (0.0, 5, 1.0), (60.0, 1000, 0.0)]
    rows += [(t, d, _lgamma_tail(t, d)) for t in (0.3, -1.5, 4.0) for d in (1, 2, 3, 17, 400, 3_000_000)]
    df = spark.createDataFrame([(float(t), d, float(p)) for t, d, p in rows], "t double, df long, p double")
    for r in df.withColumn("q", special.p_value(F.col("t"), F.col("df"))).collect():
        assert abs(r.q - r.p) < (1e-6 if r.df in (10, 1, 30) else 1e-8)
    for alpha in (0.05, 0.001):
        c = special.critical(F.col("df"), alpha)
        for r in df.select(special.p_value(c, F.col("df")).alias("p")).collect():
            assert abs(r.p - alpha) < 1e-11
    none = spark.createDataFrame([(1.0, 0), (float("nan"), 5)], "t double, df long")
    assert [r[0] for r in none.select(special.p_value(F.col("t"), F.col("df"))).collect()] == [None, None]


def test_two_sample_and_paired(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(1, 1, 40), rng.normal(0, 2, 40)
    df = spark.createDataFrame([(float(x), True) for x in a] + [(float(x), False) for x in b], "v double, s boolean")
    r = stats.with_significance(stats.two_sample(df, "v", F.col("s")), F.col("n_a") + F.col("n_b") - 2).first()
    sp = (39 * a.var(ddof=1) + 39 * b.var(ddof=1)) / 78
    assert abs(r.t - (a.mean() - b.mean()) / np.sqrt(sp * 2 / 40)) < 1e-9
    assert abs(r.effect_pop - (b.mean() - a.mean()) / np.sqrt((a.var() + b.var()) / 2)) < 1e-9
    assert r.ci_lower < r.difference < r.ci_upper and r.significant == (r.p_value < 0.05)
    assert (r.ci_lower > 0 or r.ci_upper < 0) == r.significant
    both = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    p = stats.with_significance(stats.paired(both, "a", "b"), F.col("n") - 1).first()
    d = a - b
    assert abs(p.t - d.mean() / (d.std(ddof=1) / np.sqrt(40))) < 1e-9


def test_gates(spark):
    runs = spark.createDataFrame([(True, 1.0, 0.0, 3.0, 5, 9), (False, 1.0, 0.5, 3.0, 9, 5)],
                                 "converged boolean, r0 double, r_final double, r_adverse double, steps_a int, steps_b int")
    r = stats.acceptance(runs, []).first()
    assert (r.unconverged_pct, r.drifted_pct, r.win_pct) == (50.0, 50.0, 50.0)
    assert not r.pass_converged and not r.pass_drift and not r.pass_wins and r.pass_adverse


def test_decisions(spark):
    g = spark.createDataFrame([(1, 0.2, 3, 9.0), (2, 3.0, 10, 0.001), (3, 3.0, 9, 0.001), (4, 3.0, 10, 1.0)],
                              "k int, entropy double, n_recent int, mean_recent double")
    assert [r.reason for r in decide(g).orderBy("k").collect()] == ["entropy_low", "drift_stable", "forced_best", "forced_best"]
    assert decide(g, forced=False).where("reason = 'none'").count() == 2


def test_a_commit_is_final(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 0), ("b", 5), ("b", 4)], "k string, v int")
    assert sorted(tuple(r) for r in commit_once(old, new, "k", ["v"]).collect()) == [("a", 1), ("b", 4)]
