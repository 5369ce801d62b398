"""Student-t tail and quantile as Column expressions.

With theta = atan(t / sqrt(df)) the two-sided tail is the integral of cos(u)**(df - 1) from theta to pi / 2 over the same
integral from 0. The integrand falls off within a few times 1 / sqrt(df), so Gauss-Legendre sums of fixed length over that
stretch are good to about twelve digits for any number of degrees of freedom, and no gamma function is needed. The quantile
takes Newton steps from the normal one, which lies below it; the tail is convex in theta, so they never overshoot.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from latentlake.functions.vec import let

PANELS, NODES, REACH, STEPS = 8, 16, 12.0, 24
_AT, _WEIGHT = np.polynomial.legendre.leggauss(NODES)


def _integral(lo: Column, df: Column) -> Column:
    """Integral of cos(u)**(df - 1) from lo as far as it matters, pi / 2 at most."""
    hi = F.least(F.lit(math.pi / 2), lo + REACH / F.sqrt(df))
    rule = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(w)).alias("w")) for a, w in zip(_AT, _WEIGHT)])

    def panel(half):
        def value(k, node):
            return node["w"] * F.exp((df - 1) * 0.5 * F.log1p(-F.pow(F.sin(lo + half * (2 * k + 1 + node["a"])), 2)))

        return F.aggregate(F.sequence(F.lit(0), F.lit(PANELS - 1)), F.lit(0.0), lambda s, k: s + F.aggregate(rule, F.lit(0.0), lambda t, n: t + value(k, n))) * half

    return let((hi - lo) / (2 * PANELS), panel)


def p_value(t: Column, df: Column) -> Column:
    """Probability of a larger |t|; null for fewer than one degree of freedom or no t."""
    df = df.cast("double")
    tail = _integral(F.atan(F.abs(t.cast("double")) / F.sqrt(df)), df) / _integral(F.lit(0.0), df)
    return F.when((df >= 1) & ~F.isnan(t.cast("double")), F.least(F.lit(1.0), tail))


def critical(df: Column, alpha: float) -> Column:
    """The t that a share ``alpha`` of the distribution exceeds on both sides together."""
    df = df.cast("double")
    start = F.atan(F.lit(NormalDist().inv_cdf(1 - alpha / 2)) / F.sqrt(df))

    def found(whole):
        def step(u, _):
            return u + (_integral(u, df) - alpha * whole) / F.exp((df - 1) * 0.5 * F.log1p(-F.pow(F.sin(u), 2)))

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)

    return F.when(df >= 1, F.tan(let(_integral(F.lit(0.0), df), found)) * F.sqrt(df))
