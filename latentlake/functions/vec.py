"""Expressions on vector columns (``array<float>`` or ``array<double>``).

Vectors are stored as floats and computed in double. Everything here is a plain Column expression, so it stays in the
JVM and takes part in column pruning. Kernels that score a row against many vectors at once live in
``latentlake.operators.kernels``.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def c(x) -> Column:
    """A Column from a name or a Column."""
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row.

    Inside a lambda a plain column expression would be computed again for every element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def doubles(x) -> Column:
    return c(x).cast("array<double>")


def vec_literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(x) -> Column:
    return F.aggregate(c(x), F.lit(0.0), lambda s, v: s + v)


def dot(a, b) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(total(F.transform(doubles(a), lambda v: v * v)))


def l2(a, b) -> Column:
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def cosine(a, b) -> Column:
    """Cosine distance; 1.0 when either side has no direction."""
    parts = F.struct(norm(a).alias("na"), norm(b).alias("nb"), dot(a, b).alias("ab"))
    return let(parts, lambda p: F.when((p["na"] < EPS) | (p["nb"] < EPS), F.lit(1.0))
               .otherwise(1.0 - p["ab"] / (p["na"] * p["nb"])))


def distance(a, b, metric: str = "l2") -> Column:
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}: expected 'l2' or 'cosine'")
    return l2(a, b) if metric == "l2" else cosine(a, b)


def equivalent(d, tau: float) -> Column:
    """Distance within tolerance, bound included."""
    if tau <= 0:
        raise ValueError("tolerance must be positive")
    return c(d) <= tau


def quality(d, tau: float) -> Column:
    """1 at distance zero, falling linearly to 0 at the tolerance."""
    if tau <= 0:
        raise ValueError("tolerance must be positive")
    return F.greatest(F.lit(0.0), 1.0 - c(d) / tau)


def dim(a) -> Column:
    return F.size(c(a))


def truncate(a, k: int) -> Column:
    return F.slice(c(a), 1, k)


def scale(a, factor) -> Column:
    return let(c(factor), lambda f: F.transform(doubles(a), lambda v: v * f))


def add(a, b) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def sub(a, b) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def analogy(a, b, target) -> Column:
    """a - b + target."""
    return add(sub(a, b), target)


def interpolate(a, b, t) -> Column:
    """a at t=0, b at t=1."""
    return between(a, b, F.lit(t) if isinstance(t, (int, float)) else t)


def between(a, b, part: Column) -> Column:
    """a + part * (b - a)"""
    return let(part, lambda p: F.zip_with(doubles(a), doubles(b), lambda x, y: x + (y - x) * p))


def constant(d: int, value: float) -> Column:
    return F.array_repeat(F.lit(float(value)), d)


def ramp(start: float, stop: float, n: int) -> Column:
    if n < 1:
        raise ValueError("a ramp needs at least one point")
    if n == 1:
        return F.array(F.lit(float(start)))
    step = (stop - start) / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(start)) + i * F.lit(step))


def project(a, rows) -> Column:
    """Coordinates of a on a small list of literal direction vectors."""
    return F.array(*[dot(a, vec_literal(r)) for r in rows])


def subspace_residual(a, rows) -> Column:
    """Distance from a to the span of orthonormal literal rows."""
    return let(project(a, rows), lambda p: F.sqrt(F.greatest(F.lit(0.0), dot(a, a) - dot(p, p))))


def mean_vector(x, weight=None) -> Column:
    """Aggregate: (weighted) mean vector. Partial sums are built before the shuffle, so group size does not matter."""
    v = array_to_vector(doubles(x))
    return vector_to_array(Summarizer.mean(v, c(weight)) if weight is not None else Summarizer.mean(v))


def r6(x) -> Column:
    """Round to six places and drop the sign of zero, for stable comparison."""
    return F.round(c(x), 6) + F.lit(0.0)
