"""Small tables and plain versions shared by the tests."""

import numpy as np


def vectors(spark, m, first=0, **extra):
    """A table (vec_id, x, ...) from a matrix."""
    rows = [(first + i, [float(v) for v in r], *[extra[k][i] for k in extra]) for i, r in enumerate(m)]
    kinds = {int: "long", str: "string", float: "double"}
    schema = "vec_id long, x array<double>" + "".join(f", {k} {kinds[type(extra[k][0])]}" for k in extra)
    return spark.createDataFrame(rows, schema)


def brute(m):
    return np.sqrt(((m[:, None] - m[None, :]) ** 2).sum(2))
