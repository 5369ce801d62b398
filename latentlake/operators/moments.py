"""Sums over rows that describe a table of vectors: built by tasks, added up by Spark, solved once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentlake.functions.vec import doubles
from latentlake.operators.kernels import matrix, vectors


def summed(df: DataFrame, cols: list[str], part) -> np.ndarray | None:
    """Sum over all rows of ``part(*matrices)``: every task adds up its batches and sends one small matrix."""

    def run(batches):
        whole = None
        for b in batches:
            if b.num_rows:
                one = part(*[matrix(b.column(c)) for c in cols])
                whole = one if whole is None else whole + one
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(whole), dtype=np.int64)), vectors(whole)], names=["i", "r"])

    sums = df.select(*cols).mapInArrow(run, "i long, r array<double>").groupBy("i").agg(
        vector_to_array(Summarizer.sum(array_to_vector("r"))).alias("r")).collect()
    return np.array([row["r"] for row in sorted(sums, key=lambda row: row["i"])]) if sums else None


def spectrum(df: DataFrame, x: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, mean, variances by falling size, directions as rows). One pass: counts, sums and products around the first row."""
    rows = df.select(doubles(x).alias("_x"))
    one = rows.first()
    if one is None:
        return 0, np.zeros(1), np.zeros(1), np.eye(1)
    shift = np.array(one[0])
    d = len(shift)

    def part(m):
        c = np.hstack([m - shift, np.ones((len(m), 1))])
        return c.T @ c

    total = summed(rows, ["_x"], part)
    n, mean = total[d, d], total[d, :d] / total[d, d]
    values, axes = np.linalg.eigh((total[:d, :d] - n * np.outer(mean, mean)) / max(n - 1, 1))
    return int(n), shift + mean, np.maximum(values[::-1], 0.0), axes[:, ::-1].T
