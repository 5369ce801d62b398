"""Principal components from summaries that stay small when vectors are wide, and projections as fitted, stored models.

The exact fit (``operators/moments.py``) sends d + 1 rows of d numbers per task: 8 MB at d = 1,024. A summary here holds at
most ``rows`` rows of d numbers whatever the table's size (Frequent Directions): its product B'B never exceeds the centred
A'A in any direction and falls short of it by at most ``lost``, a number that the summary carries. Tables of no more
independent directions than ``rows`` are summarised without any loss.

Summaries are merged in a tree: tasks, then groups of FAN_IN, so that no task and not the driver holds more than FAN_IN.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentlake.functions.vec import doubles
from latentlake.operators import reduction
from latentlake.operators.kernels import matrix
from latentlake.operators.reduction import Projection
from latentlake.plans.runtime import materialize

ROWS = 128
FAN_IN = 16


@dataclass
class Summary:
    """n rows around ``mean``; ``rows``'s product is that of the centred rows up to ``lost`` in any direction; ``total`` is
    the exact sum of squares of the centred rows."""

    n: float
    mean: np.ndarray
    rows: np.ndarray
    lost: float = 0.0
    total: float = 0.0

    def variances(self) -> tuple[np.ndarray, np.ndarray]:
        """Lower bounds of the variances by falling size, and the directions they are along, as rows. A variance is at
        most ``gap()`` above its bound."""
        _, s, axes = np.linalg.svd(self.rows, full_matrices=False)
        return s * s / max(self.n - 1, 1), axes

    def gap(self) -> float:
        return self.lost / max(self.n - 1, 1)


def summary_of(m: np.ndarray, rows: int = ROWS) -> Summary:
    mean = m.mean(0)
    centred = m - mean
    return _short(Summary(float(len(m)), mean, centred, 0.0, float((centred * centred).sum())), rows)


def merged(a: Summary, b: Summary, rows: int = ROWS) -> Summary:
    """The summary of both tables: their rows, and one row for the distance of their means."""
    n = a.n + b.n
    apart = (b.mean - a.mean) * np.sqrt(a.n * b.n / n)
    both = Summary(n, a.mean + (b.mean - a.mean) * (b.n / n), np.vstack([a.rows, b.rows, apart]), a.lost + b.lost,
                   a.total + b.total + float(apart @ apart))
    return _short(both, rows)


def _short(s: Summary, rows: int) -> Summary:
    """At most ``rows`` rows once there are twice as many: every square loses that of the first direction beyond them."""
    if len(s.rows) <= 2 * rows:
        return s
    _, size, axes = np.linalg.svd(s.rows, full_matrices=False)
    square = size * size
    cut = float(square[rows]) if len(square) > rows else 0.0
    left = np.sqrt(np.maximum(square[:rows] - cut, 0.0))
    return Summary(s.n, s.mean, left[:, None] * axes[:rows], s.lost + cut, s.total)


SCHEMA = "part long, n double, mean array<double>, k int, rows array<double>, lost double, total double"


def _pack(part: int, s: Summary) -> dict:
    return {"part": [part], "n": [s.n], "mean": [s.mean.tolist()], "k": [len(s.rows)], "rows": [s.rows.ravel().tolist()],
            "lost": [s.lost], "total": [s.total]}


def _unpack(r: dict) -> Summary:
    mean = np.array(r["mean"], dtype=np.float64)
    return Summary(r["n"], mean, np.array(r["rows"], dtype=np.float64).reshape(r["k"], len(mean)), r["lost"], r["total"])


TYPES = pa.schema([("part", pa.int64()), ("n", pa.float64()), ("mean", pa.list_(pa.float64())), ("k", pa.int32()),
                   ("rows", pa.list_(pa.float64())), ("lost", pa.float64()), ("total", pa.float64())])


def summarise(df: DataFrame, x: str, rows: int = ROWS, fan_in: int = FAN_IN) -> Summary | None:
    """The summary of a column of vectors; null vectors take no part, and without any vector there is none (None).

    The result holds at most 2 ``rows`` rows; tasks pass on one summary each, never products of d by d.
    """
    if rows < 1 or fan_in < 2:
        raise ValueError("rows must be positive and fan_in at least 2")

    def run(batches):
        whole = None
        for b in batches:
            for s in range(0, b.num_rows, 2 * rows):
                one = summary_of(matrix(b.column("_x").slice(s, 2 * rows)), rows)
                whole = one if whole is None else merged(whole, one, rows)
        if whole is not None:
            yield pa.RecordBatch.from_pydict(_pack(TaskContext.get().partitionId(), whole), schema=TYPES)

    def join(table: pa.Table) -> pa.Table:
        whole, parts = None, table.sort_by("part")
        for i in range(parts.num_rows):
            one = _unpack(parts.slice(i, 1).to_pylist()[0])
            whole = one if whole is None else merged(whole, one, rows)
        return pa.Table.from_pydict(_pack(parts.column("part")[0].as_py() // fan_in, whole), schema=TYPES)

    vectors = df.select(doubles(x).alias("_x")).where(F.col("_x").isNotNull())
    parts = materialize(vectors.mapInArrow(run, SCHEMA))
    last = parts.agg(F.max("part")).first()[0]
    if last is None:
        return None
    while last > 0:
        parts = parts.groupBy(F.floor(F.col("part") / fan_in)).applyInArrow(join, SCHEMA)
        last //= fan_in
    return _unpack(parts.first().asDict())


@dataclass
class Fitted:
    """A projection, and between what bounds the share of variance lies that its directions keep."""

    projection: Projection
    kept_at_least: float
    kept_at_most: float


def fit(df: DataFrame, x: str, k: int, rows: int = ROWS, fan_in: int = FAN_IN) -> Fitted:
    """The k directions of largest variance, from a summary of ``rows`` rows; k at most ``rows``.

    What the directions keep of the variance lies between the bounds, both exact statements; so does what the best k
    directions would keep. They meet where the table has no more than ``rows`` independent directions.
    """
    if k > rows:
        raise ValueError(f"{k} directions need a summary of as many rows, not {rows}")
    s = summarise(df, x, rows, fan_in)
    if s is None:
        raise ValueError("no vectors to fit")
    d = len(s.mean)
    values, axes = s.variances()
    axes = np.vstack([axes, np.zeros((max(0, k - len(axes)), d))])[:k]
    values = np.concatenate([values, np.zeros(max(0, k - len(values)))])[:k]
    total = s.total / max(s.n - 1, 1)
    if total <= 0:  # equal rows: every direction keeps everything
        return Fitted(Projection(s.mean, np.eye(k, d), np.full(k, 1.0 / k)), 1.0, 1.0)
    low = min(float(values.sum() / total), 1.0)
    return Fitted(Projection(s.mean, axes, values / total), low, min(1.0, low + k * s.gap() / total))


# --- projections as estimators and models -----------------------------------------------------------------------------

METHODS = ("exact", "summary", "random")


class _SqueezeParams(HasInputCol, HasOutputCol):
    k = Param(Params._dummy(), "k", "number of components", TypeConverters.toInt)
    method = Param(Params._dummy(), "method", "exact, summary or random", TypeConverters.toString)
    rows = Param(Params._dummy(), "rows", "rows of a summary", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of random directions", TypeConverters.toInt)

    def _defaults(self):
        self._setDefault(inputCol="x", outputCol="z", method="exact", rows=ROWS, seed=42)


class Squeeze(Estimator, _SqueezeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a projection to ``k`` components, as a stage of a pipeline.

    method: ``exact`` (d by d sums), ``summary`` (bounded summaries, for wide vectors) or ``random`` (seeded directions).
    """

    @keyword_only
    def __init__(self, *, k=None, inputCol="x", outputCol="z", method="exact", rows=ROWS, seed=42):
        super().__init__()
        self._defaults()
        self._set(**{name: v for name, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "SqueezeModel":
        x, k, method = self.getInputCol(), self.getOrDefault("k"), self.getOrDefault("method")
        if method not in METHODS:
            raise ValueError(f"method is one of {METHODS}")
        if method == "summary":
            found = fit(df, x, k, self.getOrDefault("rows"))
            p, bounds = found.projection, (found.kept_at_least, found.kept_at_most)
        elif method == "exact":
            p = reduction.fit_pca(df, x, k)
            kept = 1.0 if p.ratio is None else float(p.ratio.sum())
            bounds = (kept, kept)
        else:
            p, bounds = reduction.random_projection(df.select(F.size(x)).first()[0], k, self.getOrDefault("seed")), (0.0, 1.0)
        return self._copyValues(SqueezeModel(p, bounds))


class SqueezeModel(Model, _SqueezeParams, MLReadable, MLWritable):
    """A fitted projection: ``transform`` squeezes, ``restore`` goes back; ``save`` and ``load`` keep every digit."""

    def __init__(self, projection: Projection | None = None, kept: tuple[float, float] = (0.0, 1.0)):
        super().__init__()
        self._defaults()
        self.projection, self.kept = projection, kept

    def _transform(self, df: DataFrame) -> DataFrame:
        return reduction.squeeze(df, self.getInputCol(), self.projection, self.getOutputCol())

    def restore(self, df: DataFrame, name: str) -> DataFrame:
        """Least-squares way back from the output column."""
        return reduction.unsqueeze(df, self.getOutputCol(), self.projection, name)

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: SqueezeModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m, p = self.model, self.model.projection
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"kept": list(m.kept), "ratio": p.ratio is not None})
        share = [None] * len(p.components) if p.ratio is None else [float(v) for v in p.ratio]
        rows = [(-1, p.mean.tolist(), None), *((i, c.tolist(), share[i]) for i, c in enumerate(p.components))]
        self.sparkSession.createDataFrame(rows, "i int, v array<double>, share double").coalesce(1).write.parquet(f"{path}/data")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> SqueezeModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/data").orderBy("i").collect()  # k + 1 rows
        ratio = np.array([r["share"] for r in rows[1:]]) if meta["ratio"] else None
        out = self.cls(Projection(np.array(rows[0]["v"]), np.array([r["v"] for r in rows[1:]]), ratio), tuple(meta["kept"]))
        DefaultParamsReader.getAndSetParams(out, meta)
        out._resetUid(meta["uid"])
        return out
