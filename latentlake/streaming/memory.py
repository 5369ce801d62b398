"""Leaky recurrent memory per key, on streams and on tables.

h' = (1 - leak) h + leak tanh(W_in x + W_res h), readout y = W_out h'. A ``commit`` row returns the readout once and
closes the key; rows after it are rejected. A ``reset`` row clears an open key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from latentlake.functions.vec import doubles
from latentlake.operators.kernels import ints, matrix, vectors
from latentlake.operators.ordered import ROWS_PER_TASK, running
from latentlake.plans.runtime import materialize

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Memory:
    """Parameters; the matrices follow from the seed, so every task builds the same ones."""

    d: int
    scale: int = 4
    radius: float = 0.9
    input_scaling: float = 0.1
    leak: float = 0.3
    seed: int = 42

    def __post_init__(self):
        if self.d < 1 or self.scale < 1:
            raise ValueError("d and scale must be at least 1")
        if not 0 < self.radius < 1:
            raise ValueError("radius must lie strictly between 0 and 1")
        if not 0 < self.leak <= 1:
            raise ValueError("leak must be in (0, 1]")

    def matrices(self):
        """Weights from the inputs, between the units and to the outputs.

        The units form a ring; every unit listens to those at a tenth of all distances, the same distances for all units,
        so the pattern is sparse and never free of cycles. Its weights are scaled to the wanted spectral radius.
        """
        units, rng = self.d * self.scale, np.random.default_rng(self.seed)
        distances = rng.permutation(units)[:max(1, units // 10)]
        heard = (np.arange(units)[:, None] + distances) % units
        inner = np.zeros((units, units))
        np.put_along_axis(inner, heard, rng.uniform(0.2, 1.0, heard.shape) * rng.choice([-1.0, 1.0], heard.shape), axis=1)
        inner *= self.radius / np.abs(np.linalg.eigvals(inner)).max()
        fed = rng.uniform(-1.0, 1.0, (units, self.d)) * self.input_scaling
        return fed, inner, rng.uniform(-1.0, 1.0, (self.d, units)) / np.sqrt(units)


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x w', summed in the same order for a row whatever other rows are there, so that all ways give equal digits."""
    return np.einsum("mi,ri->mr", x, w)


def statuses(df: DataFrame, key: str, order: list[str], kind: str | None = None, limit: int = ROWS_PER_TASK) -> DataFrame:
    """df with ``status`` (step, reset, committed, rejected), ``_rn`` (place in its key) and ``_part`` (resets so far).

    What becomes of a row follows from the commits and resets before it: no memory is run for it.
    """
    said = F.col(kind) if kind else F.lit("step")
    marks = df.withColumns({"_is_commit": (said == "commit").cast("int"), "_is_reset": (said == "reset").cast("int")})
    rows = running(marks, [key], order, {"_rn": ("count", None), "_commits": ("sum", "_is_commit"), "_part": ("sum", "_is_reset")}, limit)
    status = F.when(F.col("_commits") > F.col("_is_commit"), "rejected").when(F.col("_is_commit") == 1, "committed") \
        .when(F.col("_is_reset") == 1, "reset").otherwise("step")
    return rows.withColumn("status", status).drop("_is_commit", "_is_reset", "_commits")


def _advance(mem: Memory, mats, x: np.ndarray, first: np.ndarray, length: np.ndarray, h: np.ndarray):
    """Readouts of all rows, and end states, of units that run side by side: unit u has the rows first[u] .. + length[u]."""
    w_in, w_res, w_out = mats
    order = np.argsort(-length, kind="stable")
    first, left, h = first[order], length[order], h[order].copy()
    y = np.zeros((len(x), len(w_out)))
    for t in range(int(left.max(initial=0))):
        m = int(np.searchsorted(-left, -t, side="left"))  # units with more than t rows
        at = first[:m] + t
        h[:m] = (1 - mem.leak) * h[:m] + mem.leak * np.tanh(_times(x[at], w_in) + _times(h[:m], w_res))
        y[at] = _times(h[:m], w_out)
    ends = np.empty_like(h)
    ends[order] = h
    return y, ends


def _told(mem: Memory, mats, kinds: np.ndarray, x: np.ndarray, h: np.ndarray, committed: bool):
    """Statuses and readouts of one key's rows in order, then its state: stretches between resets advance side by side."""
    n = len(kinds)
    stop = 0 if committed else int(np.argmax(kinds == "commit")) if (kinds == "commit").any() else n
    resets = np.flatnonzero(kinds[:stop] == "reset")
    status, y = np.full(n, "rejected", dtype=object), [None] * n
    if committed:
        return status, y, h, True
    status[:stop] = "step"
    status[resets] = "reset"
    first = np.concatenate([[0], resets + 1])
    start = np.zeros((len(first), len(h)))
    start[0] = h
    told, ends = _advance(mem, mats, x, first, np.append(resets, stop) - first, start)
    for i in np.flatnonzero(status == "step").tolist():
        y[i] = told[i].tolist()
    if stop == n:
        return status, y, ends[-1], False
    status[stop], y[stop] = "committed", _times(ends[-1:], mats[2])[0].tolist()
    return status, y, np.zeros_like(h), True


def remember(df: DataFrame, key: str, order: list[str], row_id: str, x: str, mem: Memory, kind: str | None = None,
             chunk_rows: int = 100_000, limit: int = ROWS_PER_TASK, task_rows: int = 50_000) -> DataFrame:
    """Readouts of a whole table: (key, row_id, status, y).

    Commits and resets are found first, by sums in order. A reset starts from nothing, so the stretches between resets are
    independent, and only rows that are taken run at all. A task advances many stretches as one matrix, row by row in
    time. Long stretches are cut into chunks that run side by side: a chunk starts from the state that its predecessor
    ended with, and only chunks whose start changed run again, until none does. Then every chunk has run from its true
    start, so the result is that of one sequential run. Old states fade, so few rounds are needed.
    """
    mats, r = mem.matrices(), mem.d * mem.scale
    types = dict(df.dtypes)
    key_type, id_type = types[key], types[row_id]
    rows = df.select(key, F.col(row_id).alias("_id"), *[c for c in order if c not in (key, row_id)], *([row_id] if row_id in order else []),
                     doubles(x).alias("_x"), (F.col(kind) if kind else F.lit("step")).alias("_kind"))
    rows = statuses(rows, key, order, "_kind", limit).select(key, "_id", "_rn", "_part", "_x", "status")
    n, longest = rows.agg(F.count(F.lit(1)), F.max("_rn")).first()
    parts = max(1, -(-n // task_rows))
    taken = rows.where(F.col("status").isin("step", "committed")).withColumn("_chunk", F.floor(F.col("_rn") / chunk_rows))
    taken = taken.withColumn("_task", F.pmod(F.xxhash64(key, "_part", "_chunk"), F.lit(parts)))
    unit = [key, "_part", "_chunk"]

    def run(table: pa.Table, only_end: bool) -> pa.Table:
        named = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices
        part, chunk, rn = (ints(table.column(c)) for c in ("_part", "_chunk", "_rn"))
        pos = np.lexsort((rn, chunk, part, ints(named)))
        table, names = table.take(pa.array(pos)), np.stack([ints(named), part, chunk])[:, pos]
        first = np.flatnonzero(np.concatenate([[True], (names[:, 1:] != names[:, :-1]).any(0)]))
        length = np.diff(np.append(first, len(pos)))
        last = np.array(table.column("status").to_pylist(), dtype=object)[first + length - 1] == "committed"  # a commit comes last and takes no step
        if "_h" in table.column_names:
            given = table.column("_h").take(pa.array(first)).to_pylist()
            start = np.array([np.zeros(r) if v is None else v for v in given])
        else:
            start = np.zeros((len(first), r))
        y, ends = _advance(mem, mats, matrix(table.column("_x")), first, length - last, start)
        if only_end:
            heads = table.take(pa.array(first))
            return pa.table({key: heads.column(key), "_part": heads.column("_part"), "_chunk": pa.array(names[2, first] + 1), "_h": vectors(ends)})
        y[(first + length - 1)[last]] = _times(ends[last], mats[2])
        return pa.table({key: table.column(key), row_id: table.column("_id"), "status": table.column("status"), "y": vectors(y)})

    out_schema = f"{key} {key_type}, {row_id} {id_type}, status string, y array<double>"
    end_schema = f"{key} {key_type}, _part long, _chunk long, _h array<double>"
    if (longest or 0) >= chunk_rows:
        taken = materialize(taken)
        units = materialize(taken.select(*unit).distinct())
        started = units.withColumn("_h", F.lit(None).cast("array<double>"))
        again = started
        while True:
            ends = attached(taken, again, unit).groupBy("_task").applyInArrow(lambda t: run(t, True), end_schema)
            ends = materialize(ends.withColumnsRenamed({c: f"_o_{c}" for c in unit}).withColumnRenamed("_h", "_n"))
            both = started.join(ends, reduce(lambda a, b: a & b, [started[c].eqNullSafe(ends[f"_o_{c}"]) for c in unit]), "left")
            moved = F.col("_n").isNotNull() & (F.col("_h").isNull() | (F.col("_h") != F.col("_n")))
            both = materialize(both.withColumn("_moved", moved).select(*unit, F.when(moved, F.col("_n")).otherwise(F.col("_h")).alias("_h"), "_moved"))
            started, again = both.drop("_moved"), both.where("_moved").drop("_moved")
            if again.isEmpty():
                break
        taken = attached(taken, started, unit)
    done = taken.groupBy("_task").applyInArrow(lambda t: run(t, False), out_schema)
    others = rows.where(~F.col("status").isin("step", "committed")).select(key, F.col("_id").alias(row_id), "status", F.lit(None).cast("array<double>").alias("y"))
    return done.unionByName(others)


def attached(rows: DataFrame, starts: DataFrame, unit: list[str]) -> DataFrame:
    """Rows of the units in ``starts``, with the unit's start state (null keys are keys)."""
    other = starts.withColumnsRenamed({c: f"_s_{c}" for c in unit})
    both = rows.join(other, reduce(lambda a, b: a & b, [rows[c].eqNullSafe(other[f"_s_{c}"]) for c in unit]))
    return both.drop(*[f"_s_{c}" for c in unit])


class MemoryProcessor(StatefulProcessor):
    """The same memory on a stream: one value state per key."""

    def __init__(self, mem: Memory, key: str, order: list[str], row_id: str, features: list[str], kind: str | None):
        self.mem, self.key, self.order, self.row_id, self.features, self.kind = mem, key, order, row_id, features, kind

    def init(self, handle):
        self.mats = self.mem.matrices()
        self.state = handle.getValueState("memory", "h array<double>, committed boolean")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        batch = pd.concat(list(rows)).sort_values(self.order)
        h, committed = self.state.get() if self.state.exists() else (np.zeros(self.mem.d * self.mem.scale), False)
        kinds = batch[self.kind].to_numpy() if self.kind else np.full(len(batch), "step")
        status, y, h, committed = _told(self.mem, self.mats, kinds, batch[self.features].to_numpy(dtype=float), np.array(h, dtype=np.float64), committed)
        self.state.update((h.tolist(), committed))
        yield pd.DataFrame({self.key: [key[0]] * len(batch), self.row_id: batch[self.row_id].to_numpy(), "status": status, "y": y})

    def handleInitialState(self, key, initialState, timerValues):
        self.state.update(([0.0] * (self.mem.d * self.mem.scale), True))

    def close(self):
        pass


def remember_stream(stream: DataFrame, key: str, order: list[str], row_id: str, features: list[str], mem: Memory,
                    kind: str | None = None, committed: DataFrame | None = None) -> DataFrame:
    """Readouts of a stream; rows of a key arriving in one micro-batch are taken in ``order``.

    ``committed``: a table with the keys that have committed before, such as the committed rows of an earlier run's sink. A
    stream that starts without a checkpoint rejects the rows of these keys.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    types = dict(stream.dtypes)
    return stream.groupBy(key).transformWithStateInPandas(
        MemoryProcessor(mem, key, order, row_id, features, kind),
        outputStructType=f"{key} {types[key]}, {row_id} {types[row_id]}, status string, y array<double>",
        outputMode="Append", timeMode="None", initialState=None if committed is None else committed.select(key).distinct().groupBy(key))


def _mapped(df: DataFrame, x: str, fn, name: str) -> DataFrame:
    schema = T.StructType([*[f for f in df.schema.fields if f.name != name], T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in schema.names[:-1]], vectors(fn(matrix(b.column(x))))], names=schema.names)

    return df.mapInArrow(run, schema)


def stepped(df: DataFrame, x: str, mem: Memory, h: str = "h") -> DataFrame:
    """df with the state of a fresh memory after one step on x."""
    w_in = mem.matrices()[0]
    return _mapped(df, x, lambda m: mem.leak * np.tanh(_times(m, w_in)), h)


def read_out(df: DataFrame, h: str, mem: Memory, name: str = "memory") -> DataFrame:
    w_out = mem.matrices()[2]
    return _mapped(df, h, lambda m: _times(m, w_out), name)


def commit_best(candidates: DataFrame, group: str, vec_id: str, weight: str, h: str, committed: str, mem: Memory) -> DataFrame:
    """(group, vec_id, status, y): per group the candidate of largest weight (smaller id on ties) reads its memory out once.

    A group whose best candidate has already committed is rejected. The caller closes the memories named here.
    """
    types, w_out = dict(candidates.dtypes), mem.matrices()[2]
    best = candidates.groupBy(group).agg(F.max_by(F.struct(vec_id, h, committed), F.struct(F.col(weight).alias("w"), (-F.col(vec_id)).alias("i"))).alias("b"))
    best = best.select(group, F.col(f"b.{vec_id}").alias(vec_id), doubles(f"b.{h}").alias("_h"), F.col(f"b.{committed}").alias("_closed"))

    def read(batches):
        for b in batches:
            if b.num_rows:
                y, closed = vectors(matrix(b.column("_h")) @ w_out.T), b.column("_closed").to_pylist()
                yield pa.RecordBatch.from_arrays([
                    b.column(group), b.column(vec_id), pa.array(["rejected" if c else "committed" for c in closed]),
                    pa.array([None if c else v for c, v in zip(closed, y.to_pylist())], pa.list_(pa.float64()))], names=[group, vec_id, "status", "y"])

    return best.mapInArrow(read, f"{group} {types[group]}, {vec_id} {types[vec_id]}, status string, y array<double>")
