"""Exact pair searches on few, large blocks.

Rows lie in cells, the leaves of a tree that halves a bounded sample of sketches along its widest coordinate. A sketch keeps
a vector's coordinates along the leading principal directions and the length of the rest, each as one byte, with the exact
error of that rounding. The box around a cell's sketches gives a lower bound between cells; pairs of cells beyond the search
radius never meet. Cells of any size are cut into blocks, so a task holds two blocks.

Blocks grow with the table (about BLOCKS of them, up to MOST_ROWS rows each), so what is shipped is a vector per row and
block, in proportion to the rows until blocks are full. A task compares its blocks tile by tile through matrix products,
takes direct distances wherever the product could decide otherwise, and returns results only: pairs within a radius, a
row's k nearest in the other block, one farthest pair, or the edges of a spanning forest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latentlake.functions.vec import doubles
from latentlake.operators.kernels import forest_edges, ints, matrix, spanning_forest
from latentlake.operators.moments import spectrum
from latentlake.plans.runtime import materialize, tasks

KEEP = 0.9999       # share of the variance along the kept directions
CELL_ROWS = 16_384
MAX_CELLS = 1_024
MOST_CELL_ROWS = 65_536
SAMPLE = 32         # sketches per cell that choose the cuts
BLOCKS = 24         # of a table, while they hold
MOST_ROWS = 32_768  # rows each
LEAST_BLOCK = 512
TILE = 2_000_000    # pairs compared at a time
STRIP = 262_144     # pairs compared in single precision at a time: they stay in a core's cache
WIDE = 4_096        # columns of a strip
SINGLE = 1e-24, 1e30  # squares that single precision can hold without losing more than its rounding
DOUBTS = 32         # a strip with more than one doubtful pair in so many is computed again in double precision
CHUNK = 65_536      # direct distances at a time
HELD = 1_000_000    # edges that a task holds before it drops those outside its forest
SHARE = 2_048       # rows of a block that bound its nearest ones
MARKS = 2_048       # sampled rows that bound paths
SLACK = 1e-9


@dataclass(frozen=True)
class Sketch:
    """Directions (p x d) around ``mean``, and the width that one unit of a byte stands for."""

    mean: np.ndarray
    axes: np.ndarray
    step: float

    def encode(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, error, length of the rest) of vectors."""
        c = m - self.mean
        y = c @ self.axes.T
        rest = np.sqrt(((c - y @ self.axes) ** 2).sum(1))
        full = np.hstack([y, rest[:, None]])
        code = np.clip(np.rint(full / self.step), -127, 127)
        err = np.sqrt(((full - code * self.step) ** 2).sum(1)) + SLACK * (np.sqrt((c ** 2).sum(1)) + self.step)
        return code.astype(np.int8), err, rest


def fit(df: DataFrame, x: str, keep: float = KEEP) -> tuple[Sketch, int]:
    """Directions that hold ``keep`` of the variance, and the number of rows; one pass."""
    n, mean, values, axes = spectrum(df, x)
    p = max(1, int(np.searchsorted(np.cumsum(values), keep * values.sum())) + 1) if values.sum() > 0 else 1
    return Sketch(mean, axes[:p], max(4.0 * math.sqrt(values[0]), 1e-12) / 127), n


def coded(df: DataFrame, vec_id: str, x: str, sketch: Sketch, carry: list[str] | None = None) -> DataFrame:
    """(vec_id, carry..., _code, _err, _rest, _v); ``_v`` holds the vector's own numbers."""
    carry = carry or []
    kept = [f for f in df.schema.fields if f.name in (vec_id, *carry)]
    schema = T.StructType([*kept, T.StructField("_code", T.BinaryType()), T.StructField("_err", T.DoubleType()), T.StructField("_rest", T.DoubleType()), T.StructField("_v", T.BinaryType())])
    names, kind = [f.name for f in kept], number(df, x)

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                m = matrix(part.column(x))
                code, err, rest = sketch.encode(m)
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], packed(code), pa.array(err), pa.array(rest), packed(m.astype(kind))], names=schema.names)

    return df.select(*names, doubles(x).alias(x)).mapInArrow(run, schema)


def number(df: DataFrame, x: str) -> type:
    """Vectors that are stored as float are shipped as such."""
    return np.float32 if df.schema[x].dataType == T.ArrayType(T.FloatType()) else np.float64


def packed(code: np.ndarray) -> pa.Array:
    n, w = code.shape
    return pa.array([code[i].tobytes() for i in range(n)], pa.binary())


def codes(column) -> np.ndarray:
    """Bytes of a binary column as an (n, p + 1) matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.int8).reshape(len(rows), -1)


class Side:
    """The rows of one block in a task."""

    def __init__(self, table: pa.Table, vec_id: str):
        self.table, self.ids = table, ints(table.column(vec_id))
        code = codes(table.column("_code"))
        kind = np.float32 if code.shape[1] * 254 ** 2 < 2 ** 24 else np.float64  # whole numbers stay exact
        self.code = code.astype(kind)
        self.square = (self.code ** 2).sum(1)
        self.err, self.rest = table.column("_err").to_numpy(), table.column("_rest").to_numpy()

    def __len__(self):
        return len(self.ids)


def bounds(a: Side, b: Side, rows: slice, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of some rows of a to all of b."""
    sq = a.square[rows, None] + b.square[None, :] - 2 * (a.code[rows] @ b.code.T)
    far = np.sqrt(sq.astype(np.float64)) * step
    err = a.err[rows, None] + b.err[None, :]
    upper = np.sqrt((far + err) ** 2 + (a.rest[rows, None] + b.rest[None, :]) ** 2)
    return np.maximum(far - err, 0.0), upper


# --- cells and blocks --------------------------------------------------------------------------------------------------

@dataclass
class Cells:
    """A tree of cuts, and per cell its box (in units of the step), largest error and number of rows."""

    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    err: np.ndarray
    rows: np.ndarray
    step: float
    block: int

    @property
    def blocks(self) -> np.ndarray:
        return np.maximum(1, -(-self.rows // self.block))

    @property
    def first(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.blocks)[:-1]])

    def apart(self) -> np.ndarray:
        """Lower bounds of the distances between the rows of two cells."""
        gap = np.zeros((len(self.rows),) * 2)
        for lo, hi in zip(self.low.T.astype(float), self.high.T.astype(float)):
            gap += np.maximum(0.0, np.maximum(lo[:, None] - hi[None, :], lo[None, :] - hi[:, None])) ** 2
        return np.maximum(np.sqrt(gap) * self.step - self.err[:, None] - self.err[None, :], 0.0)


def _tree(sample: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts (axis, value) of a complete binary tree, node 1 at the top; axis -1 sends everything left."""
    depth = max(0, math.ceil(math.log2(want)))
    axis, cut = np.full(1 << depth, -1), np.zeros(1 << depth)

    def split(node: int, rows: np.ndarray):
        if node >= 1 << depth:
            return
        if len(rows) > 1:
            at = int(np.argmax(rows.max(0).astype(int) - rows.min(0)))
            v = np.median(rows[:, at])
            if rows[:, at].min() < rows[:, at].max():
                axis[node], cut[node] = at, v if v < rows[:, at].max() else v - 0.5
                right = rows[:, at] > cut[node]
                split(2 * node, rows[~right]), split(2 * node + 1, rows[right])

    split(1, sample)
    return axis, cut


def leaf(code: np.ndarray, axis: np.ndarray, cut: np.ndarray) -> np.ndarray:
    node, size = np.ones(len(code), np.int64), len(axis)
    while size > 1:
        at = axis[node]
        node = 2 * node + ((at >= 0) & (code[np.arange(len(code)), np.maximum(at, 0)] > cut[node]))
        size >>= 1
    return node - len(axis)


def in_cells(rows: DataFrame, vec_id: str, n: int, step: float, cell_rows: int | None = None, block_rows: int | None = None) -> tuple[DataFrame, Cells]:
    """n sketched rows with ``_cell``, and the cells. At most MAX_CELLS boxes and SAMPLE sketches per cell reach the driver."""
    want = min(MAX_CELLS, max(1, -(-n // (cell_rows or cell_size(n)))))
    block = block_rows or block_size(n)
    if want == 1:  # one cell is never far from itself and needs no box
        none = np.zeros((1, 1), np.int8)
        return rows.withColumn("_cell", F.lit(0)), Cells(np.full(1, -1), np.zeros(1), none, none, np.zeros(1), np.array([n]), step, block)
    axis, cut = _tree(codes(rows.select("_code").orderBy(F.xxhash64(vec_id), vec_id).limit(SAMPLE * want).toArrow().column(0)), want)
    schema = T.StructType([*rows.schema.fields, T.StructField("_cell", T.IntegerType())])

    def place(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf(codes(b.column("_code")), axis, cut).astype(np.int32))], names=schema.names)

    def box(table: pa.Table) -> pa.Table:
        code = codes(table.column("_code"))
        return pa.table({"_cell": table.column("_cell")[:1], "low": packed(code.min(0)[None]), "high": packed(code.max(0)[None]), "err": [table.column("_err").to_numpy().max()], "n": [len(code)]})

    placed = materialize(rows.mapInArrow(place, schema))
    part = F.pmod(F.xxhash64(vec_id), F.lit(max(1, -(-n // 200_000))))  # a cell's box is put together from boxes of parts
    found = placed.select("_cell", "_code", "_err", part.alias("_part")).groupBy("_cell", "_part").applyInArrow(
        box, "_cell int, low binary, high binary, err double, n long").toArrow()
    cells = len(axis)
    width = len(found.column("low")[0].as_py()) if found.num_rows else 1
    low, high = np.full((cells, width), 127, np.int8), np.full((cells, width), -127, np.int8)
    err, size = np.zeros(cells), np.zeros(cells, np.int64)
    for c, lo, hi, e, m in zip(*(found.column(k).to_pylist() for k in ("_cell", "low", "high", "err", "n"))):
        low[c], high[c] = np.minimum(low[c], np.frombuffer(lo, np.int8)), np.maximum(high[c], np.frombuffer(hi, np.int8))
        err[c], size[c] = max(err[c], e), size[c] + m
    return placed, Cells(axis, cut, low, high, err, size, step, block)


def dealt(placed: DataFrame, cells: Cells, vec_id: str, meet: np.ndarray) -> DataFrame:
    """Rows at every pair of blocks (_i <= _j) of cells that meet; ``_side`` is the row's own block."""
    first, blocks = cells.first, cells.blocks
    meet, placed = meet | meet.T, placed.drop("_code", "_err", "_rest")
    if len(blocks) == 1:
        side = placed.withColumn("_side", F.pmod(F.xxhash64(vec_id), F.lit(int(blocks[0]))).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(int(blocks[0]) - 1))))
        return side.withColumns({"_i": F.least("_side", "_b"), "_j": F.greatest("_side", "_b")}).drop("_b", "_cell")
    rows = [(c, int(first[c]), int(blocks[c]), [(int(first[o]), int(blocks[o])) for o in np.flatnonzero(meet[c] & (cells.rows > 0)).tolist()])
            for c in np.flatnonzero(cells.rows > 0).tolist()]
    plan = placed.sparkSession.createDataFrame(rows, "_cell int, _f int, _n int, _o array<struct<f:int,n:int>>")  # at most MAX_CELLS squared entries
    both = placed.join(F.broadcast(plan), "_cell").withColumn("_side", F.col("_f") + F.pmod(F.xxhash64(vec_id), F.col("_n")).cast("int"))
    both = both.withColumn("_b", F.explode(F.flatten(F.transform("_o", lambda o: F.sequence(o["f"], o["f"] + o["n"] - 1)))))
    return both.withColumns({"_i": F.least("_side", "_b"), "_j": F.greatest("_side", "_b")}).drop("_f", "_n", "_o", "_b", "_cell")


class Block:
    """The rows of one block in a task."""

    def __init__(self, table: pa.Table, vec_id: str, kind: type):
        self.table, self.ids = table, ints(table.column(vec_id))
        self._of(np.frombuffer(b"".join(table.column("_v").to_pylist()), kind).astype(np.float64).reshape(len(self.ids), -1))

    @classmethod
    def of(cls, m: np.ndarray) -> Block:
        out = cls.__new__(cls)
        out._of(m)
        return out

    def _of(self, m: np.ndarray):
        self.m = m
        self.square = (self.m * self.m).sum(1)
        one = np.ones((len(self.m), 1))
        self.left = np.hstack([-2.0 * self.m, self.square[:, None], one])
        self.right = np.hstack([self.m, one, self.square[:, None]]).T

    def __len__(self):
        return len(self.m)

    def column(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()


def slack(a: Block, b: Block) -> float:
    """What a squared distance from the product may be off, with room to spare."""
    return 1e-12 * (a.square.max(initial=0.0) + b.square.max(initial=0.0))


def tiles(a: Block, b: Block, same: bool):
    """(first row, squared distances of some rows of a to all of b); a row's own entry is nan."""
    step = max(1, TILE // max(1, len(b)))
    for s in range(0, len(a), step):
        sq = a.left[s:s + step] @ b.right
        if same:
            at = np.arange(len(sq))
            sq[at, s + at] = np.nan
        yield s, sq


def strips(a: Block, b: Block, same: bool, pairs: int = STRIP):
    """(first row, first column, squared distances, what they may be off) of some rows of a to some of b; a row's own entry is nan.

    Products in single precision, of vectors around a common centre; in double precision where the numbers don't fit.
    """
    centre = b.m.mean(0)
    p = a.m - centre
    q = p if same else b.m - centre
    u, v = (p * p).sum(1), (q * q).sum(1)
    most = u.max(initial=0.0) + v.max(initial=0.0)
    if SINGLE[0] < most < SINGLE[1]:
        one = np.ones((max(len(p), len(q)), 1))
        left = np.hstack([-2.0 * p, u[:, None], one[:len(p)]]).astype(np.float32)
        right = np.ascontiguousarray(np.hstack([q, one[:len(q)], v[:, None]]).astype(np.float32).T)
        room = (left.shape[1] + 16) * 2.0 ** -23 * most + slack(a, b)  # each of the terms, at most 2 x most in all, is rounded and added
    else:
        left, right, room = a.left, b.right, slack(a, b)
    columns = min(pairs, WIDE)
    rows = max(1, pairs // columns)
    for t in range(0, len(b), columns):
        panel = np.ascontiguousarray(right[:, t:t + columns])
        for s in range(0, len(a), rows):
            sq = left[s:s + rows] @ panel
            if same:
                sq[own_entries(s, t, sq.shape)] = np.nan
            yield s, t, sq, room


def own_entries(s: int, t: int, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Where a strip of a block with itself holds rows' own entries."""
    own = np.arange(max(s, t), max(s, t, min(s + shape[0], t + shape[1])))
    return own - s, own - t


def sharper(a: Block, b: Block, same: bool, s: int, t: int, shape: tuple[int, int]) -> tuple[np.ndarray, float]:
    """A strip in double precision, and what it may be off."""
    sq = a.left[s:s + shape[0]] @ b.right[:, t:t + shape[1]]
    if same:
        sq[own_entries(s, t, sq.shape)] = np.nan
    return sq, slack(a, b)


def farther(a: Block, b: Block, same: bool, s: int, t: int, sq: np.ndarray, room: float, best: float) -> float:
    """The largest of ``best`` and the distances of a strip."""
    top = float(np.fmax.reduce(sq, axis=None, initial=0.0))
    if top + room < best * best:
        return best
    i, j = hits(sq >= max(top - 2 * room, best * best - room))
    if len(i) * DOUBTS > sq.size and sq.dtype == np.float32:
        return farther(a, b, same, s, t, *sharper(a, b, same, s, t, sq.shape), best)
    return max(best, float(directly(a, b, i + s, j + t).max(initial=0.0)))


def hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def directly(a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of row i of a to row j of b from the vectors themselves."""
    out = np.empty(len(i))
    for s in range(0, len(i), CHUNK):
        part = slice(s, s + CHUNK)
        out[part] = np.sqrt(((a.m[i[part]] - b.m[j[part]]) ** 2).sum(1))
    return out


def lightest(rows: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k nearest entries of every row, ties by id."""
    order = np.lexsort((ids, d, rows))
    first = np.flatnonzero(np.concatenate([[True], np.diff(rows[order]) != 0])) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(first, np.diff([*first, len(order)]))
    return order[rank < k]


def on_blocks(tasked: DataFrame, vec_id: str, kind: type, kernel, schema: str, pairs: int) -> DataFrame:
    """``kernel(left, right, same)`` on both sides of every task with rows on both; tasks are dealt over at most ``pairs`` partitions."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names, kinds = schema.names, {"bigint": pa.int64(), "double": pa.float64()}
    known = [kinds.get(f.dataType.simpleString()) for f in schema.fields]

    def run(table: pa.Table) -> pa.Table:
        side = ints(table.column("_side"))
        i, j = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
        left, right = table.filter(pa.array(side == i)), table.filter(pa.array(side == j))
        arrow = pa.schema([(n, t or table.schema.field(n[:-2]).type) for n, t in zip(names, known)])  # carried columns end in _a or _b
        parts = [arrow.empty_table()]
        if left.num_rows and right.num_rows:
            a = Block(left, vec_id, kind)
            for found in kernel(a, a if i == j else Block(right, vec_id, kind), i == j):
                parts.append(pa.table([pa.array(c, t) if isinstance(c, np.ndarray) else pa.chunked_array(c, t) for c, t in zip(found, arrow.types)], schema=arrow))
        return pa.concat_tables(parts)

    return tasked.repartition(max(1, min(pairs, 4 * tasks(tasked.sparkSession))), "_i", "_j").groupBy("_i", "_j").applyInArrow(run, schema)


def block_size(n: int) -> int:
    """Rows per block of a table of n rows."""
    return min(MOST_ROWS, max(LEAST_BLOCK, -(-n // BLOCKS)))


def cell_size(n: int) -> int:
    return min(MOST_CELL_ROWS, max(CELL_ROWS, -(-n // 16)))


# --- searches ----------------------------------------------------------------------------------------------------------

class Index:
    """Distinct vectors in cells, for several searches over the same table."""

    def __init__(self, df: DataFrame, vec_id: str, x: str, carry: list[str] | None = None, keep: float = KEEP, cell_rows: int | None = None, block_rows: int | None = None):
        self.vec_id, self.carry, self.kind = vec_id, carry or [], number(df, x)
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.sketch, self.rows = fit(df, x, keep)
        coded_rows = materialize(coded(df, vec_id, x, self.sketch, self.carry))
        self.placed, self.cells = in_cells(coded_rows, vec_id, self.rows, self.sketch.step, cell_rows, block_rows)

    def _run(self, placed: DataFrame, meet: np.ndarray, kernel, schema) -> DataFrame:
        blocks = int(self.cells.blocks.sum())
        return on_blocks(dealt(placed, self.cells, self.vec_id, meet), self.vec_id, self.kind, kernel, schema, blocks * (blocks + 1) // 2)

    def within(self, tau: float) -> DataFrame:
        """(a, b, d, carry_a.., carry_b..) of all pairs with a < b and d <= tau."""
        carry = self.carry

        def kernel(left, right, same):
            for s, sq in tiles(left, right, same):
                i, j = hits(sq <= tau * tau + slack(left, right))
                i += s
                if same:
                    i, j = i[i < j], j[i < j]
                d = directly(left, right, i, j)
                near = d <= tau
                i, j, d = i[near], j[near], d[near]
                flip = left.ids[i] > right.ids[j]
                for turned, p, q, r, t in ((False, left, right, i[~flip], j[~flip]), (True, right, left, j[flip], i[flip])):
                    yield p.ids[r], q.ids[t], d[flip == turned], *[one.table.column(c).take(pa.array(at)).chunks for c in carry for one, at in ((p, r), (q, t))]

        ends = [T.StructField(f"{c}_{k}", self.types[c]) for c in carry for k in ("a", "b")]
        schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("d", T.DoubleType()), *ends])
        return self._run(self.placed, self.cells.apart() <= tau, kernel, schema)

    def summed(self, tau: float, kernel, schema: str) -> DataFrame:
        """What ``kernel(left, right, same)`` says of the pairs of blocks that can hold pairs within tau."""
        return self._run(self.placed, self.cells.apart() <= tau, kernel, schema)

    def nearest(self, k: int) -> DataFrame:
        """(a, b, d): the k nearest rows of every row, ties to the smaller id.

        A row's own cell comes first; its k-th distance there limits the search in the other cells.
        """
        def limit(rows, others, same):
            """Squared distances within which a row has k of the others for certain: its k-th so far, or that of a share of the others."""
            most = rows.column("_most") ** 2 if "_most" in rows.table.column_names else np.full(len(rows), np.inf)
            share = others.right[:, ::-(-len(others) // SHARE)]
            if share.shape[1] > k:
                step = max(1, TILE // share.shape[1])
                for s in range(0, len(rows), step):
                    kth = np.partition(rows.left[s:s + step] @ share, k if same else k - 1, axis=1)[:, k if same else k - 1]  # the row itself may be among them
                    most[s:s + step] = np.minimum(most[s:s + step], kth + slack(rows, others))
            return most + slack(rows, others)

        def kernel(left, right, same):
            ways = [(left, right, limit(left, right, same))] + ([] if same else [(right, left, limit(right, left, False))])
            held = [[np.zeros(0, int), np.zeros(0, int), np.zeros(0)] for _ in ways]

            def reduced(w):
                keep = lightest(held[w][0], held[w][2], ways[w][1].ids[held[w][1]], k)
                held[w] = [c[keep] for c in held[w]]

            for s, sq in tiles(left, right, same):
                for w, (rows, others, most) in enumerate(ways):
                    i, j = hits(sq <= (most[None, :] if w else most[s:s + len(sq), None]))
                    i, j = (j, i + s) if w else (i + s, j)
                    held[w] = [np.concatenate(c) for c in zip(held[w], (i, j, directly(rows, others, i, j)))]
                    if len(held[w][0]) > HELD + k * len(rows):
                        reduced(w)
            for w, (rows, others, _) in enumerate(ways):
                reduced(w)
                yield rows.ids[held[w][0]], others.ids[held[w][1]], held[w][2]

        schema = "a long, b long, d double"
        inside = np.eye(len(self.cells.rows), dtype=bool)
        found = self._run(self.placed, inside, kernel, schema)
        if len(inside) > 1:
            found = materialize(found)
            kth = F.coalesce(F.get(F.array_sort(F.collect_list("d")), F.lit(k - 1)), F.lit(float("inf")))
            most = found.groupBy("a").agg(kth.alias("_most")).withColumnRenamed("a", self.vec_id)
            placed = materialize(self.placed.drop("_code", "_err", "_rest").join(most, self.vec_id, "left").withColumn("_most", F.coalesce("_most", F.lit(float("inf")))))
            reach = np.zeros(len(inside))
            for r in placed.groupBy("_cell").agg(F.max("_most").alias("m")).collect():  # one row per cell
                reach[r["_cell"]] = r["m"]
            found = found.unionByName(self._run(placed, (self.cells.apart() <= reach[:, None]) & ~inside, kernel, schema))
        lists = found.groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "b"))), 1, k).alias("l"))  # k entries per block met
        return lists.select("a", F.inline("l")).select("a", "b", "d")

    def farthest(self) -> float:
        """The largest distance; 0 for fewer than two rows."""
        def kernel(left, right, same):
            best = 0.0
            for s, t, sq, room in strips(left, right, same):
                best = farther(left, right, same, s, t, sq, room, best)
            yield (np.array([best]),)

        every = np.ones((len(self.cells.rows),) * 2, bool)
        return self._run(self.placed, every, kernel, "d double").agg(F.max("d")).first()[0] or 0.0

    def forest(self, marks: int | None = None) -> DataFrame:
        """Edges (a, b, d) that hold a minimum spanning tree: of every pair of blocks those of its own spanning forest; and per pair
        of blocks one with a = b and the largest distance.

        Sampled rows bound the search. Between two rows there is the path over their nearest sampled rows and the sample's
        own tree; a pair farther apart than the longest step of that path is no edge of the tree and is dropped at once.
        """
        vec_id, kind = self.vec_id, self.kind
        marks = marks or min(MARKS, max(64, self.rows // 16))
        some = self.placed.select(vec_id, "_v").orderBy(F.xxhash64(vec_id), vec_id).limit(marks).select("_v").toArrow().column(0).to_pylist()
        at = np.frombuffer(b"".join(some), kind).astype(np.float64).reshape(len(some), -1)
        order, gap = single_linkage(*spanning_forest(np.sqrt(np.array([((at - v) ** 2).sum(1) for v in at]))), len(at))
        at = at[order]
        schema = T.StructType([*self.placed.drop("_code", "_err", "_rest").schema.fields, T.StructField("_at", T.IntegerType()), T.StructField("_far", T.DoubleType())])

        def place(batches):
            base = (at * at).sum(1)
            for whole in batches:
                for s in range(0, whole.num_rows, 512):
                    b = whole.slice(s, 512)
                    m = np.frombuffer(b"".join(b.column("_v").to_pylist()), kind).astype(np.float64).reshape(b.num_rows, -1)
                    near = np.argmin(base[None, :] - 2.0 * (m @ at.T), axis=1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(np.sqrt(((m - at[near]) ** 2).sum(1)))], names=schema.names)

        steps = []  # between all marks, once per task

        def kernel(left, right, same):
            up = 1 + 2.0 ** -20  # limits are not to be rounded down
            own, theirs = left.column("_at"), right.column("_at")
            if not steps:
                steps.append(between(gap) ** 2 * up)
            limits = steps[0], left.column("_far") ** 2 * up, right.column("_far") ** 2 * up
            kinds = {np.dtype(np.float64): limits}

            def longest(kind, rows, columns):
                """Squares of the longest steps of the paths over marks."""
                if kind not in kinds:
                    kinds[kind] = tuple(c.astype(kind) for c in limits)
                step, far, there = kinds[kind]
                path = np.take(np.maximum(step[own[rows]], far[rows, None]), theirs[columns], axis=1)
                return np.maximum(path, there[None, columns], out=path)

            a, b, d = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
            fresh, n, best = [], 0, 0.0

            def reduced():
                i, j = (np.concatenate(c) for c in zip((a, b), *[f[:2] for f in fresh]))
                w = np.concatenate([d, *[f[2] for f in fresh]])
                keep = forest_edges(i, j if same else j + len(left), w, len(left) + (0 if same else len(right)), left.ids[i], right.ids[j])
                return i[keep], j[keep], w[keep]

            for s, t, sq, room in strips(left, right, same):
                best = farther(left, right, same, s, t, sq, room, best)
                if same and s >= t + sq.shape[1]:  # each pair once
                    continue
                rows, columns = slice(s, s + sq.shape[0]), slice(t, t + sq.shape[1])
                i, j = hits(sq <= longest(sq.dtype, rows, columns) + sq.dtype.type(room * up))
                if len(i) * DOUBTS > sq.size and sq.dtype == np.float32:
                    sq, room = sharper(left, right, same, s, t, sq.shape)
                    i, j = hits(sq <= longest(sq.dtype, rows, columns) + room)
                i, j = i + s, j + t
                if same:
                    i, j = i[i < j], j[i < j]
                fresh.append((i, j, directly(left, right, i, j)))
                n += len(i)
                if n > HELD:
                    (a, b, d), fresh, n = reduced(), [], 0
            a, b, d = reduced()
            yield np.minimum(left.ids[a], right.ids[b]), np.maximum(left.ids[a], right.ids[b]), d
            yield left.ids[:1], left.ids[:1], np.array([best])

        placed = materialize(self.placed.drop("_code", "_err", "_rest").mapInArrow(place, schema))
        return self._run(placed, np.ones((len(self.cells.rows),) * 2, bool), kernel, "a long, b long, d double")


def single_linkage(a: np.ndarray, b: np.ndarray, d: np.ndarray, n: int) -> tuple[list[int], np.ndarray]:
    """Points in an order in which every cluster of the tree (a, b, d) is a stretch, and the step between each and its next.

    The longest step of the tree's path between two points is the largest of the steps between them in that order.
    """
    held, root = {i: ([i], []) for i in range(n)}, list(range(n))
    for e in np.argsort(d, kind="stable").tolist():
        u, v = root[a[e]], root[b[e]]
        if len(held[u][0]) < len(held[v][0]):
            u, v = v, u
        points, steps = held.pop(v)
        held[u] = held[u][0] + points, held[u][1] + [d[e]] + steps
        for p in points:
            root[p] = u
    (order, gap), = held.values()
    return order, np.array(gap, float)


def between(gap: np.ndarray) -> np.ndarray:
    """Largest of the steps between any two points of a row of points."""
    out = np.zeros((len(gap) + 1,) * 2)
    for i in range(len(gap)):
        out[i, i + 1:] = np.maximum.accumulate(gap[i:])
    return np.maximum(out, out.T)
