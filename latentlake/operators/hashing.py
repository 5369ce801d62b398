"""Approximate similarity join by p-stable hashing.

A table of the scheme cuts random directions into steps of one width; vectors within a distance share a key of several such
steps with a known probability. Number of directions, width and number of tables are chosen for a wanted recall at the
threshold, as cheaply as a bounded sample of distances says. Vectors meet in their bucket, per table; a large bucket is cut into blocks
that grow with the table, and blocks are compared tile by tile. The direct distance decides, so that all pairs returned are
right and only some of those near the threshold may be missing. A pair that several tables bring together is returned by the
first of them, so pairs are never collected to be told apart.

``against_exact`` counts what a scheme should find among all pairs within its threshold: sums and digests, no pairs.
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
from latentlake.operators.blocks import BLOCK_ROWS, on_pairs, pair_tasks
from latentlake.operators.kernels import ints, matrix, pairwise
from latentlake.operators.sketch import Block, Index, block_size, directly, hits, slack, tiles
from latentlake.plans.runtime import tasks

RECALL = 0.95
SAMPLE = 512
MOST_TABLES = 256
WIDTHS = (1.0, 1.5, 2.0, 3.0, 4.0)
SHIPPED = 64.0      # cost of sending a vector to a table, where comparing two vectors is 0.05


def together(d: np.ndarray, width: float) -> np.ndarray:
    """Probability that two vectors at distance d fall into one step of a random direction."""
    t = width / np.maximum(np.asarray(d, float), 1e-12)
    below = np.array([0.5 * (1 + math.erf(-v / math.sqrt(2))) for v in t.reshape(-1)]).reshape(t.shape)
    return np.maximum(0.0, 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * t) * (1 - np.exp(-t * t / 2)))


@dataclass(frozen=True)
class Scheme:
    tables: int
    directions: int
    width: float
    seed: int = 42

    def expected_recall(self, d: float) -> float:
        """Share of the pairs at distance d that at least one table brings together."""
        return float(1 - (1 - together(np.array([d]), self.width)[0] ** self.directions) ** self.tables)

    def keys(self, m: np.ndarray, first: int | None = None) -> np.ndarray:
        """(rows, tables) of 64-bit keys, for the ``first`` tables only if given."""
        tables = self.tables if first is None else first
        rng = np.random.default_rng(self.seed)
        n = self.tables * self.directions
        a, b = rng.standard_normal((m.shape[1], n)), rng.random(n) * self.width
        key = np.zeros((len(m), tables), np.uint64)
        for s in range(0, len(m), 4096):  # the same products as in the rows' own tables
            key[s:s + 4096] = self._mixed(np.floor((m[s:s + 4096] @ a + b) / self.width).astype(np.int64).reshape(-1, self.tables, self.directions)[:, :tables])
        return key.astype(np.int64)

    def _mixed(self, step: np.ndarray) -> np.ndarray:
        key = np.zeros(step.shape[:2], np.uint64)
        for k in range(self.directions):
            key = (key ^ step[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key


def choose(df: DataFrame, vec_id: str, x: str, tau: float, recall: float = RECALL, n: int | None = None) -> Scheme:
    """The cheapest scheme with the recall at tau: shipped vectors plus compared pairs, as a sample of distances says."""
    n = df.count() if n is None else n
    rows = df.select(vec_id, doubles(x).alias("_x")).orderBy(F.xxhash64(vec_id), vec_id).limit(SAMPLE).select("_x").collect()
    m = np.array([list(r[0]) for r in rows])
    d = pairwise(m, m)[np.triu_indices(len(m), 1)] if len(m) > 1 else np.array([tau])
    best = None
    for factor in WIDTHS:
        width = factor * max(tau, 1e-9)
        at, others = together(np.array([tau]), width)[0], together(d, width)
        for k in range(1, 33):
            tables = max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(at ** k, 1 - 1e-12))))
            if tables > MOST_TABLES:
                break
            cost = tables * (n * (k + SHIPPED) + 0.05 * n * n / 2 * float((others ** k).mean()))
            if best is None or cost < best[0]:
                best = cost, Scheme(tables, k, width)
    return best[1]


def hashed(df: DataFrame, x: str, scheme: Scheme) -> DataFrame:
    """df with ``_table`` and ``_key``: one row per vector and table."""
    schema = T.StructType([*df.schema.fields, T.StructField("_keys", T.ArrayType(T.LongType()))])

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                keys = scheme.keys(matrix(part.column(x)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(np.arange(0, keys.size + 1, scheme.tables, dtype=np.int32), keys.reshape(-1))], names=schema.names)

    return df.mapInArrow(run, schema).select(*df.columns, F.posexplode("_keys").alias("_table", "_key"))


def _near(p: Block, q: Block, same: bool, tau: float):
    """Per tile: (i, j, direct distances) of the pairs within tau; a pair of one block once."""
    for s, sq in tiles(p, q, same):
        i, j = hits(sq <= tau * tau + slack(p, q))
        i += s
        if same:
            i, j = i[i < j], j[i < j]
        d = directly(p, q, i, j)
        yield i[d <= tau], j[d <= tau], d[d <= tau]


def _share(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows i of a and j of b have a key in common, table by table."""
    out, left = np.zeros(len(i), bool), np.arange(len(i))
    for t in range(a.shape[1]):
        same = a[i[left], t] == b[j[left], t]
        out[left[same]] = True
        left = left[~same]
    return out


def similar_pairs_by_hashing(df: DataFrame, vec_id: str, x: str, tau: float, recall: float = RECALL, scheme: Scheme | None = None,
                             block_rows: int | None = None) -> DataFrame:
    """Pairs (a, b, d) of distinct vectors with a < b and d <= tau; a pair at tau is found with probability ``recall``."""
    n = df.count()
    scheme = scheme or choose(df, vec_id, x, tau, recall, n)
    rows = hashed(df.select(vec_id, x), x, scheme).withColumn("_home", F.lit(True))
    alone = rows.groupBy("_table", "_key").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")  # others have nobody to meet
    rows = rows.join(alone, ["_table", "_key"], "left_semi")
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.float64())])

    def kernel(left, right, same):
        parts = [arrow.empty_table()]
        if left.num_rows and right.num_rows:
            p = Block.of(matrix(left.column(x)))
            q = p if same else Block.of(matrix(right.column(x)))
            ia, ib, before = ints(left.column(vec_id)), ints(right.column(vec_id)), left.column("_table")[0].as_py()
            ka = scheme.keys(p.m, before)
            kb = ka if same else scheme.keys(q.m, before)
            for i, j, d in _near(p, q, same, tau):
                new = ~_share(ka, kb, i, j)  # others are returned by an earlier table
                i, j, d = i[new], j[new], d[new]
                parts.append(pa.table([pa.array(np.minimum(ia[i], ib[j])), pa.array(np.maximum(ia[i], ib[j])), pa.array(d)], schema=arrow))
        return pa.concat_tables(parts)

    tasked = pair_tasks(rows, ["_table", "_key"], vec_id, block_rows or max(BLOCK_ROWS, block_size(n)))
    return on_pairs(tasked, ["_table", "_key"], kernel, "a long, b long, d double", 4 * tasks(df.sparkSession))


def digest(a, b, mod=lambda v, m: v % m):
    """A number below 2**30 per pair of ids, the same in arrays and in columns (with ``mod=pmod``)."""
    t = mod(mod(a, 1_000_003) * 7_919 + mod(b, 1_000_033) * 104_729, 1_000_000_007)
    return mod(t * t, 998_244_353)


def against_exact(df: DataFrame, vec_id: str, x: str, schemes: dict[float, Scheme], **kw) -> DataFrame:
    """(tau, pairs, shared, digest): all pairs within each tau, those of them that its scheme brings together, and the sum of the latters' digests.

    All thresholds are counted in one exact pass over blocks.
    """
    def kernel(left, right, same):
        keys = {t: [s.keys(one.m) for one in (left, right)] for t, s in schemes.items()}
        total = {t: np.zeros(3, np.int64) for t in schemes}
        for i, j, d in _near(left, right, same, max(schemes)):
            for t in schemes:
                p, q = i[d <= t], j[d <= t]
                both = _share(*keys[t], p, q)
                a, b = left.ids[p[both]], right.ids[q[both]]
                total[t] += (len(p), len(a), int(digest(np.minimum(a, b), np.maximum(a, b)).sum()))
        yield np.array(list(total)), *np.array(list(total.values())).T

    return Index(df.select(vec_id, x), vec_id, x, **kw).summed(max(schemes), kernel, "tau double, pairs long, shared long, digest long").groupBy("tau").agg(
        *[F.sum(c).alias(c) for c in ("pairs", "shared", "digest")])
