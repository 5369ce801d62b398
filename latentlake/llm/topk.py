"""Exact top-k by inner product: branch and bound over columns of vectors.

Components are whole numbers. Queries and candidates are dealt into a grid of chunks; a cell holds one chunk of either, with
components as columns (a row of the array per component, those with most mass over the table first). In a cell, tiles
of candidates with the longest vectors first are scored a block of components at a time. What the remaining components
can add is at most the product of the remaining lengths; a candidate whose score so far and that bound together stay below
the query's k-th best is out. While many are left, whole tiles are multiplied and the columns of candidates that no query
of the tile needs any more are dropped; once few are left, the surviving pairs alone are accumulated and compacted after
every block. Sums of products are exact: numbers are held in the narrowest type in which no partial sum can round.

Each cell gives at most k rows per query, of which the k best are ranked. Ties go to the smaller id (null last).
Nulls and edges: vectors that are null or hold null or non-finite components take no part, nor do those whose squared length is
2**60 or more after scaling, as their scores need not fit a long; vectors of different lengths are compared as if the shorter
one ended in zeros, so an empty vector scores 0; repeated rows are candidates of their own, also for each other; a query's
own row is known by its row, not by its id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latentlake.llm.text import written
from latentlake.plans.runtime import tasks

LARGEST, LEAST = 32_768, 2_048  # rows in a chunk
QUERY_TILE, TILE, DIMS = 256, 1_024, 16
FEW = 0.15  # share of a tile's pairs below which pairs are worked on one by one
SQUARES = 2.0**60


def quantized(vector: Column, scale: float) -> Column:
    """Whole components floor(scale * x); null for a vector that takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    mass = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.floor(v * scale).cast("double") * F.floor(v * scale).cast("double"))
    return F.when(good & (mass < SQUARES), F.transform(x, lambda v: F.floor(v * scale)))


# --- in a cell ---------------------------------------------------------------------------------------------------------

def columns(vectors: pa.ChunkedArray, order: np.ndarray) -> np.ndarray:
    """(components, rows) of lists of any length, components in the given order, zeros where a list has ended."""
    a = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    ends = np.asarray(a.offsets)
    flat, n = np.asarray(a.values)[ends[0]:ends[-1]], np.diff(ends)
    out = np.zeros((len(order), len(n)), np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    out[place[np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], n)], owner] = flat
    return out


def remaining(v: np.ndarray, dims: int) -> np.ndarray:
    """Lengths of the rest of every vector, before each block of components and after the last."""
    squares = v.astype(np.float64) ** 2
    starts = range(0, len(v), dims)
    blocks = np.array([squares[s:s + dims].sum(0) for s in starts]).reshape(len(starts), v.shape[1])
    return np.sqrt(np.concatenate([np.cumsum(blocks[::-1], 0)[::-1], np.zeros((1, v.shape[1]))]))


def narrowest(longest: float):
    """(type, slack): in which sums of products of at most ``longest`` are exact, and what a bound may be off by."""
    if longest < 2**24:
        return np.float32, 1 + 1e-6 * longest
    return (np.float64 if longest < 2**53 else np.int64), 1 + 1e-9 * longest


class Best:
    """The k best candidates of each query of a tile: (query, score, id rank, candidate), sorted."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.query = self.score = self.id = self.at = np.zeros(0, np.int64)

    def add(self, query, score, ident, at) -> None:
        query, score, ident, at = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, ident), (self.at, at)))
        order = np.lexsort((ident, -score, query))
        query = query[order]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        keep = place < self.k
        order = order[keep]
        self.query, self.score, self.id, self.at = query[keep], score[order], ident[order], at[order]
        full = place[keep] == self.k - 1
        self.least[self.query[full]] = self.score[full]


def survivors(q: np.ndarray, c: np.ndarray, rq: np.ndarray, rc: np.ndarray, least: np.ndarray, slack: float, dims: int = DIMS):
    """(query, candidate, score) of all pairs of a tile that may be among the best: components in blocks, bounds after each."""
    queries, cands = np.arange(q.shape[1]), np.flatnonzero(np.outer(rq[0], rc[0]).max(0, initial=0) + slack >= least.min(initial=np.inf))
    sums = np.zeros((len(queries), len(cands)), q.dtype)
    pairs = None
    for b, s in enumerate(range(0, len(q), dims)):
        if pairs is None:
            sums += q[s:s + dims][:, queries].T @ c[s:s + dims][:, cands]
            alive = sums + np.outer(rq[b + 1][queries], rc[b + 1][cands]) + slack >= least[queries, None]
            if alive.mean() < FEW if alive.size else True:
                i, j = np.nonzero(alive)
                pairs, total = (queries[i], cands[j]), sums[i, j]
            else:
                rows, cols = alive.any(1), alive.any(0)
                if not (rows.all() and cols.all()):
                    queries, cands, sums = queries[rows], cands[cols], sums[np.ix_(rows, cols)]
        else:
            i, j = pairs
            total = total + np.einsum("dp,dp->p", q[s:s + dims][:, i], c[s:s + dims][:, j])
            alive = total + rq[b + 1][i] * rc[b + 1][j] + slack >= least[i]
            pairs, total = (i[alive], j[alive]), total[alive]
    if pairs is None:
        i, j = np.nonzero(sums >= least[queries, None])
        pairs, total = (queries[i], cands[j]), sums[i, j]
    exact = total >= least[pairs[0]]
    return pairs[0][exact], pairs[1][exact], total[exact].astype(np.int64)


def cell(queries: pa.Table, cands: pa.Table, k: int, order: np.ndarray) -> pa.Table:
    """The k best candidates of the cell for each of its queries."""
    q, c = columns(queries.column("v"), order), columns(cands.column("v"), order)
    rq, rc = remaining(q, DIMS), remaining(c, DIMS)
    kind, slack = narrowest(float(rq[0].max(initial=0) * rc[0].max(initial=0)))
    q, c = q.astype(kind), c.astype(kind)
    far = np.argsort(-rc[0], kind="stable")
    c, rc = c[:, far], rc[:, far]
    row = np.asarray(cands.column("row"))[far]
    rank = np.asarray(pc.rank(cands.column("id"), null_placement="at_end", tiebreaker="dense")).astype(np.int64)[far]
    own = np.asarray(queries.column("row"))
    out = []
    for a in range(0, q.shape[1], QUERY_TILE):
        qs = slice(a, a + QUERY_TILE)
        best = Best(q[:, qs].shape[1], k)
        for b in range(0, c.shape[1], TILE):
            cs = slice(b, b + TILE)
            i, j, score = survivors(q[:, qs], c[:, cs], rq[:, qs], rc[:, cs], best.least, slack)
            other = own[a + i] != row[b + j]
            i, j, score = i[other], b + j[other], score[other]
            best.add(i, score, rank[j], j)
        out.append(pa.table({"row": own[a + best.query], "cand": pa.array(far[best.at]), "score": best.score}))
    found = pa.concat_tables(out)
    return pa.table({"row": found["row"], "query_id": queries.column("id").take(_places(own, found["row"])), "vec_id": cands.column("id").take(found["cand"]), "score": found["score"]})


def _places(values: np.ndarray, wanted: pa.ChunkedArray) -> pa.Array:
    order = np.argsort(values)
    return pa.array(order[np.searchsorted(values[order], np.asarray(wanted))])


# --- the grid ----------------------------------------------------------------------------------------------------------

def top_k(vectors: DataFrame, ident: str, vector: str, queries: Column, k: int = 5, scale: float = 256.0, chunk: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` holds, the k other rows of largest inner product."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(ident).cast("long").alias("id"), quantized(F.col(vector), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = written(rows.where("v IS NOT NULL").withColumn("row", F.monotonically_increasing_id()), "quantized")
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    mass = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.sum(F.col("x").cast("double") ** 2).alias("m")).orderBy("d").collect()  # one row per component
    order = np.argsort([-r.m for r in mass], kind="stable")
    chunk = chunk or min(LARGEST, max(LEAST, -(-n // (2 * tasks(spark)))))
    across, down = max(1, -(-n // chunk)), max(1, -(-asked // chunk))

    def dealt(df, own: str, parts: int, other: str, copies: int):
        return df.select("row", "id", "v", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other))

    left = dealt(rows.where("asks"), "down", down, "across", across)
    right = dealt(rows, "across", across, "down", down)

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return pa.table({"row": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        return cell(a, b, k, order)

    found = left.groupBy("down", "across").cogroup(right.groupBy("down", "across")).applyInArrow(work, "row long, query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
