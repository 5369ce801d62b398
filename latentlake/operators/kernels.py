"""Small array kernels used inside tasks. Spark decides which rows meet in a task; these only do the arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa


def matrix(column) -> np.ndarray:
    """An Arrow list column as an (n, d) double matrix, without touching single values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.empty((0, 0))
    flat = column.flatten()
    if column.null_count or len(flat) % n or len(np.unique(np.diff(column.offsets.to_numpy()))) != 1:
        raise ValueError("all vectors must be present and of one dimension")
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1)


def vectors(m: np.ndarray) -> pa.Array:
    """The inverse of matrix: rows as a list<double> column."""
    n, d = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, type=pa.int32()), pa.array(m.reshape(-1)))


def ints(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def pieces(batch: pa.RecordBatch, width: int, cells: int = 4_000_000):
    """Cut a batch so that a (rows x width) matrix stays within about 32 MB."""
    step = max(16, cells // max(width, 1))
    for s in range(0, batch.num_rows, step):
        yield batch.slice(s, step)


def pairwise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All L2 distances between two blocks through one matrix product; near pairs, where that loses digits, directly."""
    na, nb = (a * a).sum(1), (b * b).sum(1)
    sq = np.maximum(na[:, None] + nb[None, :] - 2.0 * (a @ b.T), 0.0)
    if sq.size:
        i, j = np.nonzero(sq < 1e-6 * (na.max() + nb.max()))
        for s in range(0, len(i), 65536):
            r, c = i[s:s + 65536], j[s:s + 65536]
            sq[r, c] = ((a[r] - b[c]) ** 2).sum(1)
    return np.sqrt(sq)


def direct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a to the same rows of b."""
    return np.sqrt(((a - b) ** 2).sum(1))


def _direct(d: np.ndarray, a: np.ndarray, b: np.ndarray, doubtful: np.ndarray) -> np.ndarray:
    """d with the doubtful entries taken from the difference of the vectors."""
    i, j = np.nonzero(doubtful)
    for s in range(0, len(i), 65536):
        r, c = i[s:s + 65536], j[s:s + 65536]
        d[r, c] = np.sqrt(((a[r] - b[c]) ** 2).sum(1))
    return d


def _slack(a: np.ndarray, b: np.ndarray) -> float:
    """What the squared product form may be off, with room to spare."""
    return 1e-12 * ((a * a).sum(1).max(initial=0.0) + (b * b).sum(1).max(initial=0.0))


def exact_at(d: np.ndarray, a: np.ndarray, b: np.ndarray, *limits: float) -> np.ndarray:
    """Distances d of ``pairwise``, so that comparing them with any of the limits is comparing direct distances."""
    sq, slack = d * d, _slack(a, b)
    doubtful = np.zeros(d.shape, bool)
    for limit in limits:
        doubtful |= np.abs(sq - limit * limit) <= slack
    return _direct(d, a, b, doubtful)


def exact_smallest(d: np.ndarray, a: np.ndarray, b: np.ndarray, k: int = 1) -> np.ndarray:
    """Distances d of ``pairwise``, direct wherever a row's k smallest entries or their ties may be."""
    if not d.size:
        return d
    finite = np.where(np.isfinite(d), d, np.inf)
    kth = np.partition(finite, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1:min(k, d.shape[1])]
    return _direct(d, a, b, np.isfinite(d) & (finite * finite <= np.where(np.isfinite(kth), kth, 0.0) ** 2 + 2 * _slack(a, b)))


def smallest(d: np.ndarray, ids: np.ndarray, k: int):
    """The k smallest finite entries of every row, ties by column id: (row, column), rows in order."""
    k = min(k, d.shape[1])
    r, c = np.nonzero((d <= np.partition(d, k - 1, axis=1)[:, k - 1:k]) & np.isfinite(d))
    order = np.lexsort((ids[c], d[r, c], r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, np.arange(len(d)))
    keep = np.arange(len(r)) - first[r] < k
    return r[keep], c[keep]


def spanning_forest(w: np.ndarray):
    """Minimum spanning forest of a dense weight matrix; missing edges are inf. Returns (from, to, weight) arrays."""
    n = len(w)
    left = np.ones(n, dtype=bool)
    best = np.full(n, np.inf)
    via = np.full(n, -1)
    out = []
    for _ in range(n):
        i = int(np.argmin(np.where(left, best, np.inf)))
        if not left[i] or not np.isfinite(best[i]):
            i = int(np.argmax(left))
        elif via[i] >= 0:
            out.append((via[i], i, best[i]))
        left[i] = False
        closer = left & (w[i] < best)
        best[closer] = w[i][closer]
        via[closer] = i
    if not out:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    f, t, d = zip(*out)
    return np.array(f), np.array(t), np.array(d)


def join_sets(a: np.ndarray, b: np.ndarray, order: np.ndarray | None = None):
    """Union-find over an edge list. Returns (nodes, smallest node of its set, mask of edges that joined two sets)."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = flat[: len(a)], flat[len(a):]
    root = np.arange(len(nodes))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    used = np.zeros(len(a), dtype=bool)
    for e in (order if order is not None else range(len(a))):
        x, y = find(ia[e]), find(ib[e])
        if x != y:
            used[e] = True
            root[max(x, y)] = min(x, y)
    return nodes, nodes[[find(x) for x in range(len(nodes))]], used


def forest_edges(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, *ties: np.ndarray) -> np.ndarray:
    """Positions of the edges of a minimum spanning forest of n nodes, ties by further columns: every tree takes its lightest edge out."""
    order = np.lexsort((np.arange(len(w)), *ties[::-1], w))
    part, used = np.arange(n), []
    live = order
    while True:
        u, v = part[a[live]], part[b[live]]
        live, u, v = (c[u != v] for c in (live, u, v))
        if not len(live):
            return np.sort(np.concatenate(used)) if used else np.zeros(0, int)
        best, rank = np.full(n, len(live)), np.arange(len(live))
        np.minimum.at(best, u, rank), np.minimum.at(best, v, rank)
        nodes = np.flatnonzero(best < len(live))
        to = best[nodes]
        used.append(live[np.unique(to)])
        up = np.arange(n)
        up[nodes] = np.where(u[to] == nodes, v[to], u[to])
        both = up[up] == np.arange(n)  # two trees that chose the same edge
        up = np.where(both, np.minimum(up, np.arange(n)), up)
        while (up[up] != up).any():
            up = up[up]
        part = up[part]


def parts_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of every node's part of the graph of these edges."""
    part = np.arange(n)
    while True:
        least = part.copy()
        np.minimum.at(least, part[a], part[b]), np.minimum.at(least, part[b], part[a])
        while (least[least] != least).any():
            least = least[least]
        if (least[part] == part).all():
            return part
        part = least[part]


@dataclass
class Links:
    """Directed edges a -> b by the node they enter (``b`` sorted, ``starts`` and ``many`` per entered node, ``heads``) and by the
    one they leave (node i's from ``first[i]`` on: ``to``, ``length``)."""

    a: np.ndarray
    w: np.ndarray
    starts: np.ndarray
    heads: np.ndarray
    many: np.ndarray
    order: np.ndarray
    first: np.ndarray
    to: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, leaving: tuple[np.ndarray, np.ndarray] | None = None) -> Links:
        """Of edges sorted by b; ``leaving``: their ends and lengths sorted by a, if known."""
        starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
        many = np.diff(np.append(starts, len(b)))
        if leaving is None:
            out = np.argsort(a, kind="stable")
            leaving = b[out], w[out]
        return cls(a, w, starts, b[starts], many, np.argsort(-many, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]), *leaving)


def relaxed(sources: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, heads_at_once: int = 2_048, hub: int = 128) -> np.ndarray:
    """Shortest path lengths (sources x n) over directed edges a -> b, which are sorted by b."""
    return np.ascontiguousarray(relax(sources, Links.of(a, b, w, n), n, heads_at_once, hub).T)


def relax(sources: np.ndarray, links: Links, n: int, heads_at_once: int = 2_048, hub: int = 128, dear: float = 6.0) -> np.ndarray:
    """Shortest path lengths (n x sources).

    A round takes the paths that became shorter in the round before one by one along the edges that leave their ends. Where they are so
    many that it is cheaper (an edge and source there cost ``dear`` times as much), it takes all sources along all edges that enter a
    node from one with a shorter path. Nodes then go by falling number of edges, so that the j-th edges of many nodes are taken in one
    step; a node of more than ``hub`` edges goes alone.
    """
    k = len(sources)
    d = np.full((n, k), np.inf)  # a node's paths side by side
    flat, most = d.reshape(-1), n * k // 8
    starts, heads, many, order = links.starts, links.heads, links.many, links.order
    best, step = np.empty((heads_at_once, k)), np.empty((heads_at_once, k))
    mark, moved = np.zeros(n * k, bool), np.zeros(n, bool)
    hot = np.asarray(sources, np.int64) * k + np.arange(k)  # places of paths that became shorter; None if they are many
    flat[hot], moved[sources] = 0.0, True
    while len(starts) and moved.any():
        due = order[np.logical_or.reduceat(moved[links.a], starts)[order]]
        if hot is not None:
            u = hot // k
            if (links.first[u + 1] - links.first[u]).sum() * dear < many[due].sum() * k:
                hot = _along(hot, flat, mark, k, links)
                moved[:] = False
                moved[hot // k] = True
                hot = hot if len(hot) <= most else None
                continue
        moved[:] = False
        found, n_found = [], 0
        hubs = int(np.searchsorted(-many[due], -hub, side="left"))
        for h in due[:hubs].tolist():
            low, old = np.full(k, np.inf), d[heads[h]]
            for s in range(starts[h], starts[h] + many[h], heads_at_once):
                e = slice(s, min(s + heads_at_once, starts[h] + many[h]))
                np.minimum(low, (d[links.a[e]] + links.w[e, None]).min(0), out=low)
            less = np.flatnonzero(low < old)
            if len(less):
                moved[heads[h]], n_found = True, n_found + len(less)
                found.append(int(heads[h]) * k + less)
                old[less] = low[less]
        for s in range(hubs, len(due), heads_at_once):
            at = due[s:s + heads_at_once]
            own, low = heads[at].astype(np.int64), best[:len(at)]
            np.take(d, own, axis=0, out=low, mode="clip")
            for j, m in enumerate(np.searchsorted(-many[at], -np.arange(many[at[0]]), side="left").tolist()):  # m of them have a j-th edge
                e = starts[at[:m]] + j
                np.take(d, links.a[e], axis=0, out=step[:m], mode="clip")
                step[:m] += links.w[e, None]
                np.minimum(low[:m], step[:m], out=low[:m])
            less = low < d[own]
            some, n_found = less.any(1), n_found + np.count_nonzero(less)
            if n_found <= most:
                i, j = np.nonzero(less)
                found.append(own[i] * k + j)
            d[own[some]] = low[some]
            moved[own[some]] = True
        hot = np.concatenate([np.zeros(0, np.int64), *found]) if n_found <= most else None
    return d


def _along(hot: np.ndarray, flat: np.ndarray, mark: np.ndarray, k: int, links: Links, at_once: int = 1 << 17) -> np.ndarray:
    """Take single paths (places node * k + source in ``flat``) along all edges that leave their ends; places of those that became shorter."""
    u, source = np.divmod(hot, k)
    count = links.first[u + 1] - links.first[u]
    ends = np.cumsum(count)
    cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, at_once), side="right"))
    for low, high in zip(cuts, [*cuts[1:], len(hot)]):  # about at_once edges at a time
        c = count[low:high]
        e = np.repeat(links.first[u[low:high]] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        path = np.repeat(flat[hot[low:high]], c) + links.length[e]
        at = links.to[e].astype(np.int64) * k + np.repeat(source[low:high], c)
        while True:  # of several paths to one place the shortest is the last to be written
            less = np.flatnonzero(path < flat[at])
            if not len(less):
                break
            at, path = at[less], path[less]
            flat[at], mark[at] = path, True
    out = np.flatnonzero(mark)
    mark[out] = False
    return out
