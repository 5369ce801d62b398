"""Repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

Wanted: every byte that lies in a string of ``LENGTH`` bytes that also starts earlier (smaller id, or same document and
smaller start).

Anchors. Of the 24-byte strings inside a window of LENGTH bytes the one with the smallest hash is the window's anchor.
Equal windows have their anchor at the same offset, so only suffixes that start at anchors are sorted, about one in 39
bytes, and of those only suffixes whose anchor string occurs more than once. Nothing is lost by either: a window that
occurs twice has an anchor that occurs twice.

Runs. A task sorts the suffixes of its anchors, settles what repeats inside the run, and writes what is still the first
of its kind as a front-coded run (length of the prefix shared with the predecessor, and the rest), in blocks.

Exchange and merge. Blocks are cut at splitters and sent to the task of their range, which merges the runs with a loser
tree. A player's common prefix with the last winner is known, so two players are compared from there on, and only if
those lengths are equal; the lengths of the merged order come out with it.

Settling. In sorted order with common prefixes, suffixes whose right sides agree for r bytes are neighbours without a
length below r between them. For each offset o of a window before its anchor, windows are equal if their suffixes agree
for LENGTH - o bytes and the o bytes to the left have the same two 64-bit hashes; all but the earliest are removed.

Nulls and edges: null texts have no bytes; ids are integers, null ids come last; rows with equal id are ordered by a
hash of their text; equal rows (id and text) are one document, each with the same result; texts shorter than LENGTH
lose nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentlake.llm.arrays import Maps, array_folder, gathered, save, sent
from latentlake.llm.text import mix, pieces, rolling, text_bytes, written

LENGTH = 100
GRAM = 24
RUN_SUFFIXES = 150_000     # suffixes that a task sorts at a time
BLOCK_SUFFIXES = 2_048
RANGE_SUFFIXES = 100_000   # suffixes merged by a task, about
SHARD_ANCHORS = 500_000
SAMPLE = 6                 # first suffixes of blocks per range, about, that choose the splitters
NULL_ID = np.int64(2**63 - 1)


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(text, place in raw, least and largest offset of windows before it, hash) of every anchor."""
    reach = length - gram + 1
    n = len(raw) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    prefix, down = rolling(raw)
    h = mix((prefix[gram:] - prefix[:-gram]) * down[:len(raw) - gram + 1])
    low = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= reach:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < reach:
        low = np.minimum(low[:len(low) - (reach - size)], low[reach - size:])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    start = np.flatnonzero(np.arange(n) + length <= offsets[text + 1])  # windows inside one text
    place = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = text[start]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])) if len(start) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(start)) - 1
    at = place[new]
    return text[new], at, at - start[last], at - start[new], h[at]


def repeated_anchors(texts: DataFrame, folder: str, length: int, gram: int) -> tuple[list, np.ndarray]:
    """Files with the sorted hashes of anchors that occur more than once, and where their ranges begin."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (30 * SHARD_ANCHORS)))
    cuts = np.array([s * 2**64 // n for s in range(n)], np.uint64)

    def several(table: pa.Table) -> pa.Table:
        keys, counts = gathered(table, np.uint64)
        return pa.table({"shard": table.column("shard")[:1], "name": [save(folder, "anchors", keys[counts > 1])]})

    runs = sent(texts, lambda: lambda c: anchors(*text_bytes(c), length, gram)[4], cuts)
    names = {r["shard"]: r["name"] for r in runs.groupBy("shard").applyInArrow(several, "shard int, name string").collect()}
    return [names.get(s) for s in range(n)], cuts


def _member(h: np.ndarray, names: list, cuts: np.ndarray, maps: Maps) -> np.ndarray:
    order = np.argsort(h)
    q, out = h[order], np.zeros(len(h), bool)
    at = np.append(np.searchsorted(q, cuts), len(q))
    for s, name in enumerate(names):
        part = q[at[s]:at[s + 1]]
        have = maps.get(name, np.uint64) if name and len(part) else np.zeros(0, np.uint64)
        if len(have):
            out[order[at[s]:at[s + 1]]] = have[np.minimum(np.searchsorted(have, part), len(have) - 1)] == part
    return out


# --- sorted suffixes ---------------------------------------------------------------------------------------------------

def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of a and b, known to be at least ``at``."""
    n = min(len(a), len(b))
    while at < n and a[at:at + 8] == b[at:at + 8]:
        at += 8
    if at >= n:
        return n
    for x, y in zip(a[at:at + 8], b[at:at + 8]):
        if x != y:
            break
        at += 1
    return min(at, n)


class Suffixes:
    """Suffixes with what lies to their left; arrays and lists of one length."""

    fields = ("doc", "hash", "pos", "lo", "hi")

    def __init__(self, right: list[bytes], left: list[bytes], lcp, doc, hash, pos, lo, hi):
        self.right, self.left, self.lcp = right, left, lcp
        self.doc, self.hash, self.pos, self.lo, self.hi = doc, hash, pos, lo, hi

    def __len__(self):
        return len(self.right)

    def take(self, at) -> Suffixes:
        """The suffixes at increasing places, with common prefixes of the new neighbours."""
        at = np.asarray(at)
        lcp = np.zeros(len(at), np.int64)
        if len(at) > 1:  # the least length between two neighbours
            lcp[1:] = np.minimum.reduceat(np.append(self.lcp, 0), at + 1)[:-1]
        places = at.tolist()
        return Suffixes([self.right[i] for i in places], [self.left[i] for i in places], lcp, *[getattr(self, f)[at] for f in self.fields])

    def packed(self) -> bytes:
        """Front-coded: shared prefix lengths and the rests on end."""
        lcp = self.lcp.copy()
        lcp[:1] = 0
        rest = [r[k:] for r, k in zip(self.right, lcp.tolist())]
        return zlib.compress(pickle.dumps((lcp.astype(np.uint8), np.array([len(r) for r in rest], np.uint8), b"".join(rest), np.array([len(x) for x in self.left], np.uint8), b"".join(self.left),
                                           *[getattr(self, f).astype(t) for f, t in zip(self.fields, (np.int64, np.int64, np.int64, np.uint8, np.uint8))]), 5), 1)

    @staticmethod
    def unpacked(data: bytes) -> Suffixes:
        lcp, sizes, rest, lefts, left, doc, hash_, pos, lo, hi = pickle.loads(zlib.decompress(data))  # noqa: S301  written by packed()
        right, before, at = [], b"", 0
        for k, n in zip(lcp.tolist(), sizes.tolist()):
            before = before[:k] + rest[at:at + n]
            right.append(before)
            at += n
        ends = np.cumsum(lefts.astype(np.int64)).tolist()
        out = [left[e - n:e] for e, n in zip(ends, lefts.tolist())]
        return Suffixes(right, out, lcp.astype(np.int64), doc, hash_, pos, lo.astype(np.int64), hi.astype(np.int64))


def joined(parts: list[Suffixes]) -> Suffixes:
    """Parts that follow each other in one sorted run."""
    if len(parts) == 1:
        return parts[0]
    lcp = [p.lcp.copy() for p in parts]
    for a, b, k in zip(parts, parts[1:], lcp[1:]):
        k[0] = common(a.right[-1], b.right[0])
    return Suffixes(sum((p.right for p in parts), []), sum((p.left for p in parts), []), np.concatenate(lcp),
                    *[np.concatenate([getattr(p, f) for p in parts]) for f in Suffixes.fields])


def merged(runs: list[Suffixes]) -> Suffixes:
    """One sorted run of several, by a loser tree.

    Every inner node holds the loser of its match and the length of its common prefix with the last string that left the
    tree. A longer common prefix wins unseen; only equal lengths are compared, from that length on.
    """
    if len(runs) == 1:
        return runs[0]
    k = 1 << (len(runs) - 1).bit_length()
    texts = [r.right for r in runs] + [[]] * (k - len(runs))
    prefixes = [r.lcp.tolist() for r in runs] + [[]] * (k - len(runs))
    place = [0] * k
    loser, length = [0] * k, [0] * k  # of inner nodes 1..k-1
    order_run, order_at, lcps = [], [], []

    def match(a: int, la: int, b: int, lb: int):
        """(winner, its length, loser, its length); a run that has ended loses."""
        ta, tb = texts[a], texts[b]
        if place[b] >= len(tb):
            return a, la, b, lb
        if place[a] >= len(ta):
            return b, lb, a, la
        if la > lb:
            return a, la, b, lb
        if lb > la:
            return b, lb, a, la
        x, y = ta[place[a]], tb[place[b]]
        c = common(x, y, la)
        if c == len(x) or (c < len(y) and x[c] < y[c]):
            return a, la, b, c
        return b, lb, a, c

    def build(node: int):
        if node >= k:
            return node - k, 0
        a, la = build(2 * node)
        b, lb = build(2 * node + 1)
        w, lw, loser[node], length[node] = match(a, la, b, lb)
        return w, lw

    winner, lw = build(1)
    for _ in range(sum(len(t) for t in texts)):
        order_run.append(winner)
        order_at.append(place[winner])
        lcps.append(lw)
        place[winner] += 1
        at = place[winner]
        lw = prefixes[winner][at] if at < len(prefixes[winner]) else 0
        node = (winner + k) >> 1
        while node:
            if place[winner] >= len(texts[winner]) or length[node] >= lw:
                winner, lw, loser[node], length[node] = match(winner, lw, loser[node], length[node])
            node >>= 1
    base = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    flat = base[np.array(order_run)] + np.array(order_at)
    columns = [np.concatenate([getattr(r, f) for r in runs])[flat] for f in Suffixes.fields]
    lefts = [r.left for r in runs]
    return Suffixes([texts[r][i] for r, i in zip(order_run, order_at)], [lefts[r][i] for r, i in zip(order_run, order_at)], np.array(lcps, np.int64), *columns)


def settle(s: Suffixes, length: int) -> tuple[np.ndarray, ...]:
    """Per suffix: least and largest offset of its windows that repeat an earlier one, and of those that don't (or -1)."""
    n = len(s)
    order = np.lexsort((s.pos, s.hash, s.doc))
    doc, hash_, pos = s.doc[order], s.hash[order], s.pos[order]
    rank = np.zeros(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], ((doc[1:] != doc[:-1]) | (hash_[1:] != hash_[:-1]) | (pos[1:] != pos[:-1])).astype(np.int64)])) if n else 0
    widest = int(s.hi.max(initial=-1))
    left = np.zeros((n, widest + 1), np.uint8)
    for i, x in enumerate(s.left):
        if x:
            left[i, :len(x)] = np.frombuffer(x, np.uint8)[::-1]
    out = [np.full(n, v, np.int64) for v in (-1, -1, -1, -1)]
    side, check = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for o in range(widest + 1):
        if o:
            side = mix(side * np.uint64(0x9E3779B97F4A7C15) + left[:, o - 1] + np.uint64(1))
            check = check * np.uint64(0xD1B54A32D192ED03) + mix(left[:, o - 1] + side)
        group = np.cumsum(s.lcp < length - o)
        some = order[(s.lo[order] <= o) & (s.hi[order] >= o)]  # earliest first
        key = mix(group[some].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) ^ side[some])
        by = np.argsort(key, kind="stable")
        first = np.concatenate([[True], key[by][1:] != key[by][:-1]]) if len(by) else np.zeros(0, bool)
        leader = some[by][np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))] if len(by) else some
        if ((group[some[by]] != group[leader]) | (side[some[by]] != side[leader]) | (check[some[by]] != check[leader])).any():  # keys met by chance
            by = np.lexsort((check[some], side[some], group[some]))
            x = some[by]
            first = np.concatenate([[True], (group[x][1:] != group[x][:-1]) | (side[x][1:] != side[x][:-1]) | (check[x][1:] != check[x][:-1])])
            leader = x[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
        later = rank[some[by]] > rank[leader]
        for which, (lo, hi) in ((later, (0, 1)), (~later, (2, 3))):
            x = some[by][which]
            out[hi][x] = o
            fresh = x[out[lo][x] < 0]
            out[lo][fresh] = o
    return tuple(out)


def spans(s: Suffixes, least: np.ndarray, largest: np.ndarray, length: int) -> pa.Table:
    """(doc_id, text_hash, start, end): union per document of the windows to remove. All windows of a suffix overlap."""
    x = np.flatnonzero(largest >= 0)
    start, end = s.pos[x] - largest[x], s.pos[x] - least[x] + length
    order = np.lexsort((start, s.hash[x], s.doc[x]))
    doc, hash_, start, end = s.doc[x][order], s.hash[x][order], start[order], end[order]
    if len(x):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (hash_[1:] != hash_[:-1])])
        group = np.cumsum(new)
        far = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)  # furthest end so far in the document
        cut = np.flatnonzero(new | np.concatenate([[True], start[1:] > far[:-1]]))
        doc, hash_, start, end = doc[cut], hash_[cut], start[cut], far[np.append(cut[1:], len(far)) - 1]
    return pa.table({"doc_id": pa.array(doc, pa.int64(), mask=doc == NULL_ID), "text_hash": pa.array(hash_, pa.int64()),
                     "start": pa.array(start, pa.int64()), "end": pa.array(end, pa.int64())})


BLOCK = "run string, seq int, n int, first binary, data binary, doc_id long, text_hash long, start long, end long"
SCHEMA = pa.schema([("run", pa.string()), ("seq", pa.int32()), ("n", pa.int32()), ("first", pa.binary()), ("data", pa.binary()),
                    ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _filled(table: pa.Table) -> pa.RecordBatch:
    have = {f.name: (table.column(f.name).combine_chunks().cast(f.type) if f.name in table.column_names else pa.nulls(table.num_rows, f.type)) for f in SCHEMA}
    return pa.RecordBatch.from_arrays([have[f.name] for f in SCHEMA], schema=SCHEMA)


def _run(held: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    """Blocks of one sorted run, and the spans that repeat inside it."""
    right = sum((h[0] for h in held), [])
    left = sum((h[1] for h in held), [])
    columns = [np.concatenate([h[k] for h in held]) for k in range(2, 7)]
    by = sorted(range(len(right)), key=right.__getitem__)
    order = np.array(by, np.int64)
    right = [right[i] for i in by]
    lcp = np.array([0, *map(common, right, right[1:])], np.int64)
    s = Suffixes(right, [left[i] for i in by], lcp, *[c[order] for c in columns])
    least, largest, lo, hi = settle(s, length)
    found = spans(s, least, largest, length)
    if found.num_rows:
        yield _filled(found)
    s.lo, s.hi = lo, hi  # windows that are the first of their kind in this run
    s = s.take(np.flatnonzero(hi >= 0))
    cut = (length - s.lo).tolist()
    wide = s.hi.tolist()
    s.right = [r[:c] for r, c in zip(s.right, cut)]
    s.left = [x[len(x) - w:] for x, w in zip(s.left, wide)]
    if any(b < a for a, b in zip(s.right, s.right[1:])):  # shorter strings can change places
        by = sorted(range(len(s)), key=s.right.__getitem__)
        order = np.array(by, np.int64)
        s = Suffixes([s.right[i] for i in by], [s.left[i] for i in by], None, *[getattr(s, f)[order] for f in Suffixes.fields])
    s.lcp = np.array([0, *map(common, s.right, s.right[1:])], np.int64)[:len(s)]
    name = uuid.uuid4().hex
    for seq, at in enumerate(range(0, len(s), BLOCK_SUFFIXES)):
        block = s.take(np.arange(at, min(at + BLOCK_SUFFIXES, len(s))))
        yield _filled(pa.table({"run": [name], "seq": [seq], "n": [len(block)], "first": [block.right[0]], "data": [block.packed()]}))


def sorted_runs(docs: DataFrame, names: list, cuts: np.ndarray, folder: str, length: int, gram: int) -> DataFrame:
    """Runs in blocks, and spans settled within runs; docs has doc_id, text_hash, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, held, size = Maps(folder), [], 0
        for b in (piece for batch in batches for piece in pieces(batch, 2)):
            raw, offsets = text_bytes(b.column(2))
            text, at, lo, hi, h = anchors(raw, offsets, length, gram)
            keep = np.flatnonzero(_member(h, names, cuts, maps))
            text, at, lo, hi = text[keep], at[keep], lo[keep], hi[keep]
            data = raw.tobytes()
            doc = b.column(0).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)[text]
            hash_ = b.column(1).to_numpy(zero_copy_only=False)[text]
            ends = (at + length - lo).tolist()
            places = at.tolist()
            held.append(([data[i:e] for i, e in zip(places, ends)], [data[i - w:i] for i, w in zip(places, hi.tolist())], doc, hash_, at - offsets[text], lo, hi))
            size += len(at)
            if size >= RUN_SUFFIXES:
                yield from _run(held, length)
                held, size = [], 0
        if size:
            yield from _run(held, length)

    return docs.mapInArrow(run, BLOCK)


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_hash, start, end): byte spans to remove. Spans of a document may overlap."""
    folder = array_folder(docs.sparkSession, "suffixes")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("text"))
    names, cuts = repeated_anchors(rows.select("text"), folder, length, gram)
    runs = written(sorted_runs(rows, names, cuts, folder, length, gram), "runs")
    blocks = runs.where("data IS NOT NULL")
    total, n_blocks = blocks.agg(F.sum("n"), F.count(F.lit(1))).first()
    inside = runs.where("start IS NOT NULL").select("doc_id", "text_hash", "start", "end")
    if not total:
        return inside
    n = -(-total // RANGE_SUFFIXES)
    every = max(1, n_blocks // (SAMPLE * n))
    sample = sorted(bytes(r[0])[:gram] for r in blocks.where(F.pmod(F.xxhash64("run", "seq"), F.lit(every)) == 0).select("first").collect())
    splitters = sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for run, seq, data in zip(*(c.to_pylist() for c in b.columns)):
                s = Suffixes.unpacked(data)
                heads = [r[:gram] for r in s.right]
                low, high = bisect_right(splitters, heads[0]), bisect_right(splitters, heads[-1])  # ranges of the first and the last
                ends = [bisect_left(heads, x) for x in splitters[low:high]]
                at, out = 0, []
                for target, end in enumerate([*ends, len(s)], low):
                    if end > at:
                        out.append((target, run, seq, data if end - at == len(s) else s.take(np.arange(at, end)).packed()))
                        at = end
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.string(), pa.int32(), pa.binary()))], ["target", "run", "seq", "data"])

    def merge(table: pa.Table) -> pa.Table:
        parts = {}
        for run, seq, data in sorted(zip(*(table.column(c).to_pylist() for c in ("run", "seq", "data")))):
            parts.setdefault(run, []).append(Suffixes.unpacked(data))
        s = merged([joined(p) for p in parts.values()])
        least, largest, _, _ = settle(s, length)
        return spans(s, least, largest, length)

    dealt = blocks.select("run", "seq", "data").mapInArrow(cut, "target int, run string, seq int, data binary")
    across = dealt.groupBy("target").applyInArrow(merge, "doc_id long, text_hash long, start long, end long")
    return inside.unionByName(across)


def removed(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept: bytes) per row of docs."""
    per = found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("spans")).withColumnsRenamed({"doc_id": "_d", "text_hash": "_h"})
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("_t", F.xxhash64("text"))
    both = rows.join(per, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_h")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for batch in batches for piece in pieces(batch, 1)):
            out = []
            for doc, text, cuts in zip(*(c.to_pylist() for c in b.columns)):
                data, kept, at, n = text.encode(), [], 0, 0
                last = -1
                for start, end in sorted((c["start"], c["end"]) for c in cuts or []):
                    if start > last:
                        n += 1
                        kept.append(data[at:start])
                    last = at = max(last, end)
                kept = b"".join([*kept, data[at:]])
                out.append((doc, len(data), len(data) - len(kept), n, kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
