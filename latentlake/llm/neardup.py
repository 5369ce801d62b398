"""Near-duplicate documents: MinHash bands, sequential Bayesian tests, exact verification.

1. Every text becomes its set of word shingles. Texts with equal sets form a class; from here on only classes are compared.
2. Classes whose signatures agree in a band are candidates. Signatures are compared batch by batch: as soon as the
   posterior probability (uniform prior) that the similarity reaches the threshold falls below the chosen miss
   probability, the pair is dropped. What survives is verified on the full sets.
3. Pairs of a bucket are never emitted. First every class is tested against one leader, the smallest class it shares a
   bucket with. Then only pairs across the components found so far are compared, in blocks of bounded size that emit
   links alone. A pair inside a component can't change the result.

With 24 bands of 5 rows a pair at similarity 0.85 misses all bands with probability 7e-7 (at 0.8: 8e-5, for which 40
bands of 4 rows are used: 6e-10).

Nulls and edges: texts without words have an empty set, are linked with nothing and are kept; fewer words than a shingle
has count as one shingle; the smallest id ignores nulls, so a row without id is its own component unless it is linked
to one with an id; repeated rows are one class; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentlake.llm.arrays import Store, array_folder, store
from latentlake.llm.links import components
from latentlake.llm.text import hashed_words, mix, pieces, text_bytes, written

BLOCK = 512


@dataclass(frozen=True)
class Plan:
    shingle: int = 3
    percent: int = 85   # least similarity
    bands: int = 24
    rows: int = 5
    batch: int = 24     # hashes compared between two looks at the posterior
    miss: float = 1e-6  # chance of dropping a pair that is similar enough
    lower: bool = True

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def least_matches(self) -> list[tuple[int, int]]:
        """(hashes compared, matches below which a pair is dropped).

        After t comparisons with m matches the similarity is Beta(m + 1, t - m + 1); it is above s with the probability
        that a binomial variable of t + 1 trials at s is at most m.
        """
        s, out = self.percent / 100, []
        for t in [*range(self.batch, self.hashes, self.batch), self.hashes]:
            tail, m = 0.0, -1
            while tail < self.miss:
                m += 1
                tail += comb(t + 1, m) * s**m * (1 - s) ** (t + 1 - m)
            out.append((t, m))
        return out


def _sets(batch_text: pa.Array, plan: Plan) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    h, bounds = hashed_words(*text_bytes(batch_text), lower=plan.lower)
    k, spread = plan.shingle, (2 * np.arange(plan.shingle, dtype=np.uint64) + np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15)
    windows = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k):
        windows += mix(h[j:j + len(windows)] * spread[j] + np.uint64(j))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            yield np.unique(windows[a:b - k + 1])
        elif b > a:
            yield mix((h[a:b] * spread[:b - a]).sum(keepdims=True) ^ np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def _digest(s: np.ndarray) -> bytes:
    """128 bits of a set."""
    return np.array([mix(s + np.uint64(1)).sum(dtype=np.uint64) + np.uint64(len(s)), (mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * np.uint64(3)).sum(dtype=np.uint64)],
                    np.uint64).tobytes()


def _signature(s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """16 bits per hash function; a chance agreement only adds a candidate."""
    low = np.full(len(seeds), np.uint64(2**64 - 1))
    for at in range(0, len(s), 2048):
        low = np.minimum(low, ((s[at:at + 2048, None] ^ seeds[None, :]) * (seeds[None, :] | np.uint64(1))).min(axis=0))
    return (mix(low) >> np.uint64(48)).astype(np.uint16)


def _seeds(plan: Plan) -> np.ndarray:
    return mix(np.arange(1, plan.hashes + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def sketch(docs: DataFrame, doc_id: str, text: str, plan: Plan) -> DataFrame:
    """(doc_id, text_hash, n_shingles, cls: digest of the set, null if empty, sig)"""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        seeds = _seeds(plan)
        for b in (piece for batch in batches for piece in pieces(batch, 1)):
            n, cls, sig = [], [], []
            for s in _sets(b.column(1), plan):
                n.append(len(s))
                cls.append(_digest(s) if len(s) else None)
                sig.append(_signature(s, seeds).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())],
                                             ["doc_id", "text_hash", "n_shingles", "cls", "sig"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, cls binary, sig binary")


def full_sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame, plan: Plan) -> DataFrame:
    """(cls, data: shingles as bytes) of the classes whose smallest id is in ``wanted`` (min_id)."""
    some = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(
        wanted.select("min_id").distinct(), F.col("doc_id").eqNullSafe(F.col("min_id")), "left_semi").select("text")

    def run(batches):
        for b in batches:
            for piece in pieces(b, 0):
                sets = [s for s in _sets(piece.column(0), plan) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "data"])

    return some.mapInArrow(run, "cls binary, data binary")


def stored_sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame, plan: Plan, folder: str) -> list:
    """The sets of the classes in ``wanted`` (cls, min_id, n_shingles) as mapped files."""
    size = wanted.agg(F.sum("n_shingles")).first()[0] or 0
    return store(full_sets(docs, doc_id, text, wanted, plan), folder, 8 * size)


def _matrix(column: pa.Array, plan: Plan) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(a.to_pylist()), np.uint16).reshape(-1, plan.hashes)


def bucket_rows(classes: DataFrame, plan: Plan) -> DataFrame:
    """(bucket, band, cls): one row per class and band; the band is part of the bucket's hash."""
    def run(batches):
        for b in batches:
            sig = _matrix(b.column(1), plan).astype(np.uint64)
            h = np.zeros((len(sig), plan.bands), np.uint64) + np.arange(plan.bands, dtype=np.uint64)
            for r in range(plan.rows):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::plan.rows])
            band = np.tile(np.arange(plan.bands, dtype=np.int32), len(sig))
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(band), pa.array([c for c in b.column(0).to_pylist() for _ in range(plan.bands)], pa.binary())],
                                             ["bucket", "band", "cls"])

    return classes.select("cls", "sig").mapInArrow(run, "bucket long, band int, cls binary")


def _survive(x: np.ndarray, y: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y that pass all looks at the posterior, and their matches."""
    alive, matches, at = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    for t, least in plan.least_matches():
        matches[alive] += (x[alive, at:t] == y[alive, at:t]).sum(axis=1)
        alive, at = alive[matches[alive] >= least], t
    return alive, matches[alive]


def tested(pairs: DataFrame, classes: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b) of classes that the signatures don't rule out."""
    of = classes.select("cls", "sig", "n_shingles")
    both = pairs.join(of.withColumnsRenamed({"cls": "a", "sig": "sa", "n_shingles": "na"}), "a").join(
        of.withColumnsRenamed({"cls": "b", "sig": "sb", "n_shingles": "nb"}), "b")
    both = both.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * plan.percent).select("a", "b", "sa", "sb")

    def run(batches):
        for b in batches:
            if b.num_rows:
                keep, _ = _survive(_matrix(b.column(2), plan), _matrix(b.column(3), plan), plan)
                yield b.select(["a", "b"]).take(pa.array(keep))

    return both.mapInArrow(run, "a binary, b binary")


def across(buckets: DataFrame, classes: DataFrame, of: DataFrame, signatures: tuple, docs: DataFrame, doc_id: str, text: str, plan: Plan,
           block: int = 0) -> DataFrame:
    """Links (a, b) that join the components of the star round: enough of them to connect whatever is connected.

    Buckets within one component are left out. The others are cut into blocks by hash; a task holds two blocks and
    compares what lies in different components and shares no earlier band (that pair is another task's). A first pass
    over signatures names the classes that have a partner at all. For those the full sets are stored, and a second pass
    verifies on the spot, the most promising pair first; what has been linked meanwhile is not compared any more. Only
    classes and links leave the tasks, no more than these have rows.
    """
    block, folder = block or BLOCK, signatures[0]
    labelled = buckets.join(of.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    labelled = written(labelled, "labelled")

    def cut(labelled: DataFrame) -> DataFrame:
        mixed = labelled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
        mixed = written(mixed.select("bucket", "n", F.ceil(F.col("n") / block).alias("_n")), "mixed")
        rows = mixed.agg(F.sum("n")).first()[0] or 0
        members = labelled.join(mixed.drop("n"), "bucket").withColumn("_mine", F.pmod(F.xxhash64("cls"), F.col("_n")))
        members = members.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        members = members.withColumns({"_i": F.least("_mine", "_other"), "_j": F.greatest("_mine", "_other")})
        # buckets of one block share a task's call, the pieces of others have their own
        return members.withColumn("_group", F.when(F.col("_n") == 1, F.pmod("bucket", F.lit(max(1, rows // 500)))).otherwise(F.xxhash64("bucket", "_i", "_j"))).select(
            "_group", "bucket", "_i", "_j", "_mine", "band", "cls", "component")

    def groups(table: pa.Table):
        """(classes, signatures, components, sides or None, band) of every bucket or pair of blocks."""
        parts = {}
        for at, key in enumerate(zip(*(table.column(c).to_pylist() for c in ("bucket", "_i", "_j")))):
            parts.setdefault(key, []).append(at)
        cls, component, side, bands = (table.column(c).to_pylist() for c in ("cls", "component", "_mine", "band"))
        names = {c: i for i, c in enumerate(dict.fromkeys(component))}
        sigs = Store(*signatures, np.uint16)
        for (_, i, j), at in parts.items():
            mine = [cls[x] for x in at]
            yield mine, np.stack([sigs[c] for c in mine]), np.array([names[component[x]] for x in at]), np.array([side[x] for x in at]) if i != j else None, bands[at[0]]

    def partnered(table: pa.Table) -> pa.Table:
        some = {mine[x] for mine, sig, root, side, band in groups(table) for k, other, _ in _candidates(sig, root, side, band, plan) for x in (k, *other.tolist())}
        return pa.table({"cls": pa.array(list(some), pa.binary())})

    needed = written(cut(labelled).groupBy("_group").applyInArrow(partnered, "cls binary").distinct(), "needed")
    wanted = needed.join(classes, "cls").select("cls", "min_id", "n_shingles")
    sets = folder, stored_sets(docs, doc_id, text, wanted, plan, folder)

    def linked(table: pa.Table) -> pa.Table:
        full, found = Store(*sets, np.uint64), []
        for mine, sig, root, side, band in groups(table):
            for k, o in _linked(sig, root, side, band, [full[c] for c in mine], plan):
                found.append((min(mine[k], mine[o]), max(mine[k], mine[o])))
        return pa.table({"a": pa.array([p[0] for p in found], pa.binary()), "b": pa.array([p[1] for p in found], pa.binary())})

    return cut(labelled.join(needed, "cls", "left_semi")).groupBy("_group").applyInArrow(linked, "a binary, b binary").distinct()


def _candidates(sig: np.ndarray, root: np.ndarray, side: np.ndarray | None, band: int, plan: Plan, n: np.ndarray | None = None):
    """(row, later rows that it may be linked with, their matches): other components, other block, first shared band, test passed."""
    for k in range(len(sig) - 1):
        other = np.arange(k + 1, len(sig))
        other = other[root[other] != root[k]]
        if n is not None:
            other = other[100 * np.minimum(n[other], n[k]) >= plan.percent * np.maximum(n[other], n[k])]
        if side is not None:
            other = other[side[other] != side[k]]
        if not len(other):
            continue
        keep, matches = _survive(np.broadcast_to(sig[k], (len(other), plan.hashes)), sig[other], plan)
        other = other[keep]
        if len(other):
            mine = (sig[other] == sig[k]).reshape(len(other), plan.bands, plan.rows).all(axis=2).argmax(axis=1) == band
            if mine.any():
                yield k, other[mine], matches[mine]


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())


def _linked(sig: np.ndarray, root: np.ndarray, side: np.ndarray | None, band: int, sets: list[np.ndarray], plan: Plan) -> Iterator[tuple[int, int]]:
    """Verified pairs of different components, until these are one or nothing is left to compare; root is used up."""
    n = np.array([len(s) for s in sets])
    for k, other, matches in _candidates(sig, root, side, band, plan, n):
        for o in other[np.argsort(-matches, kind="stable")].tolist():
            if root[o] == root[k]:
                continue
            shared = _shared(sets[k], sets[o])
            if 100 * shared >= plan.percent * (n[k] + n[o] - shared):
                root[root == root[o]] = root[k]
                yield k, o


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, plan: Plan, folder: str) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    pairs = written(pairs, "pairs")
    involved = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    wanted = classes.select("cls", "min_id", "n_shingles").join(involved, "cls")
    sets = folder, stored_sets(docs, doc_id, text, wanted, plan, folder)

    def run(batches):
        full = Store(*sets, np.uint64)
        for b in batches:
            keep = []
            for at, (x, y) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                x, y = full[x], full[y]
                shared = _shared(x, y)
                if 100 * shared >= plan.percent * (len(x) + len(y) - shared):
                    keep.append(at)
            yield b.take(pa.array(keep, pa.int64()))

    return pairs.select("a", "b").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plan: Plan = Plan()) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept, component) for every row.

    Components are those of all verified links; ``component`` names them where ids repeat or are null (null without words).
    """
    rows = written(sketch(docs, doc_id, text, plan), "sketch")
    classes = written(rows.where("cls IS NOT NULL").groupBy("cls").agg(
        F.min("doc_id").alias("min_id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "classes")
    buckets = bucket_rows(classes, plan)
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("leader")).where("n > 1").drop("n")
    full = written(buckets.join(shared, "bucket"), "buckets")
    star = full.where("leader <> cls").groupBy(F.col("cls").alias("b")).agg(F.min("leader").alias("a")).select("a", "b")
    folder = array_folder(docs.sparkSession, "neardup")
    links = written(verified(tested(star, classes, plan), classes, docs, doc_id, text, plan, folder), "links")
    of = components(links)
    signatures = folder, store(full.select("cls").distinct().join(classes, "cls").select("cls", F.col("sig").alias("data")), folder, 2 * plan.hashes * classes.count())
    more = written(across(full.select("bucket", "band", "cls"), classes, of, signatures, docs, doc_id, text, plan), "links")
    if not more.isEmpty():
        of = components(of.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    full = classes.select("cls", "min_id").join(of.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = full.groupBy("component").agg(F.min("min_id").alias("component_id"))
    per_class = full.select("cls", "component").join(least, "component")
    out = rows.drop("sig").join(per_class, "cls", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "component")
