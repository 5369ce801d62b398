"""Mixing sources to target weights with balanced (cube-method) samples.

Every source has a rate: target words over words at hand. A document is taken floor(rate) times for certain and once
more with the remaining probability. Those probabilities are moved by the cube method: as long as some documents are
undecided, three of them (one more than there are constraints) are moved along the null space of the balance equations
for words and documents until one of them is decided, so that both totals of the sample stay what they were in
expectation. Blocks of a source are worked on side by side and hand on at most two undecided documents each; these form
the blocks of the next round, until each source has one block, whose last undecided documents are landed so that the
words taken come as near the target as they can.

Reruns agree: blocks, order and random numbers come from hashes of the rows. Nulls and edges: a null source is a source
of its own, last in order; a null text has size 0 and counts as a document only; repeated rows are separate units;
empty tables give empty results; a source without words has rate 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentlake.llm.text import WORD, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3.0
BLOCK = 2_000


def targets(sizes: list[tuple[object, int]], weights=WEIGHTS, most: float = MOST_COPIES) -> dict[object, float]:
    """Target per source from (source, words) in order of the sources; weights repeat along that order.

    The targets share all words by weight. A target above ``most`` times its source is set to that, and the excess is
    shared among the others by weight, until none is above.
    """
    total = float(sum(n for _, n in sizes))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(sizes)}
    words, full = dict(sizes), {}
    while True:
        open_ = [s for s, _ in sizes if s not in full]
        left, mass = total - sum(full.values()), sum(weight[s] for s in open_)
        share = {s: left * weight[s] / mass for s in open_}
        above = [s for s in open_ if share[s] > most * words[s]]
        if not above:
            return {**full, **share}
        full.update({s: most * words[s] for s in above})


def _draws(h: np.ndarray) -> np.ndarray:
    return ((h.astype(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def flight(p: np.ndarray, x: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Probabilities p moved until at most two stay strictly between 0 and 1; sums of p and of p * x are kept.

    Units are taken in the order given, always three at a time.
    """
    p, n, eps = p.copy(), len(p), 1e-9
    busy, nxt = [], 0
    p[p < eps], p[p > 1 - eps] = 0.0, 1.0
    values, sizes = p.tolist(), x.tolist()
    k = 0
    while True:
        while len(busy) < 3 and nxt < n:
            if 0.0 < values[nxt] < 1.0:
                busy.append(nxt)
            nxt += 1
        if len(busy) < 3:
            return np.array(values)
        i, j, l = busy
        u = (sizes[j] - sizes[l], sizes[l] - sizes[i], sizes[i] - sizes[j])  # orthogonal to (1, 1, 1) and to the sizes
        if u[0] == 0 and u[1] == 0:
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for t, c in zip(u, (i, j, l)):
            v = values[c]
            if t > 0:
                up, down = min(up, (1 - v) / t), min(down, v / t)
            elif t < 0:
                up, down = min(up, v / -t), min(down, (1 - v) / -t)
        step = up if draws[k % n] * (up + down) < down else -down
        k += 1
        for t, c in zip(u, (i, j, l)):
            v = values[c] + step * t
            values[c] = 0.0 if v < eps else 1.0 if v > 1 - eps else v
        busy = [c for c in busy if 0.0 < values[c] < 1.0]


def landing(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The last undecided units become 0 or 1: the choice nearest in words, then in documents."""
    out, open_ = p.copy(), np.flatnonzero((p > 0) & (p < 1))
    words, docs = float((p[open_] * x[open_]).sum()), float(p[open_].sum())
    best = min(range(1 << len(open_)), key=lambda m: (
        abs(sum(x[c] for b, c in enumerate(open_) if m >> b & 1) - words), abs(bin(m).count("1") - docs), m)) if len(open_) else 0
    for b, c in enumerate(open_):
        out[c] = float(best >> b & 1)
    return out


def _fly(last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["unit", "size"], kind="stable").reset_index(drop=True)
        x, h = group["size"].to_numpy(np.float64), group["unit"].to_numpy(np.int64)
        p = flight(group["p"].to_numpy(np.float64), x, _draws(h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        group["p"] = landing(p, x) if last else p
        return group

    return run


def balanced(units: DataFrame, stratum: str, block: int = BLOCK) -> DataFrame:
    """Decides units (stratum, unit: hash that orders them, size, p in [0, 1], other columns): p becomes 0 or 1.

    Sums of p and of p * size per stratum are kept up to the landing.
    """
    schema = units.schema
    done, level = [], 0
    rest = units
    while True:
        counts = {r[0]: r["count"] for r in rest.groupBy(stratum).count().collect()} if level == 0 else counts
        blocks = {s: -(-n // block) for s, n in counts.items()}
        last = all(b <= 1 for b in blocks.values())
        pairs = [F.lit(v) for s, b in blocks.items() if s is not None for v in (s, b)]
        of = F.coalesce(F.element_at(F.create_map(*pairs), F.col(stratum)) if pairs else F.lit(None).cast("int"), F.lit(blocks.get(None, 1)))
        # a stratum's number of blocks is all that tasks need to know about it
        cut = rest.withColumn("_block", F.pmod(F.xxhash64("unit", F.lit(level)), of))
        out = written(cut.groupBy(stratum, "_block").applyInPandas(_fly(last), cut.schema).drop("_block"), "flight")
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(out.where(~undecided) if not last else out)
        if last:
            break
        rest = out.where(undecided)
        counts = {s: min(n, 2 * blocks[s]) for s, n in counts.items()}
        level += 1
    full = done[0]
    for part in done[1:]:
        full = full.unionByName(part)
    return full.select(*schema.names)


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``size``, the number of words of its text."""
    return docs.withColumn("size", F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long"))


def mix_sources(units: DataFrame, source: str = "source", weights=WEIGHTS, most: float = MOST_COPIES, block: int = BLOCK) -> DataFrame:
    """units (source, unit, size, ...) with source_size, target, copies, and taken = copies * size.

    One row per source reaches the driver: their number must be one of sources, not of documents.
    """
    held = units
    per = sorted(((r[0], int(r[1] or 0)) for r in held.groupBy(source).agg(F.sum("size")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    aim = targets(per, weights, most) if per else {}
    spark = units.sparkSession
    table = spark.createDataFrame([(s, n, float(aim[s]), aim[s] / n if n else 0.0) for s, n in per],
                                  "_s string, source_size long, target double, _rate double")
    rows = held.join(F.broadcast(table), F.col(source).eqNullSafe(F.col("_s"))).drop("_s")
    whole = F.floor(F.col("_rate") + 1e-12)
    rows = rows.withColumns({"_whole": whole, "p": F.greatest(F.lit(0.0), F.col("_rate") - whole)}).drop("_rate")
    out = balanced(rows, source, block).withColumn("copies", (F.col("_whole") + F.col("p")).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("_whole", "p")


def mixed(docs: DataFrame, ids: list[str], source: str = "source", text: str = "text", **options) -> DataFrame:
    """(ids, source, size, source_size, target, copies, taken), one row per document."""
    slim = sized(docs.select(*ids, source, text), text)
    # among rows that share all of this, which one is moved makes no difference
    slim = slim.select(*ids, source, "size", F.xxhash64(*[F.col(c).cast("string") for c in ids], text).alias("unit"))
    return mix_sources(written(slim, "sized"), source, **options).drop("unit")
