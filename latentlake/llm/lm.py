"""Interpolated modified Kneser-Ney bigram model, counted in Spark, stored as sorted arrays, memory-mapped by workers.

Counting. Tasks hash words and send sorted runs of (key, count) to shards that are ranges of keys, so that a shard's
keys are one sorted array and the shards on end are sorted too. First words: a word's id is its place in the sorted array
of all word hashes. Then bigrams: the key is id(first) * 2**32 + id(second). Shards of bigrams are cut where the words
counted so far say that equally many tokens lie, inside a word where one word alone has more; runs of equal keys add up
before they are sent.

Model. For a bigram v w seen c times: max(c - D(c), 0) / c(v.) + gamma(v) * lower(w), with three discounts from the counts
of counts, gamma(v) what they take away, and lower(w) the discounted share of different words seen before w,
interpolated with one share in V + 1 for any word. A first word has the end of a text before it.

Scoring. Arrays are files in the shared folder; workers map them into memory and search them. A store that can't be
mapped is copied to an unnamed file of the worker first.

A text is its words (A-Z lower-cased) and one end. Nulls and edges: null texts are the end alone; repeated rows count and
are scored one by one; null ids are never held out by the rule on ids; without training tokens all probabilities come
from the uniform share of V + 1 = 1.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentlake.llm.arrays import Maps, array_folder, gathered, mapped, narrowest, save, sent, system_of
from latentlake.llm.text import hashed_words, owners, pieces, text_bytes, written

END = np.uint64(0)        # hash of the end of a text; words whose hash is 0 take 1
SHARD_TOKENS = 3_000_000  # tokens per shard, about
SCALE = 1 << 32


# --- words -------------------------------------------------------------------------------------------------------------

def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and ends, and bounds of the texts."""
    h, bounds = hashed_words(*text_bytes(column))
    h = np.where(h == END, np.uint64(1), h)
    return np.insert(h, bounds[1:], END), bounds + np.arange(len(bounds))


# --- the model ---------------------------------------------------------------------------------------------------------

def _discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of keys counted 1, 2, 3 and 4 times, kept inside what their counts allow."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return [min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3))]


def _take(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.where(counts == 1, d[0], np.where(counts == 2, d[1], np.where(counts >= 3, d[2], 0.0)))


def train(docs: DataFrame, text: str = "text", shard_tokens: int = SHARD_TOKENS) -> str:
    """Folder of the model: arrays and a small description (model.json)."""
    spark = docs.sparkSession
    folder, texts = array_folder(spark, "lm"), docs.select(F.col(text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(1, -(-size // (5 * shard_tokens)))

    # words: shards are equal ranges of hashes
    cuts = np.array([s * 2**64 // n_shards for s in range(n_shards)], np.uint64)
    runs = sent(texts, lambda: lambda c: _tokens(c)[0], cuts)

    def words(table: pa.Table) -> pa.Table:
        keys, counts = gathered(table, np.uint64)
        return pa.table({"shard": table.column("shard")[:1], "keys": [save(folder, "words", keys)], "counts": [save(folder, "counts", counts)],
                         "n": [len(keys)], "total": [int(counts.sum())]})

    done = {r["shard"]: r for r in runs.groupBy("shard").applyInArrow(words, "shard int, keys string, counts string, n long, total long").collect()}
    word_files = [done[s] for s in sorted(done)]
    base = np.concatenate([[0], np.cumsum([r["n"] for r in word_files])]).astype(np.int64) if word_files else np.zeros(1, np.int64)
    n_words, total = int(base[-1]), int(sum(r["total"] for r in word_files))
    if n_words >= SCALE // 2:
        raise ValueError(f"{n_words} distinct words: keys of pairs hold fewer than {SCALE // 2}")
    model = {"n_words": n_words, "total": total, "words": [(r["keys"], r["counts"], r["n"], r["shard"] * 2**64 // n_shards) for r in word_files]}
    before = np.concatenate([[0], np.cumsum([r["total"] for r in word_files])]).astype(np.int64)

    # bigrams: cuts at equal numbers of tokens, found by the tasks that hold the words' counts
    parts = spark.createDataFrame([(i, r["counts"], int(base[i]), int(before[i])) for i, r in enumerate(word_files)] or [],
                                  "i int, counts string, base long, before long") if word_files else None
    cuts2 = [0]
    if parts is not None:
        def cut(batches):
            for b in batches:
                for _, name, first, before in zip(*(c.to_pylist() for c in b.columns)):
                    c = mapped(folder, name, np.int64)
                    ends = before + np.cumsum(c)
                    begin = ends - c
                    out = []
                    inside = np.flatnonzero(ends // shard_tokens > begin // shard_tokens)
                    for w in inside.tolist():
                        many = int(c[w] // shard_tokens) + 1
                        out += [(first + w) * SCALE + n_words * p // many for p in range(many)]
                        if many > 1:
                            out.append((first + w + 1) * SCALE)
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["cut"])

        cuts2 = sorted({0, *(r[0] for r in parts.repartition(len(word_files)).mapInArrow(cut, "cut long").collect())})
    cuts2 = np.array(cuts2, np.int64)

    def pairs():
        of = Words(Maps(folder), model)

        def make(column):
            h, bounds = _tokens(column)
            ids = of.ids(h)
            before = np.roll(ids, 1)
            before[bounds[:-1]] = of.end
            return before * SCALE + ids

        return make

    # a shard of bigrams is kept as files; what it says of its words goes to the ranges of these words
    step = max(1, -(-n_words // max(1, len(word_files))))
    none = pa.schema([("shard", pa.int32()), ("keys", pa.string()), ("counts", pa.string()), ("kind", pa.string()), ("n", pa.int64()), ("of", pa.list_(pa.int64())),
                      ("i", pa.int32()), ("v", pa.binary()), ("w", pa.binary())])

    def by_range(ids: np.ndarray, rows: np.ndarray) -> dict:
        """Columns of rows (ids first) per range of words."""
        part = ids // step
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(ids) else np.zeros(0, np.int64)
        return {int(part[a]): rows[:, a:b].tobytes() for a, b in zip(cuts, np.append(cuts[1:], len(ids)))}

    def bigrams(table: pa.Table) -> pa.Table:
        keys, counts = gathered(table, np.int64)
        first = keys // SCALE
        starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        v = first[starts]
        held = [np.add.reduceat(x.astype(np.int64), starts) for x in (counts, counts == 1, counts == 2, counts >= 3)]
        w, behind = np.unique(keys % SCALE, return_counts=True)
        kind = narrowest(counts)
        file = {"shard": table.column("shard")[0].as_py(), "keys": save(folder, "pairs", keys), "counts": save(folder, "pair-counts", counts.astype(kind)), "kind": kind.str,
                "n": len(keys), "of": [int((counts == k).sum()) for k in (1, 2, 3, 4)]}
        of_v, of_w = by_range(v, np.stack([v, *held])), by_range(w, np.stack([w, behind]))
        return pa.Table.from_pylist([file, *[{"i": i, "v": of_v.get(i), "w": of_w.get(i)} for i in sorted({*of_v, *of_w})]], schema=none)

    pair_files, sums = [], None
    if n_words:
        made = written(sent(texts, pairs, cuts2).groupBy("shard").applyInArrow(
            bigrams, "shard int, keys string, counts string, kind string, n long, of array<bigint>, i int, v binary, w binary"), "pairs")
        pair_files = sorted(made.where("keys IS NOT NULL").select("shard", "keys", "counts", "kind", "n", "of").collect())
        sums = made.where("i IS NOT NULL").select("i", "v", "w")
    model["pairs"] = [(r["keys"], r["counts"], r["kind"], int(cuts2[r["shard"]])) for r in pair_files]
    d = _discounts([sum(r["of"][k] for r in pair_files) for k in range(4)])
    model["d"] = d

    # per word: gamma of the contexts, and the lower order; a group is one range of words
    n_pairs = sum(r["n"] for r in pair_files)

    def finish(table: pa.Table) -> pa.Table:
        i = table.column("i")[0].as_py()
        lo, hi = i * step, min(n_words, (i + 1) * step)
        held, behind = np.zeros((4, hi - lo), np.int64), np.zeros(hi - lo, np.int64)
        for v, w in zip(table.column("v").to_pylist(), table.column("w").to_pylist()):
            if v:
                a = np.frombuffer(v, np.int64).reshape(5, -1)
                held[:, a[0] - lo] += a[1:]
            if w:
                a = np.frombuffer(w, np.int64).reshape(2, -1)
                behind[a[0] - lo] += a[1]
        gamma = (d[0] * held[1] + d[1] * held[2] + d[2] * held[3]) / np.maximum(held[0], 1)
        gamma[held[0] == 0] = 1.0
        return pa.table({"i": pa.array([i], pa.int32()), "context": [save(folder, "context", held[0])], "gamma": [save(folder, "gamma", gamma)], "behind": [save(folder, "behind", behind)],
                         "of": pa.array([[int((behind == k).sum()) for k in (1, 2, 3, 4)]], pa.list_(pa.int64())), "many": [int((behind >= 3).sum())]})

    per = {r["i"]: r for r in sums.groupBy("i").applyInArrow(
        finish, "i int, context string, gamma string, behind string, of array<bigint>, many long").collect()} if sums is not None else {}
    model["per_word"] = [(per[i]["context"], per[i]["gamma"], per[i]["behind"]) for i in sorted(per)]
    model["step"], model["n_pairs"] = step, n_pairs
    of = [sum(r["of"][k] for r in per.values()) for k in range(4)]
    low = _discounts(of)
    model["low"] = low
    taken = low[0] * of[0] + low[1] * of[1] + low[2] * sum(r["many"] for r in per.values())
    model["spread"] = taken / n_pairs if n_pairs else 1.0
    system, place = system_of(folder)
    system.create_dir(place, recursive=True)
    with system.open_output_stream(f"{place}/model.json") as f:
        f.write(json.dumps(model).encode())
    return folder


class Words:
    """Ids of word hashes: shards are ranges of hashes, so they are searched as one sorted array."""

    def __init__(self, maps: Maps, model: dict):
        self.maps, self.shards = maps, model["words"]
        self.base = np.concatenate([[0], np.cumsum([s[2] for s in self.shards])]).astype(np.int64)
        self.first = np.array([s[3] for s in self.shards], np.uint64)
        self.end = int(self.ids(np.array([END]))[0])

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of each hash."""
        some, back = np.unique(h, return_inverse=True)
        ids, counts = np.full(len(some), -1, np.int64), np.zeros(len(some), np.int64)
        cut = np.append(np.searchsorted(some, self.first), len(some))
        for s, (keys, n, _, _) in enumerate(self.shards):
            q = some[cut[s]:cut[s + 1]]
            if len(q):
                keys, n = self.maps.get(keys, np.uint64), self.maps.get(n, np.int64)
                at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
                hit = keys[at] == q
                ids[cut[s]:cut[s + 1]] = np.where(hit, at + self.base[s], -1)
                counts[cut[s]:cut[s + 1]] = np.where(hit, n[at], 0)
        return ids[back], counts[back]

    def ids(self, h: np.ndarray) -> np.ndarray:
        return self.look(h)[0]


class Model:
    def __init__(self, folder: str):
        system, place = system_of(folder)
        with system.open_input_stream(f"{place}/model.json") as f:
            self.m = json.loads(f.read())
        self.maps = Maps(folder)
        self.words = Words(self.maps, self.m) if self.m["n_words"] else None
        self.cuts = np.array([p[3] for p in self.m["pairs"]], np.int64)

    def _of_word(self, ids: np.ndarray, which: int) -> np.ndarray:
        out = np.zeros(len(ids))
        part = ids // self.m["step"]
        for p in np.unique(part[ids >= 0]).tolist():
            here = np.flatnonzero((part == p) & (ids >= 0))
            out[here] = self.maps.get(self.m["per_word"][p][which], (np.int64, np.float64, np.int64)[which])[ids[here] - p * self.m["step"]]
        return out

    def _pair_counts(self, keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys, kind="stable")
        q, out = keys[order], np.zeros(len(keys), np.int64)
        cut = np.append(np.searchsorted(q, self.cuts), len(q))
        for s, (have, n, kind, _) in enumerate(self.m["pairs"]):
            part = q[cut[s]:cut[s + 1]]
            if len(part):
                have, n = self.maps.get(have, np.int64), self.maps.get(n, np.dtype(kind))
                at = np.minimum(np.searchsorted(have, part), len(have) - 1)
                out[order[cut[s]:cut[s + 1]]] = np.where(have[at] == part, n[at], 0)
        return out

    def lower(self, ids: np.ndarray) -> np.ndarray:
        """Probability of words without their context."""
        behind, m = self._of_word(ids, 2), self.m
        uniform = m["spread"] / (m["n_words"] + 1)
        return (np.maximum(behind - _take(behind, m["low"]), 0) / m["n_pairs"] if m["n_pairs"] else 0.0) + uniform

    def score(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score, score."""
        m = self.m
        h, bounds = _tokens(column)
        own, n = owners(bounds), len(bounds) - 1
        ids, counts = self.words.look(h) if self.words else (np.full(len(h), -1), np.zeros(len(h), np.int64))
        before = np.roll(ids, 1)
        before[bounds[:-1]] = self.words.end if self.words else -1
        both = np.flatnonzero((ids >= 0) & (before >= 0))
        c = np.zeros(len(h), np.int64)
        c[both] = self._pair_counts(before[both] * SCALE + ids[both])
        context, gamma = self._of_word(before, 0), np.where(before >= 0, self._of_word(before, 1), 1.0)
        p = np.maximum(c - _take(c, m["d"]), 0) / np.maximum(context, 1) + gamma * self.lower(ids)
        base = np.log10((counts + 1) / (m["total"] + m["n_words"] + 1))
        return (np.diff(bounds), np.bincount(own[counts > 0], minlength=n), np.bincount(own, base, n), np.bincount(own, np.log10(p), n))


def score(docs: DataFrame, folder: str, ids: list[str], text: str = "text") -> DataFrame:
    """(ids, n_tokens, n_known, train_tokens, base_score, score) per row; log10 probabilities of whole texts."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(folder)
        for batch in batches:
            for b in pieces(batch, len(ids)):
                tokens, known, base, full = model.score(b.column(len(ids)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(i) for i in range(len(ids))] + [pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(tokens), model.m["total"]), pa.int64()),
                                                              pa.array(base), pa.array(full)],
                    [*ids, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(*ids, docs[text].alias("_text")).mapInArrow(run, f"{kinds}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == part, F.lit(False))
