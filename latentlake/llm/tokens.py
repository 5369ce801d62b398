"""Token counts of a byte-pair vocabulary with rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens that no merge can cross. The pre-tokens of a batch that are new to the task are held as
one ragged numpy array; in every round each sequence finds its lowest-ranking pair and all sequences apply theirs at
once, until no pair is left. What survives is counted. Counts of pre-tokens are kept for later batches, so each distinct
pre-token is merged about once per task.

The vocabulary is that of a sentencepiece BPE model with byte fallback; its file is a parameter. Null texts are empty
and have no tokens; repeated rows are counted one by one; texts of any length are counted whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "\u2581"
KEPT = 400_000  # pre-tokens remembered per task; beyond it the memory starts afresh (counts don't depend on it)
NONE = np.int64(1 << 40)
PRETOKEN = re.compile(SPACE + "+[^" + SPACE + "]*|[^" + SPACE + "]+")


class Merges:
    """Pairs of symbols and the ranks of what they merge to."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)
                  if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        scores = {p: sp.get_score(i) for i, p in enumerate(sp.id_to_piece(k) for k in range(n))}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece crosses the start of a word: pre-tokens can't be merged apart")
        pieces.sort(key=lambda p: -scores[p])
        self.normalize = sp.normalize
        self.rank = {p: i for i, p in enumerate(pieces)}
        self.known = set(pieces)
        pairs = {}
        chars = {c for p in pieces for c in p}
        symbols = self.known | chars
        self.ids = {s: i for i, s in enumerate(sorted(symbols))}
        early = np.zeros(len(self.ids) + 1, bool)
        for p in pieces:
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if a in self.ids and b in self.ids:
                    pairs[self.ids[a] << 32 | self.ids[b]] = (self.rank[p], self.ids[p])
                for part in (a, b):  # a longer piece that ranks before one of its parts
                    if part in self.rank and self.rank[p] < self.rank[part]:
                        early[self.ids[part]] = True
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.by_rank = np.zeros(len(pieces), np.int64)
        for p, r in self.rank.items():
            self.by_rank[r] = self.ids[p]
        self.early = early
        self.of_point = np.full(0x110000, -1, np.int64)
        for c in chars:
            self.of_point[ord(c)] = self.ids[c]
        # tokens of a symbol that survives: one, or its bytes if it is no piece
        self.cost = np.array([1 if s in self.known else len(s.encode()) for s in sorted(symbols)], np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def count(self, sequences: list[str]) -> np.ndarray:
        """Tokens of each sequence."""
        n = len(sequences)
        total = np.zeros(n, np.int64)
        if not n:
            return total
        points = np.frombuffer("".join(sequences).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym, owner = self.of_point[points], np.repeat(np.arange(n), [len(s) for s in sequences])
        unknown = np.flatnonzero(sym < 0)
        if len(unknown):
            c = points[unknown]
            total += np.bincount(owner[unknown], 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF), n).astype(np.int64)
        rank = np.full(len(sym), NONE)  # of each symbol with its successor
        rank[:-1] = self.pair_ranks(sym[:-1], sym[1:])
        rank[np.flatnonzero(owner[:-1] != owner[1:])] = NONE
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(rank, starts)
            span = np.diff(np.append(starts, len(sym)))
            going = lowest < NONE
            if not going.all():  # sequences without a pair are counted and leave
                active = np.repeat(going, span)
                self._add(total, sym[~active], owner[~active])
                sym, owner, rank = sym[active], owner[active], rank[active]
                lowest, span = lowest[going], span[going]
                if not len(sym):
                    break
            chosen = np.flatnonzero(rank == np.repeat(lowest, span))
            run = np.concatenate([[True], np.diff(chosen) > 1])  # in a a a the first pair wins, then every other one
            first = np.maximum.accumulate(np.where(run, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - first) % 2 == 0]
            made = self.by_rank[rank[chosen]]
            late = self.early[made]
            if late.any():  # a merge with what was just made may rank lower: such sequences go one by one
                fine = ~late | np.concatenate([[True], owner[chosen][1:] != owner[chosen][:-1]])
                chosen, made = chosen[fine], made[fine]
            sym[chosen] = made
            left = np.ones(len(sym), bool)
            left[chosen + 1] = False
            sym, owner, rank = sym[left], owner[left], rank[left]
            at = chosen - np.arange(len(chosen))
            at = np.concatenate([at, at[at > 0] - 1])
            nxt = np.minimum(at + 1, len(sym) - 1)
            rank[at] = np.where((at + 1 < len(sym)) & (owner[at] == owner[nxt]), self.pair_ranks(sym[at], sym[nxt]), NONE)
        return total

    def _add(self, total, sym, owner):
        known = sym >= 0
        total += np.bincount(owner[known], self.cost[sym[known]], len(total)).astype(np.int64)


def count_tokens(docs: DataFrame, model_file: str, ids: list[str], text: str = "text") -> DataFrame:
    """(ids, n_bytes, n_tokens) per row. ``model_file`` must be readable at the same place on every executor."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, known = Merges(model_file), {}
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("_text")).to_pylist()
            sizes, counts = [], []
            for at in range(0, len(column), 64):  # a few texts at a time: their pre-tokens are held as strings
                cut = [PRETOKEN.findall(merges.normalize(t)) if t else [] for t in column[at:at + 64]]
                sizes += [len(t.encode()) if t else 0 for t in column[at:at + 64]]
                fresh = list(set().union(*cut).difference(known))
                if len(known) + len(fresh) > KEPT:
                    known.clear()
                    fresh = list(set().union(*cut))
                known.update(zip(fresh, merges.count(fresh).tolist()))
                counts += [sum(map(known.get, c, repeat(0))) for c in cut]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in ids] + [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                [*ids, "n_bytes", "n_tokens"])

    return docs.select(*ids, docs[text].alias("_text")).mapInArrow(run, f"{kinds}, n_bytes long, n_tokens long")
