"""Benchmark passages in training documents, tolerant of substituted words.

Masks (spaced seeds) choose positions of a stretch of words and leave the others open. Hashes of the chosen words of
every stretch of a document are joined with those of the benchmark items. An item's masks are checked to be complete:
wherever the substitutions lie that its window may have, one mask finds a place that none of them touches. A hit fixes how
the two texts lie against each other; along that alignment the words are compared one by one, and the pair counts if enough
words agree within a window around the overlap. All alignments of a document and an item are checked together, on words that
are split once, so the work is in proportion to the text also where it repeats itself. Only built-in functions are used.

Words are lower-cased (A-Z). Items in which the rule allows no substitution (fewer than five words) are looked up by all of
their words, and one place in a document is enough; items without words are never matched. Nulls and edges: null texts have
no words; null ids are ids like others; repeated rows give one result per (id, item); empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentlake.llm.text import ascii_lower, let, words, written
from latentlake.plans.runtime import broadcast_if_small

SEEDS = (("1111101", "1011000111"), ("11011", "1111"), ("111", "1101"))  # for 13 words; from 6 words on; for 5 words
WINDOW = 13
PERCENT = 80
PATTERNS = 10_000  # choices of substituted places up to which masks are checked
BROADCAST_BYTES = 32 << 20


def complete(masks: tuple[str, ...], width: int, lost: int) -> bool:
    """Whether every choice of ``lost`` places among ``width`` leaves some mask a place where it reads none of them."""
    reads = [{i + j for j, c in enumerate(m) if c == "1"} for m in masks for i in range(width - len(m) + 1)]
    return all(any(r.isdisjoint(gone) for r in reads) for gone in combinations(range(width), lost))


def masks_for(width: int, percent: int) -> tuple[str, ...]:
    """Complete masks for windows of ``width`` words of which ``percent`` agree, of as many words as are known."""
    lost = width - -(-width * percent // 100)
    if lost and comb(width, lost) <= PATTERNS:
        for masks in SEEDS:
            if complete(masks, width, lost):
                return masks
    return ("1" * (width // (lost + 1)),)  # the longest stretch between substitutions has as many


def seeds(w: Column, masks: tuple[str, ...]) -> Column:
    """Hashes of all masks at all places of hashed words: entry i * len(masks) + k is mask k at word i, null where it doesn't fit."""
    def at(i):
        return F.array(*[F.when(i + len(m) <= F.size(w), F.xxhash64(F.lit(int(m, 2)), *[F.get(w, i + j) for j, c in enumerate(m) if c == "1"]))
                         for m in masks])

    least = min(map(len, masks))
    return F.when(F.size(w) >= least, F.flatten(F.transform(F.sequence(F.lit(0), F.size(w) - least), at)))


def placed(rows: DataFrame, masks: tuple[str, ...], *ids: str) -> DataFrame:
    """(ids, at, h) from (ids, w); place and mask are told by the entry's number."""
    hashed = let(F.transform("w", lambda x: F.xxhash64(x)), lambda w: seeds(w, masks))
    return rows.select(*ids, F.posexplode(hashed).alias("_p", "h")).where("h IS NOT NULL") \
        .select(*ids, F.floor(F.col("_p") / len(masks)).cast("int").alias("at"), "h")


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
          window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, item_id, item_words, window_hits, aligned_hits): documents that hold an item or a long part of it.

    window_hits: agreeing words in the best window of ``window`` words (or of the whole item, if shorter) that lies in
    both texts; at least ``percent`` of the window. aligned_hits: agreeing words along the best alignment.
    """
    lowered = words(ascii_lower(F.coalesce(F.col(text), F.lit(""))))
    bench = items.select(F.col(item_id).alias("item_id"), lowered.alias("w")).where(F.size("w") > 0).distinct()
    bench = written(bench, "bench")
    width = F.least(F.lit(window), F.size("w"))
    widths = {r[0]: masks_for(r[0], percent) for r in bench.select(width).distinct().collect()}  # a few
    kinds = sorted(set(widths.values())) or [SEEDS[0]]
    every = tuple(sorted({m for masks in kinds for m in masks}))
    whole = F.when((F.size("w") <= window) & (F.size("w") * 100 - 100 < percent * F.size("w")), F.size("w"))  # words, where all must agree
    terms = bench.select("item_id", "w", whole.alias("whole"))
    keys = reduce(DataFrame.unionByName, [placed(terms.where(width.isin([n for n in widths if widths[n] == masks])), masks, "item_id", "whole") for masks in kinds])
    keys = written(keys.select("item_id", F.col("at").alias("item_at"), "h", "whole"), "seeds")
    size = keys.count() * 64
    here = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), lowered.alias("w"))
    spots = placed(here, every, "doc_id", "text_hash")
    shift = F.col("at") - F.col("item_at")
    hits = spots.join(F.broadcast(keys) if size <= BROADCAST_BYTES else keys, "h").groupBy("doc_id", "text_hash", "item_id").agg(
        F.collect_set(F.when(F.col("whole").isNull(), shift)).alias("shifts"), F.min(F.when(F.col("whole").isNotNull(), shift)).alias("anywhere"))
    hits = written(hits.select("doc_id", "text_hash", "item_id", F.array_compact(F.concat("shifts", F.array("anywhere"))).alias("shifts")), "hits")
    terms = bench.withColumnsRenamed({"w": "iw"})
    small = bench.agg(F.sum(F.size("w"))).first()[0] or 0
    pairs = hits.join(F.broadcast(terms) if small * 16 <= BROADCAST_BYTES else terms, "item_id")
    # only texts with hits are moved, equal rows as one
    named = broadcast_if_small(hits.select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_t")).distinct(), 64)
    texts = docs.select(F.col(doc_id).alias("_d"), F.xxhash64(text).alias("_h"), F.col(text).alias("_text"))
    texts = texts.join(named, F.col("_d").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_t")), "left_semi").dropDuplicates(["_d", "_h"])
    both = texts.join(pairs, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("text_hash")))
    item, width = F.col("iw"), F.least(F.lit(window), F.size("iw"))

    def agreement(w, by):  # 1 where item and document have the same word, over the part of the item that lies in the document
        first, last = F.greatest(F.lit(0), -by), F.least(F.size(item), F.size(w) - by) - 1
        return F.when(last >= first, F.transform(F.sequence(first, last), lambda j: (F.get(item, j) == F.get(w, j + by)).cast("int")))

    def judged(m):  # null where too few words of any window agree
        total = F.aggregate(m, F.lit(0), lambda a, x: a + x)
        best = F.array_max(F.transform(F.sequence(F.lit(1), F.size(m) - width + 1), lambda i: F.aggregate(F.slice(m, i, width), F.lit(0), lambda a, x: a + x)))
        return F.when((F.size(m) >= width) & (total * 100 >= percent * width), let(best, lambda b: F.when(b * 100 >= percent * width, F.struct(b.alias("window_hits"), total.alias("aligned_hits")))))

    own = words(ascii_lower(F.coalesce(F.col("_text"), F.lit(""))))
    found = let(own, lambda w: F.array_compact(F.transform("shifts", lambda by: let(agreement(w, by), judged))))
    found = both.select("doc_id", "text_hash", "item_id", F.size("iw").cast("long").alias("item_words"), found.alias("j")).where(F.size("j") > 0)
    return found.select("doc_id", "text_hash", "item_id", "item_words", *[F.array_max(F.col(f"j.{k}")).cast("long").alias(k) for k in ("window_hits", "aligned_hits")])
