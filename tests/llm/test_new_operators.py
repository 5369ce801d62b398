"""Manifest, prefix trie and top-k search against plain versions: edges, many levels, hot groups, small blocks."""

import random

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from latentlake.llm import manifest, topk, trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- manifest ----------------------------------------------------------------------------------------------------------

def built(docs):
    out = manifest.proofs(docs, manifest.digest(*[F.col(c) for c in FIELDS]), "source", ["doc_id"], {"doc_id": F.col("doc_id")})
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [tuple(p) for p in r.path]) for r in out.collect()), key=repr)


def documents(n, sources, hot):
    rng = random.Random(n)
    return [(i, f"text {i} É" * rng.randrange(3), None if i % 7 == 0 else "en", "hot" if i < hot else f"s{rng.randrange(sources)}", i % 5 or None) for i in range(n)]


@pytest.mark.parametrize("n,sources,hot", [(0, 1, 0), (1, 1, 0), (16, 1, 16), (17, 1, 17), (300, 40, 290), (700, 300, 260)])
def test_proofs_of_trees_of_many_sizes(spark, n, sources, hot):
    rows = documents(n, sources, hot)
    assert built(spark.createDataFrame(rows, DOCS)) == sorted(plain.manifest(rows), key=repr)


def test_blocks_below_blocks(spark, monkeypatch):
    """Blocks of 16 leaves, so that a tree of 5,000 has blocks of blocks of blocks; joins that are not broadcast."""
    monkeypatch.setattr(manifest, "DIGITS", 1)
    monkeypatch.setattr(manifest, "BLOCK", 16)
    monkeypatch.setattr(manifest, "PATH_BYTES", 1 << 40)
    rows = documents(5_500, 30, 5_000)
    assert built(spark.createDataFrame(rows, DOCS).repartition(5)) == sorted(plain.manifest(rows), key=repr)


def test_manifest_edges(spark):
    rows = [(None, None, None, None, None), (None, "a", None, None, None), (1, "", "en", "", 0), (2, "x" * 200_000, "en", "a", 200_000), (3, "A", "en", "a", 1), (3, "A", "en", "a", 1), (4, "b", None, "é", None)]
    docs = spark.createDataFrame(rows, DOCS)
    want = sorted(plain.manifest(rows), key=repr)
    assert built(docs) == want
    assert built(docs.withColumns({c: F.lit("mine") for c in ("tree", "rank", "n", "h", "kids", "block", "path", "root", "leaf", "d0", "o0", "k0")})) == want


def test_a_proof_shows_what_was_changed(spark):
    rows = documents(90, 3, 40)
    out = manifest.proofs(spark.createDataFrame(rows, DOCS), manifest.digest(*[F.col(c) for c in FIELDS]), "source", ["doc_id"])
    other = F.sha2(F.col("leaf"), 256)
    got = out.select((manifest.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("same"), (manifest.fold(other, F.col("path")) == F.col("root")).alias("changed"))
    assert {tuple(r) for r in got.collect()} == {(True, False)}


# --- trie --------------------------------------------------------------------------------------------------------------

def nodes(turns):
    return rows_of(trie.prefix_trie(*trie.shared_starts(trie.steps_of(turns))))


def conversations(n, kinds, most, seed=0, hot=0.0):
    rng, rows = random.Random(seed), []
    for c in range(n):
        turns = 3 if rng.random() < hot else None
        for t in range(turns or rng.randrange(1, most)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "same" if turns else f"said {rng.randrange(kinds)}" * rng.randrange(3)))
    return rows


@pytest.mark.parametrize("n,kinds,most,hot", [(1, 1, 2, 0), (250, 2, 12, 0.4), (60, 1, 40, 0), (400, 50, 4, 0.9)])
def test_nodes_as_by_prefixes(spark, n, kinds, most, hot):
    rows = conversations(n, kinds, most, n, hot)
    assert nodes(spark.createDataFrame(rows, TURNS).repartition(4)) == sorted(plain.trie(plain.rebuilt(rows)), key=repr)


def test_one_long_conversation(spark):
    rows = [(5, t, "user", f"{t % 9}") for t in range(700)] + [(6, t, "user", f"{t % 9}") for t in range(650)] + [(7, 0, "user", "0")]
    assert nodes(spark.createDataFrame(rows, TURNS)) == sorted(plain.trie(plain.rebuilt(rows)), key=repr)


def test_ends_in_several_strings(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 7)
    rows = [(c, 0, "user", "hello") for c in range(0, 300)]
    assert nodes(spark.createDataFrame(rows, TURNS)) == sorted(plain.trie(plain.rebuilt(rows)), key=repr)


def test_trie_edges(spark):
    rows = [(None, 0, "user", "no conversation"), (1, None, None, None), (1, 0, "", ""), (1, 0, "", ""), (1, 0, "user", "é"), (-207, 0, "user", "x"), (-200, 0, "user", "lead"), (-200, 1, "user", "lead 2"),
            (300, 0, None, "x" * 100_000), (333, 0, "user", "own"), (0, 3, "user", "é"), (0, None, "user", "first")]
    turns = spark.createDataFrame(rows, TURNS)
    want = sorted(plain.trie(plain.rebuilt(rows)), key=repr)
    assert nodes(turns) == want
    assert nodes(turns.withColumns({c: F.lit("mine") for c in ("c", "at", "symbol", "chars", "name", "i", "l", "n", "o0")})) == want
    assert nodes(turns.limit(0)) == []


def test_turnless_conversations_are_members_of_the_root(spark):
    lone = next(c for c in range(1, 100) if plain.zlib.crc32(str(c).encode()) % 6 >= 1)
    rows = [(lone, 0, "user", "replaced by nothing")]
    assert nodes(spark.createDataFrame(rows, TURNS)) == [(lone, 0, None, 1, 0, 1, 0, plain.sha(str(lone)))]


# --- top-k -------------------------------------------------------------------------------------------------------------

def best(spark, rows, k=5, **kw):
    df = spark.createDataFrame(rows, "vec_id long, x array<double>")
    return rows_of(topk.top_k(df, "vec_id", "x", F.col("vec_id") % 50 == 0, k, **kw))


def test_top_k_over_many_cells(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(900, 40)) * np.linspace(2, 0.01, 40) * rng.choice([0.2, 1, 3], (900, 1))
    v[100:400] = v[100]  # a hot vector
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)]
    want = sorted(plain.top_k(rows, 5), key=repr)
    assert best(spark, rows) == want
    assert best(spark, rows, chunk=64) == want


@pytest.mark.parametrize("size", [1.0, 1e4, 3e5])
def test_sums_are_exact_in_every_type(spark, size):
    """Products that need 24, 53 and 63 bits."""
    rng = np.random.default_rng(5)
    rows = [(int(i) * 10, x.tolist()) for i, x in enumerate(rng.normal(size=(120, 20)) * size)]
    rows += [(7, rows[3][1]), (3, rows[3][1])]
    assert best(spark, rows) == sorted(plain.top_k(rows, 5), key=repr)


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (50, None), (100, [nan, 1.0]), (150, [inf, 0.0]), (200, [None, 1.0]), (250, []), (300, [-1.0, 2.0, 9.0]), (1, [0.3, 0.3]), (None, [0.3, 0.3]), (2, [0.3, 0.3]), (400, [1e300, 0.0])]
    want = sorted(plain.top_k([r for r in rows if r[0] != 400], 5), key=repr)
    assert best(spark, rows) == want
    df = spark.createDataFrame(rows, "vec_id long, x array<double>").withColumns({c: F.lit("mine") for c in ("id", "v", "asks", "row", "rank", "score", "across", "down")})
    assert rows_of(topk.top_k(df, "vec_id", "x", F.col("vec_id") % 50 == 0)) == want
    assert best(spark, rows[:1]) == []
    assert rows_of(topk.top_k(df.limit(0), "vec_id", "x", F.col("vec_id") % 50 == 0)) == []


def test_bounds_drop_most_pairs():
    """Vectors whose mass lies in few components: after the first block few pairs are left to accumulate."""
    rng = np.random.default_rng(1)
    q, c = (np.round(rng.normal(size=(64, n)) * 200 * np.exp(-np.arange(64) / 6)[:, None]) for n in (100, 1000))
    least = np.sort(q.T @ c, 1)[:, -5]
    i, j, score = topk.survivors(q, c, topk.remaining(q, 16), topk.remaining(c, 16), least, 1.0)
    assert len(i) == 500 and (score >= least[i]).all()
    alive = (q[:16].T @ c[:16] + np.outer(topk.remaining(q, 16)[1], topk.remaining(c, 16)[1]) + 1 >= least[:, None]).mean()
    assert alive < topk.FEW
