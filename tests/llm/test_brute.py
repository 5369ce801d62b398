"""Operators that SQL can't express, against plain versions and round trips."""

import hashlib
import random

import brute
import corpus_pipeline
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latentlake.llm import chat, decontam, lm, mixing, neardup, queries, secrets, suffixes, tokens, warc


@pytest.fixture(scope="module")
def rows(spark, sf):
    return [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()]


# --- near-duplicates ---------------------------------------------------------------------------------------------------

def test_near_duplicates_of_the_table(spark, sf, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5_near_duplicates(spark, sf).collect()}
    assert got == brute.near(rows)


def test_links_that_no_leader_sees(spark, monkeypatch):
    """Chains of texts: neighbours are similar, ends are not; small blocks, so that buckets are cut."""
    rng, rows = random.Random(5), []
    for g in range(12):
        w = [f"{g}.{i}" for i in range(120)]
        for _ in range(14):
            rows.append((len(rows), " ".join(w)))
            for _ in range(3):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
    rng.shuffle(rows)
    rows = list(enumerate(t for _, t in rows))
    monkeypatch.setattr(neardup, "BLOCK", 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near(rows)


def test_posterior_bounds():
    plan = neardup.Plan()
    looks = plan.least_matches()
    assert looks[-1][0] == plan.hashes and all(a[1] < b[1] for a, b in zip(looks, looks[1:]))
    rng = np.random.default_rng(0)
    t, least = looks[-1]
    assert (rng.binomial(t, 0.85, 200_000) >= least).all()  # similar pairs stay
    assert (rng.binomial(t, 0.5, 200_000) < least).mean() > 0.999  # others go


# --- repeated byte strings ---------------------------------------------------------------------------------------------

def _repeated(docs):
    out = suffixes.removed(docs, suffixes.repeats(docs)).withColumn("s", F.sha2("kept", 256))
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.s) for r in out.collect()}


def test_repeats_of_the_table(spark, sf, rows):
    assert _repeated(queries.table(spark, sf, "documents")) == brute.repeated(rows)


def test_repeats_over_many_runs_and_ranges(spark, monkeypatch):
    for name, n in (("RUN_SUFFIXES", 300), ("BLOCK_SUFFIXES", 50), ("RANGE_SUFFIXES", 200)):
        monkeypatch.setattr(suffixes, name, n)
    rng = random.Random(1)
    base, rows = "".join(rng.choice("ab c") for _ in range(3000)), []
    for i in range(120):
        kind, a = rng.random(), rng.randrange(2500)
        noise = "".join(rng.choice("xyz ") for _ in range(rng.randrange(200)))
        rows.append((i, noise + base[a:a + rng.randrange(90, 400)] + noise[::-1] if kind < 0.4 else "a" * rng.randrange(350) if kind < 0.5 else "ab" * rng.randrange(200) if kind < 0.6
                     else None if kind < 0.7 else "é" * rng.randrange(200) + base[:150] + "\0\0" * 70 if kind < 0.8 else "".join(rng.choice("ab") for _ in range(rng.randrange(400)))))
    assert _repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) == brute.repeated(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6), max_size=8), min_size=1, max_size=9))
def test_merge_gives_sorted_order_and_common_prefixes(lists):
    runs = []
    for x in lists:
        x = sorted(x)
        if x:
            z = np.arange(len(x))
            runs.append(suffixes.Suffixes(x, [b""] * len(x), np.array([0, *map(suffixes.common, x, x[1:])]), z, z, z, z, z))
    if not runs:
        return
    out = suffixes.merged([suffixes.Suffixes.unpacked(r.packed()) for r in runs])
    assert out.right == sorted(sum(lists, []))
    assert out.lcp.tolist() == [0, *map(suffixes.common, out.right, out.right[1:])]


# --- language model ----------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("shard", [lm.SHARD_TOKENS, 8_000])
def test_language_model(spark, sf, rows, shard):
    docs = queries.table(spark, sf, "documents")
    folder = lm.train(docs.where(~lm.held_out(F.col("doc_id"))), shard_tokens=shard)
    want, whole = brute.language_model(rows)
    assert whole == pytest.approx(1)
    for r in lm.score(docs, folder, ["doc_id"]).withColumn("held_out", lm.held_out(F.col("doc_id"))).collect():
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert (r.base_score, r.score) == (pytest.approx(w[4]), pytest.approx(w[5]))
    held = [w for w in want.values() if w[0]]
    assert sum(w[5] for w in held) > sum(w[4] for w in held)


# --- tokens ------------------------------------------------------------------------------------------------------------

def test_tokens_as_the_library_counts(spark, rows):
    import sentencepiece

    rng = random.Random(3)
    more = ["", " ", "  a  b", "a" * 3000, "aaaa aa" * 200, "<s> </s><unk> <0x0A>", "ﬁ ½ é\u0301 日本語テスト🎉", "\u2581\u2581a\u2581b", "\x00a\x01", "the" * 900, "tab\tnl\r\n x\u00a0y\u3000z"]
    more += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz \u2581.,0123456789éßあ漢🎉\n", k=rng.randrange(300))) for _ in range(300)]
    texts = [t for _, t in rows] + more
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_file())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.count_tokens(docs, queries.model_file(), ["doc_id"]).collect()}
    assert got == {i: (len((t or "").encode()), len(sp.encode(t or "", num_threads=1))) for i, t in enumerate(texts)}


# --- chat --------------------------------------------------------------------------------------------------------------

@given(st.one_of(st.none(), st.text(max_size=12), st.sampled_from(["user", "assistant", "system"])), st.text(alphabet="\\#</turn>\n Aa:[]", max_size=60))
def test_turns_come_back(role, text):
    t = chat.TEMPLATE
    turn = t.open.replace("{role}", chat.shown_role(role, t)) + chat.escape(text) + t.close
    assert chat.read_turn(turn, t) == (role, text)
    assert "###" not in chat.escape(text) and "</turn>" not in chat.escape(text)


def test_machine():
    t = chat.TEMPLATE
    assert chat.allowed("start", "system", t) and chat.allowed("user", "assistant", t)
    assert not chat.allowed("start", "assistant", t) and not chat.allowed("user", "user", t) and not chat.allowed("assistant", None, t)


# --- archives ----------------------------------------------------------------------------------------------------------

def test_lookup_reads_only_what_it_names(spark):
    rows = [(i, f"http://www.site{i % 7}.example.com/p/{i % 11}", f"<p>{i % 5}</p>" * 40 + "\r\n\r\nWARC/1.1\r\n\r\n") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, _ = warc.archived(pages)
    index = warc.build_index(warc.captures(spark, folder), block_keys=4, part_keys=9)
    urls = spark.createDataFrame([(rows[3][1],), (rows[12][1] + "#x",), ("http://nowhere.example.org/",)], "url string")
    got = warc.read_records(warc.lookup(index, urls)).collect()
    assert sorted(r.page_id for r in got) == sorted(i for i, u, _ in rows if u in (rows[3][1], rows[12][1]))
    assert all(hashlib.sha256(r.payload).hexdigest() == r.digest for r in got if r.payload is not None)


def test_keys():
    assert warc.surt("https://user@WWW.Example.com:443/a?b=1#c") == "com,example,www)/a?b=1"
    assert warc.surt("http://a.com") == "com,a)/" and warc.surt(None) == ")"


# --- decontamination ---------------------------------------------------------------------------------------------------

def test_substituted_words_are_tolerated(spark):
    rng = random.Random(2)
    item = [f"w{i}" for i in range(40)]
    other = [f"v{i}" for i in range(300)]

    def changed(every):
        return [rng.choice(other) if i % every == every - 1 else w for i, w in enumerate(item)]

    texts = [" ".join(other), " ".join(other[:50] + item + other[50:]), " ".join(other[:20] + changed(8) + other[20:]), " ".join(other[:9] + changed(2) + other[9:]),
             " ".join(other[:30] + item[10:24] + other[30:]), " ".join(item).upper(), " ".join(other[:30] + item[10:16] + other[30:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(0, " ".join(item)), (1, "five words in this item")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()} == {(1, 0), (2, 0), (4, 0), (5, 0)}


def test_large_benchmarks_are_shuffled(spark, sf, monkeypatch):
    want = sorted(map(str, queries.op4_decontam(spark, sf).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    assert sorted(map(str, queries.op4_decontam(spark, sf).collect())) == want


# --- secrets -----------------------------------------------------------------------------------------------------------

def test_ledger_scans_only_what_is_new(spark):
    docs = spark.createDataFrame([("a", 1, "token = abcdefgh"), ("a", 2, "nothing"), ("b", 1, "token = abcdefgh")], "path string, v int, text string")
    found, ledger = secrets.scan_versions(docs)
    assert ledger.count() == 2 * len(secrets.RULES)
    assert {(r.path, r.v): [tuple(s) for s in r.found.get("assign", [])] for r in found.collect()} == {("a", 1): [(0, 16)], ("a", 2): [], ("b", 1): [(0, 16)]}
    newer = tuple(secrets.Rule(r.name, 2, r.pattern, r.least, r.group, r.hint) if r.name == "hex" else r for r in secrets.RULES)
    more = docs.union(spark.createDataFrame([("c", 1, "x" * 3 + "0123456789abcdef" * 2)], docs.schema))
    found, grown = secrets.scan_versions(more, rules=newer, ledger=ledger)
    assert grown.count() - ledger.count() == 2 + len(newer)  # the new version of one rule on old blobs, all rules on the new one
    assert [[tuple(s) for s in r.found["hex"]] for r in found.where("path = 'c'").collect()] == [[(3, 35)]]


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é token = abcdefgh end"), (2, None)], "doc_id long, text string")
    found, _ = secrets.scan_versions(docs, id_columns=["doc_id", "text"])
    assert {r.doc_id: r.t for r in found.select("doc_id", secrets.redact(F.col("text"), F.col("found")).alias("t")).collect()} == {1: "é [secret] end", 2: None}


# --- mixing ------------------------------------------------------------------------------------------------------------

def test_targets():
    got = mixing.targets([("a", 100), ("b", 1000), ("c", 10)])
    assert got["a"] == 300 and got["c"] == 30 and sum(got.values()) == pytest.approx(1110)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    p, x = rng.random(500), rng.integers(0, 1000, 500).astype(float)
    out = mixing.flight(p, x, rng.random(500))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum()) and (out * x).sum() == pytest.approx((p * x).sum())


def test_mix_is_near_its_targets_and_repeatable(spark, sf):
    docs = queries.table(spark, sf, "documents")
    first = {r.doc_id: r for r in mixing.mixed(docs, ["doc_id"], block=7).collect()}
    again = {r.doc_id: r for r in mixing.mixed(docs.repartition(5), ["doc_id"], block=7).collect()}
    assert {k: r.taken for k, r in first.items()} == {k: r.taken for k, r in again.items()}
    by = {}
    for r in first.values():
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r["size"]
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r["size"] for r in rows)
    assert sum(rows[0].target for rows in by.values()) == pytest.approx(sum(r["size"] for r in first.values()))


# --- pipeline ----------------------------------------------------------------------------------------------------------

def test_pipeline_against_its_parts(spark, sf, rows):
    docs = queries.table(spark, sf, "documents")
    kept = {r.doc_id for r in queries.op10_host_rules(spark, sf).where("kept").collect()}
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, sf).collect()} == kept
    near = brute.near([r for r in rows if r[0] in kept], 5, 80)
    unique = {i for i, (_, c) in near.items() if i == c}
    one = docs.where(F.col("doc_id").isin(list(kept)))
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, one, sf).collect()} == unique
    leaked = {r.doc_id for r in queries.op4_decontam(spark, sf).collect()}
    clean = corpus_pipeline.decontaminate(spark, docs.where(F.col("doc_id").isin(list(unique))), sf)
    assert {r.doc_id for r in clean.collect()} == unique - leaked
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in out.collect()} <= unique - leaked and out.where("copies < 1").isEmpty()
    again = secrets.scan_versions(out.drop("copies"), id_columns=["doc_id"])[0]
    assert again.where(F.size(F.coalesce(F.element_at("found", F.lit("access")), F.array())) > 0).isEmpty()
