"""Many shards under a small limit of open files; lookups that read what they name; ledgers that spare known blobs."""

import resource

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from latentlake.llm import arrays, lm, secrets, suffixes, warc


def test_more_arrays_than_open_files(tmp_path):
    folder = f"file://{tmp_path}"
    names = [arrays.save(folder, "a", np.arange(i + 1)) for i in range(400)] + [arrays.save(folder, "none", np.zeros(0, np.int64))]
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (256, hard))
    try:
        for most in (10_000, 50):
            maps = arrays.Maps(folder, most)
            for _ in range(2):
                assert [len(maps.get(n, np.int64)) for n in names] == [*range(1, 401), 0]
            assert len(maps.held) == min(most, 401)
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))


def test_counts_of_any_size():
    for top in (1, 255, 256, 2**31, 2**40):
        c = np.array([1, top])
        assert (c.astype(arrays.narrowest(c)) == c).all()


def test_too_many_words_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(lm, "SCALE", 8)
    with pytest.raises(ValueError, match="distinct words"):
        lm.train(spark.createDataFrame([("a b c d e f g",)], "text string"))


def test_many_small_shards(spark, monkeypatch):
    """A model of dozens of shards whose files are let go again and again."""
    monkeypatch.setattr(arrays, "OPEN", 3)
    monkeypatch.setattr(arrays.Maps.__init__, "__defaults__", (3,))
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 83}" for k in range(60))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = lm.train(docs.where(~lm.held_out(F.col("doc_id"))), shard_tokens=100)
    want, _ = brute.language_model(rows)
    got = {r.doc_id: r for r in lm.score(docs, folder, ["doc_id"]).collect()}
    assert {i: (r.n_tokens, r.n_known, r.train_tokens) for i, r in got.items()} == {i: w[1:4] for i, w in want.items()}
    assert all(got[i].score == pytest.approx(w[5]) and got[i].base_score == pytest.approx(w[4]) for i, w in want.items())


def test_few_splitters(spark, monkeypatch):
    for name, n in (("RUN_SUFFIXES", 200), ("BLOCK_SUFFIXES", 20), ("RANGE_SUFFIXES", 60), ("SAMPLE", 1)):
        monkeypatch.setattr(suffixes, name, n)
    rows = [(i, "".join(chr(97 + (k * k // 7 + i % 3) % 26) for k in range(400 + i))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = suffixes.removed(docs, suffixes.repeats(docs)).withColumn("s", F.sha2("kept", 256))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.s) for r in out.collect()} == brute.repeated(rows)


def test_lookup_reads_the_blocks_it_needs(spark, monkeypatch):
    rows = [(i, f"http://s{i % 30}.example.org/{i}", f"<p>{i}</p>" * 30) for i in range(900)] + [(1000, None, "no url"), (1001, "http://s1.example.org/1", "again")]
    rows.append((1002, "http://long.example.org/", "<long>" * 300_000))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, _ = warc.archived(pages)
    index = warc.build_index(warc.captures(spark, folder), block_keys=10, part_keys=200)
    assert index.count() >= 90 and index.select("part").distinct().count() > 1
    for keys in (warc.SLICE_KEYS, 7):  # slices of a part's keys
        found = warc.digests(warc.read_records(warc.lookup(index, pages, slice_keys=keys)))
        assert sorted(r.page_id for r in found.collect()) == sorted(r[0] for r in rows)
        assert {r.payload_bytes for r in found.where("page_id = 1002").collect()} == {1_800_000}
    absent = spark.createDataFrame([(f"http://s1.example.org/absent{i}",) for i in range(3000)] + [("http://s1.example.org/1",), (None,)], "url string")
    got = warc.lookup(index, absent, slice_keys=100)
    assert sorted(r.page_id for r in got.collect()) == [1, 1000, 1001]


def test_known_pairs_are_not_scanned_again(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i % 20} token = secret{i % 20:04d}") for i in range(60)] + [(None, None)], "doc_id long, text string")
    _, first = secrets.scan_versions(docs.where("doc_id < 10"), id_columns=["doc_id"])
    assert first.count() == 10 * len(secrets.RULES)
    whole, _ = secrets.scan_versions(docs, id_columns=["doc_id"])
    found, ledger = secrets.scan_versions(docs, id_columns=["doc_id"], ledger=first)
    assert ledger.count() - first.count() == 11 * len(secrets.RULES)  # ten texts and the empty one
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))
    monkeypatch.setattr(secrets, "spans", lambda text, rule: (_ for _ in ()).throw(AssertionError(rule.name)))
    with pytest.raises(AssertionError):
        secrets.scan_versions(docs)


@pytest.mark.parametrize("name", ["blob", "found"])
def test_clashing_id_columns_are_an_error(spark, name):
    with pytest.raises(ValueError, match=name):
        secrets.scan_versions(spark.createDataFrame([(1, "x")], f"{name} long, text string"))
