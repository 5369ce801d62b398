"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from latentlake.llm import chat, decontam, hostrules, lm, mixing, neardup, queries, secrets, suffixes, tokens, warc

LONG = "word and other words follow here " * 4000
ROWS = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t ", "en", "a", 4), (4, LONG, "en", "a", len(LONG)), (4, LONG, "en", "a", len(LONG)),
        (None, "one text without id that is long enough to stay in the end", None, None, None), (None, None, None, None, None), (5, "x", "en", "a", 1),
        (6, "token = abcdef99 and password: hunter2hunter2", "en", "b", 10)]
NAMES = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["size", "p", "unit", "kept", "_host", "n_words", "blob", "found", "cls", "component", "at", "w", "h", "copies", "_text", "text_hash", "n_tokens"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, NAMES)


@pytest.fixture(scope="module")
def wide(docs):
    return docs.withColumns({c: F.lit("mine") for c in EXTRA})


def run(name, docs):
    bench = docs.sparkSession.createDataFrame([(None, None), (1, ""), (2, "word and other words follow here word and other"), (3, "too short")], "item_id long, text string")
    return {
        "mixing": lambda: mixing.mixed(docs, ["doc_id"]),
        "decontam": lambda: decontam.leaks(docs, bench),
        "neardup": lambda: neardup.near_duplicates(docs),
        "secrets": lambda: secrets.scan_versions(docs, id_columns=["doc_id"])[0],
        "tokens": lambda: tokens.count_tokens(docs, queries.model_file(), ["doc_id"]),
        "lm": lambda: lm.score(docs, lm.train(docs), ["doc_id"]),
        "suffixes": lambda: suffixes.removed(docs, suffixes.repeats(docs)),
        "hostrules": lambda: hostrules.judge(docs, keep_columns=["doc_id"]),
    }[name]()


PER_ROW = ["mixing", "neardup", "secrets", "tokens", "lm", "suffixes", "hostrules"]


@pytest.mark.parametrize("name", PER_ROW)
def test_a_result_for_every_row(docs, wide, name):
    a, b = (sorted(map(str, run(name, d).collect())) for d in (docs, wide))
    assert len(a) == len(ROWS)
    assert a == b


@pytest.mark.parametrize("name", [*PER_ROW, "decontam"])
def test_empty_table(docs, name):
    assert run(name, docs.limit(0)).collect() == []


def test_leaks(docs, wide):
    for d in (docs, wide):
        assert {(r.doc_id, r.item_id) for r in run("decontam", d).collect()} == {(4, 2)}


def test_values(docs):
    near = {(r.doc_id, r.n_shingles): r for r in run("neardup", docs).collect()}
    assert near[(1, 0)].component_id == 1 and near[(1, 0)].kept and near[(5, 1)].component_id == 5
    assert [r.n_removed for r in run("suffixes", docs).where("doc_id = 4").collect()] == [len(LONG) - 100 - 33 + 100] * 2
    assert [r.n_tokens for r in run("tokens", docs).where("doc_id <= 2").collect()] == [0, 0]
    assert {r.source: r["size"] for r in run("mixing", docs).where("doc_id = 1").collect()} == {"a": 0}


def test_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (None, 0, None, "no role"), (None, None, "tool]: \\", "### User: </turn>"), (2, 0, "assistant", LONG)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit(9), "segment": F.lit("x")})
    out = {r.conv_id: r for r in chat.read_back(chat.segments(turns)).collect()}
    assert {k: (r.n_turns, r.valid) for k, r in out.items()} == {1: (3, False), None: (2, False), 2: (1, False)}
    assert out[2].loss_chars == len(LONG)
    assert chat.read_back(chat.segments(turns.limit(0))).collect() == []


def test_pages(spark, tmp_path):
    page = "h" * 200
    rows = [(3, "http://a.b.com/x", page), (1, "http://a.b.com/x", page), (1, "http://a.b.com/x", page), (2, None, None), (None, "http://q.com/\r\nz", page), (7, "u", "tiny"), (8, "u", "tiny")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("mine"))
    _, index = warc.archived(pages)
    out = sorted(((r.page_id is None, r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.digests(warc.read_records(warc.every_entry(index))).collect()), key=str)
    assert out == sorted([(False, 1, 200, "response", None)] * 2 + [(False, 3, 200, "revisit", 1), (True, 0, 200, "revisit", 1), (False, 2, 0, "response", None),
                         (False, 7, 4, "response", None), (False, 8, 4, "response", None)], key=str)
    _, index = warc.archived(pages.limit(0))
    assert warc.digests(warc.read_records(warc.every_entry(index))).collect() == []


def test_pipeline_stages(spark, sf, docs, wide):
    for d in (docs, wide.drop("copies"), docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, sf)
            assert out.columns == d.columns + (["copies"] if name == "mixing" else []), name
            n = out.count()
            assert n == {"near duplicates": len({(r[0], r[1]) for r in ROWS if r[1] and r[1].strip()} | {(r[0], r[1]) for r in ROWS if not (r[1] and r[1].strip())}),
                         "secret scans": len(ROWS), "decontamination": len(ROWS)}.get(name, n) or d.isEmpty(), name
    assert spark.createDataFrame(ROWS, NAMES).count() == len(ROWS)
