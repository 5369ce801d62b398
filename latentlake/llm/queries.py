"""The registered queries of the corpus operators, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentlake.llm import chat, decontam, hostrules, lm, manifest, mixing, neardup, secrets, suffixes, tokens, topk, trie, warc
from latentlake.llm.sql import ORACLES
from latentlake.llm.text import ascii_lower

TOKEN_LIMIT = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.segments(turns.unionByName(more)))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    _, index = warc.archived(pages)
    return warc.digests(warc.read_records(warc.lookup(index, pages)))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash", "component")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    _, ledger = secrets.scan_versions(docs.where(F.crc32(F.col("doc_id").cast("string")) % 2 == 0), id_columns=["doc_id"])  # as if half were there before
    found, _ = secrets.scan_versions(docs, id_columns=["doc_id"], ledger=ledger)
    counts = {f"n_{r.name}": F.coalesce(F.size(F.element_at("found", F.lit(r.name))), F.lit(0)).cast("long") for r in secrets.BASE}
    return found.select("doc_id", *[c.alias(k) for k, c in counts.items()],
                        F.sha2(secrets.listed(F.col("found"), secrets.BASE), 256).alias("base_sha256"),
                        secrets.listed(F.col("found"), secrets.RULES).alias("spans"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.count_tokens(table(spark, sf_dir, "documents"), model_file(), ["doc_id"])
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lm.train(docs.where(~lm.held_out(F.col("doc_id"))))
    return lm.score(docs, model, ["doc_id"]).withColumn("held_out", lm.held_out(F.col("doc_id")))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = suffixes.removed(docs, suffixes.repeats(docs))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judge(table(spark, sf_dir, "documents"), keep_columns=["doc_id"]).drop("host_broken")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    changed = fields | {"text": ascii_lower(F.col("text"))}
    found = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, manifest.digest(*changed.values()))
    out = manifest.proofs(table(spark, sf_dir, "documents"), manifest.digest(*fields.values()), "source", ["doc_id"], {"doc_id": F.col("doc_id"), "found": found})
    out = out.withColumn("folded_root", manifest.fold(F.coalesce("found", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("path")), 256).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(*trie.shared_starts(trie.steps_of(table(spark, sf_dir, "conversations"))))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_chat, op3_warc, op4_decontam, op5_near_duplicates, op6_secrets, op7_tokens, op8_language_model, op9_suffixes, op10_host_rules,
                                   op11_manifest, op12_prefix_trie, op13_top_k)}
