"""From raw documents to a training mix: quality rules, near-duplicates, decontamination, secret scans, mixing.

Every stage reads what its predecessor kept and writes what it keeps itself. All but the last return the columns of the
documents; the last adds what the mix decided. Stages decide on keys and counts first and go to the texts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latentlake.llm import decontam, hostrules, mixing, neardup, secrets
from latentlake.llm.text import written

NEAR = neardup.Plan(shingle=5, percent=80, bands=40, rows=4, batch=32)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go."""
    judged = hostrules.judge(docs.withColumns({f"__own_{c}": F.col(c) for c in docs.columns}), keep_columns=[f"__own_{c}" for c in docs.columns],
                              measure_again=True)
    return judged.where("kept").select(*[F.col(f"__own_{c}").alias(c) for c in docs.columns])


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the key of a document: its id, null or not, and a hash of its text."""
    return docs.withColumns({"__id": F.coalesce("doc_id", F.lit(0)), "__none": F.col("doc_id").isNull(), "__hash": F.xxhash64("text")})


KEY = ["__id", "__none", "__hash"]


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id. Equal rows (id and text) are one document."""
    found = neardup.near_duplicates(docs, plan=NEAR).withColumns({"__id": F.coalesce("doc_id", F.lit(0)), "__none": F.col("doc_id").isNull()})
    first = F.min(F.struct("__none", "__id", F.col("text_hash").alias("__hash"))).alias("k")
    linked = found.where("component IS NOT NULL").groupBy("component").agg(first).select("k.*")
    alone = found.where("component IS NULL").select("__none", "__id", F.col("text_hash").alias("__hash")).distinct()
    keep = linked.unionByName(alone)
    return _keyed(docs).join(keep, KEY, "left_semi").dropDuplicates(KEY).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = decontam.leaks(docs, bench).select(F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__none"),
                                             F.col("text_hash").alias("__hash")).distinct()
    return _keyed(docs).join(bad, KEY, "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; no document goes."""
    blob = F.sha2(F.coalesce("text", F.lit("")), 256)
    found, _ = secrets.scan_versions(docs.select("text"), id_columns=[])
    bad = found.where(F.size("found") > 0).groupBy("blob").agg(F.first("found").alias("__found")).withColumnRenamed("blob", "__blob")
    both = docs.withColumn("__b", blob).join(bad, F.col("__b") == F.col("__blob"), "left")
    clean = F.when(F.col("__found").isNull(), F.col("text")).otherwise(secrets.redact(F.col("text"), F.col("__found")))
    out = both.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__found").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with ``copies``: how often. Equal rows share their copies out."""
    units = mixing.mixed(_keyed(docs), KEY)
    taken = units.groupBy(*KEY, F.col("source").alias("__source")).agg(F.min("copies").alias("__whole"), F.sum("copies").alias("__all"), F.count(F.lit(1)).alias("__n"))
    rows = _keyed(docs).join(taken.where("__all > 0"), KEY).where(F.col("source").eqNullSafe(F.col("__source")))
    at = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.lit(0)))
    copies = F.col("__whole") + (at <= F.col("__all") - F.col("__whole") * F.col("__n")).cast("long")
    return rows.withColumn("__copies", copies).where("__copies > 0").select(*[c for c in docs.columns if c != "copies"], F.col("__copies").alias("copies"))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontaminate),
          ("secret scans", without_secrets), ("mixing", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
