"""Registration and the table bindings shared by queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latentlake.functions.vec import r6
from latentlake.operators.classify import ReferenceSet, reference_set
from latentlake.operators.weights import centroids
from latentlake.plans.runtime import join_groups

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

D = 64  # dimension of the embeddings table


def comparable(df: DataFrame) -> DataFrame:
    """Wide integers, doubles rounded to six places: one representation per value."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            out.append(F.col(f.name).cast("long").alias(f.name))
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(r6(F.col(f.name).cast("double")).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its counterpart on the same tables."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: comparable(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, x)"""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("x"))


def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, q): the mean vector of every label"""
    return centroids(states(spark, sf_dir), "label")


def label_references(spark: SparkSession, sf_dir: str) -> ReferenceSet:
    return reference_set(label_means(spark, sf_dir), "label", "q")


def with_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States with the mean of their own label as target q."""
    return join_groups(states(spark, sf_dir), label_means(spark, sf_dir), "label", row_bytes=8 * 1024)


def long_form(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, i, v): one row per component, i from 1"""
    return df.select(*keys, F.posexplode(F.col(x).cast("array<double>")).alias("_i", "v")).select(
        *keys, (F.col("_i") + 1).alias("i"), "v")


# --- the same bindings in SQL -------------------------------------------------------------------------------------

E = "e AS (SELECT vec_id, label::BIGINT AS label, embedding::DOUBLE[] AS x FROM embeddings)"
MEANS = f"""{E},
means AS (SELECT label, list(v ORDER BY i) AS q FROM (
    SELECT label, i, avg(x[i]) AS v FROM e, unnest(range(1, {D + 1})) t(i) GROUP BY label, i) GROUP BY label)"""
TARGET = f"""{MEANS},
s AS (SELECT e.vec_id, e.label, e.x, means.q, list_distance(e.x, means.q) AS d FROM e JOIN means USING (label))"""
WEIGHTED = f"""{TARGET},
b AS (SELECT label, min(d) AS best FROM s GROUP BY label),
ex AS (SELECT s.*, exp(best - d) AS ew FROM s JOIN b USING (label)),
tot AS (SELECT label, sum(ew) AS t FROM ex GROUP BY label),
wt AS (SELECT ex.*, ew / t AS w FROM ex JOIN tot USING (label))"""


def r(expr: str, name: str) -> str:
    return f"(round({expr}, 6) + 0.0)::DOUBLE AS {name}"


def exploded(source: str, keys: str, x: str, d: int = D) -> str:
    return f"SELECT {keys}, i, {r(f'{x}[i]', 'v')} FROM {source}, unnest(range(1, {d + 1})) t(i)"
