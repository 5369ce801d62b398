"""Diagnosis of ordered value traces per key: rolling triggers, stalls, traps, movement, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latentlake.functions.vec import l2
from latentlake.operators.ordered import ROWS_PER_TASK, largest_group, numbered, top_rows, windows
from latentlake.plans.runtime import materialize


def rolling(df: DataFrame, keys: list[str], order: list[str], value: str, width: int = 10,
            limit: int = ROWS_PER_TASK) -> DataFrame:
    """Add mean and count of the last ``width`` values."""

    def build(rows, part, by):
        w = Window.partitionBy(*part).orderBy(*by).rowsBetween(-(width - 1), 0)
        return rows.withColumns({"mean_recent": F.avg(value).over(w), "n_recent": F.count(value).over(w)})

    return windows(df, keys, order, build, before=width - 1, limit=limit)


def first_stable(df: DataFrame, keys: list[str], order: list[str], value: str, threshold: float = 0.01, width: int = 10,
                 limit: int = ROWS_PER_TASK) -> DataFrame:
    """Per key: the first position whose last ``width`` values average below the threshold (null if none)."""
    out = rolling(df, keys, order, value, width, limit)
    hit = (F.col("n_recent") >= width) & (F.col("mean_recent") < threshold)
    return out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_stable"),
                                  F.min(F.when(hit, F.struct(*order))).alias("first"))


def stall(df: DataFrame, keys: list[str], order: list[str], value: str, width: int = 50,
          limit: int = ROWS_PER_TASK) -> DataFrame:
    """Per key: trace length L and stall step: 0 for short traces, else the first position from which ``width`` values
    bring less than 1e-6 of improvement, else L."""
    largest = largest_group(df, keys)
    rows = numbered(df, keys, order, "_pos", limit, largest)

    def build(part_rows, part, by):
        w = Window.partitionBy(*part).orderBy(*by)
        return part_rows.withColumns({"_ahead": F.lead(value, width - 1).over(w), "_more": F.lead("_pos", width).over(w)})

    flat = (F.col(value) - F.col("_ahead") < 1e-6) & F.col("_more").isNotNull()
    out = windows(rows, keys, ["_pos"], build, after=width, limit=limit, largest=largest)
    return out.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("length"), F.min(F.when(flat, F.col("_pos") - 1)).alias("_first"),
        F.max(F.struct("_pos", value)).getField(value).alias("final")).select(
        *keys, "length", "final", F.when(F.col("length") < width, F.lit(0)).otherwise(
            F.coalesce("_first", "length")).cast("long").alias("stall_step"))


def traps(df: DataFrame, keys: list[str], order: list[str], value: str, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Per key: length, final value, stall step and trap type, judged on the last 50 values."""
    df = materialize(df.select(*keys, *order, value))  # read three times
    tail = top_rows(df, keys, [F.desc(c) for c in order], 50, "_back")
    w = Window.partitionBy(*keys).orderBy(F.desc("_back"))
    tail = tail.withColumn("_delta", F.col(value) - F.lag(value).over(w))
    tail = tail.withColumn("_turn", F.col("_delta") * F.lag("_delta").over(w) < 0)
    shape = tail.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count("_delta").alias("_deltas"), F.count_if("_turn").alias("_turns"),
        (F.max(value) - F.min(value)).alias("spread"))
    out = stall(df, keys, order, value, limit=limit).join(shape, keys)
    # Trap names and the numbers that separate them
    kind = (F.when(F.col("length") < 10, "plateau")
            .when((F.col("_n") > 5) & (F.col("_turns") > F.col("_deltas") * 0.4), "saddle_oscillation")
            .when((F.col("_n") > 2) & (F.col("spread") < 0.01), "local_minimum")
            .when((F.col("stall_step") > 0) & (F.col("stall_step") < F.col("length") * 0.8), "boundary_stall")
            .otherwise("plateau"))
    return out.withColumn("trap_type", kind).drop("_n", "_deltas", "_turns")


def movement(df: DataFrame, keys: list[str], step: str, x: str, start: str) -> DataFrame:
    """Distance moved in each step of a traced path; a key holds at most the step limit of rows."""
    w = Window.partitionBy(*keys).orderBy(step)
    return df.withColumn("_prev", F.coalesce(F.lag(x).over(w), F.col(start).cast("array<double>"))).withColumn(
        "moved", l2(x, "_prev")).drop("_prev")


def movement_along(df: DataFrame, keys: list[str], step: str, drift: str, r0: str) -> DataFrame:
    """Distance moved in each step of a path that leads straight to its target: from the distances left, without positions."""
    before = F.lag(drift).over(Window.partitionBy(*keys).orderBy(step))
    return df.withColumn("moved", F.abs(F.coalesce(before, F.col(r0)) - F.col(drift)))


def history(df: DataFrame, keys: list[str], order: list[str], value: str, last_n: int, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Add the last ``last_n`` values up to each row, oldest first."""

    def build(rows, part, by):
        w = Window.partitionBy(*part).orderBy(*by).rowsBetween(-(last_n - 1), 0)
        return rows.withColumn("history", F.collect_list(value).over(w))

    return windows(df, keys, order, build, before=last_n - 1, limit=limit)


def convergence_report(diagnosed: DataFrame, run: list[str], tol: float) -> DataFrame:
    """Per run over its diagnosed keys: totals, mean drift of the trapped ones, whether any sits on a plateau, status."""
    trapped = F.col("final") >= tol
    out = diagnosed.groupBy(*run).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(~trapped).alias("n_converged"),
        F.coalesce(F.avg(F.when(trapped, F.col("final"))), F.lit(0.0)).alias("mean_drift"),
        F.coalesce(F.bool_or(trapped & (F.col("trap_type") == "plateau")), F.lit(False)).alias("plateau"))
    return out.withColumn("status", F.when(F.col("n_total") == F.col("n_converged"), "ok").otherwise("non_convergent"))


def worst(diagnosed: DataFrame, key: str, tol: float, n: int = 5) -> DataFrame:
    """The n trapped keys with the largest final drift and how many more there are."""
    trapped = diagnosed.where(F.col("final") >= tol)
    more = F.greatest(trapped.agg(F.count(F.lit(1)).alias("c")).scalar() - n, F.lit(0))
    return trapped.orderBy(F.desc("final"), key).limit(n).withColumn("n_more", more)
