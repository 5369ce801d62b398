"""Ordered work per key that does not depend on how large one key is.

A window over a key sorts all of its rows in one task. That is the right plan while every key is of ordinary size, so
the largest key is measured first (one counting pass over the key columns). When some key is larger than the bound, the
rows are cut into range slices over (key, order) instead: every slice is of similar size whatever the key distribution,
and only per-slice totals are combined per key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from latentlake.plans.runtime import join_groups, materialize, tasks

ROWS_PER_TASK = 4_000_000


def largest_group(df: DataFrame, keys: list[str]) -> int:
    row = df.groupBy(*keys).count().agg(F.max("count")).first()
    return int(row[0] or 0)


def _slices(df: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """Range slices over (keys, order), fixed by a checkpoint so that every later pass sees the same slices."""
    n = max(tasks(df.sparkSession), -(-df.count() // limit))
    cut = df.repartitionByRange(n, *keys, *order).withColumn("_slice", F.spark_partition_id())
    return materialize(cut)


def running(df: DataFrame, keys: list[str], order: list[str], aggs: dict[str, tuple[str, str | None]],
            limit: int = ROWS_PER_TASK, largest: int | None = None) -> DataFrame:
    """Running aggregates per key up to and including the current row.

    ``aggs`` maps an output column to (``count`` | ``sum`` | ``min`` | ``max``, input column). ``order`` must be a total
    order within a key. ``largest`` is the size of the largest key where the caller knows it already.
    """
    fn = {"count": lambda col: F.count(F.lit(1)), "sum": F.sum, "min": F.min, "max": F.max}
    merge = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    if (largest_group(df, keys) if largest is None else largest) <= limit:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({out: fn[kind](col).over(w) for out, (kind, col) in aggs.items()})

    cut = _slices(df, keys, order, limit)
    local = Window.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumns({out: fn[kind](col).over(local) for out, (kind, col) in aggs.items()})
    totals = cut.groupBy(*keys, "_slice").agg(
        *[fn[kind](col).alias(f"_t_{out}") for out, (kind, col) in aggs.items()])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_slice", *[merge[kind](f"_t_{out}").over(before).alias(f"_b_{out}")
                                              for out, (kind, _) in aggs.items()])
    both = join_groups(cut, totals, [*keys, "_slice"])
    combine = {"count": lambda a, b: a + F.coalesce(b, F.lit(0)), "sum": lambda a, b: F.coalesce(a + b, a, b),
               "min": F.least, "max": F.greatest}
    return both.withColumns({out: combine[kind](F.col(out), F.col(f"_b_{out}")) for out, (kind, _) in aggs.items()}) \
        .drop("_slice", *[f"_b_{out}" for out in aggs])


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "rn", limit: int = ROWS_PER_TASK,
             largest: int | None = None) -> DataFrame:
    """1-based position of every row within its key."""
    return running(df, keys, order, {name: ("count", None)}, limit, largest)


def kth_smallest(df: DataFrame, column: str, k: int, bits: int = 16) -> int | None:
    """The k-th smallest value of a whole-number column, the largest if there are fewer, None if there is none or k < 1.

    Values are counted by their leading bits, then those of the deciding bucket by the next ones: a few counting passes,
    each with at most 2**bits groups, instead of a sort in one task. Nulls take no part.
    """
    if k < 1:
        return None
    rows = materialize(df.select(F.col(column).cast("long").alias("v")).where(F.col("v").isNotNull()))
    low, high, n = rows.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if n <= k:
        return high
    while low < high:  # the value sought is between low and high
        shift = max(0, (high - low).bit_length() - bits)
        bucket = F.shiftright("v", shift)
        counts = rows.where(F.col("v").between(low, high)).groupBy(bucket.alias("b")).agg(F.count("v").alias("n")).orderBy("b").collect()
        for row in counts:
            if k <= row["n"]:
                low, high = max(low, row["b"] << shift), min(high, ((row["b"] + 1) << shift) - 1)
                break
            k -= row["n"]
    return low


def windows(df: DataFrame, keys: list[str], order: list[str], build: Callable[[DataFrame, list[str], list[str]], DataFrame],
            before: int = 0, after: int = 0, limit: int = ROWS_PER_TASK, largest: int | None = None) -> DataFrame:
    """Apply fixed-reach window expressions (lag, lead, rolling frames) per key.

    ``build(df, partition_columns, order_columns)`` adds the window columns and must look at most ``before`` rows back
    and ``after`` rows ahead. Keys over the bound are cut into chunks of consecutive rows; each chunk also receives the
    rows within reach of its edges, which are dropped again after the window.
    """
    largest = largest_group(df, keys) if largest is None else largest
    if largest <= limit:
        return build(df, keys, order)
    size = max(limit, before, after, 1)
    rows = numbered(df, keys, order, "_rn", limit, largest)
    own = F.floor((F.col("_rn") - 1) / size)
    first = F.floor((F.col("_rn") - 1 - after) / size)
    last = F.floor((F.col("_rn") - 1 + before) / size)
    rows = rows.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence(first, last)))
    return build(rows, [*keys, "_chunk"], ["_rn"]).where(F.col("_own") == F.col("_chunk")).drop("_rn", "_own", "_chunk")


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rn", pushed: int | None = None) -> DataFrame:
    """First n rows per key.

    The planner applies small limits before the shuffle, so a large key sends n rows per task. Larger limits are first
    applied within hashed parts of each key, which does the same.
    """
    if pushed is None:
        pushed = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > pushed:
        part = F.pmod(F.xxhash64(*[f.name for f in df.schema.fields if not isinstance(f.dataType, MapType)]), F.lit(tasks(df.sparkSession)))
        some = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = df.withColumn("_part", part).withColumn(name, F.row_number().over(some)).where(F.col(name) <= n).drop(name, "_part")
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
