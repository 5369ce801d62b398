"""Cutting lineage, size checks and broadcasts.

The rules used everywhere in the package:

* Intermediate tables that are read more than once, or that would grow the lineage of a loop, are checkpointed to the
  shared folder named by ``spark.checkpoint.dir``; executors may come and go without losing them.
* A side of a join is broadcast only after its rows have been counted; past the bound the join is left to the planner,
  which shuffles and splits skewed partitions at run time.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a private one only where none is configured and everything runs on this machine."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if configured is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = configured or tempfile.mkdtemp(prefix="latentlake-")
        sc.setCheckpointDir(current)
    return configured or current


_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    _scratch.append(f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables that this process has written so far; call it when no result that reads them is
    needed any more. Returns how many there were. Checkpoints are Spark's to clean."""
    gone = 0
    while _scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def materialize(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES, fixed: bool = False) -> DataFrame:
    """Materialise df (unless it is already ``fixed``), count it, and mark it for broadcast only if it is proven small."""
    fixed = df if fixed else materialize(df)
    return F.broadcast(fixed) if fixed.count() * row_bytes <= limit else fixed


def join_groups(rows: DataFrame, groups: DataFrame, on, row_bytes: int = 64, how: str = "inner",
                limit: int = BROADCAST_BYTES, fixed: bool = False) -> DataFrame:
    """Attach a per-group table to its rows; null keys match null keys, as they do in a grouping.

    Few groups: the rows are not shuffled at all. Many groups: shuffle join, hot groups split by the adaptive planner.
    """
    keys = [on] if isinstance(on, str) else list(on)
    named = groups.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    side = broadcast_if_small(named, row_bytes, limit, fixed)
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(side[f"_key_{k}"]) for k in keys])
    return rows.join(side, same, how).select(
        *keys, *[c for c in rows.columns if c not in keys], *[c for c in groups.columns if c not in keys])


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
