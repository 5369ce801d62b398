"""Write-once decisions per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decide(groups: DataFrame, entropy_threshold: float = 0.5, width: int = 10, drift_threshold: float = 0.01,
           forced: bool = True) -> DataFrame:
    """Why each group (entropy, n_recent, mean_recent) commits: low entropy first, then stable drift, else forced or not."""
    reason = (F.when(F.col("entropy") < entropy_threshold, "entropy_low")
              .when((F.col("n_recent") >= width) & (F.col("mean_recent") < drift_threshold), "drift_stable")
              .otherwise("forced_best" if forced else "none"))
    return groups.withColumn("reason", reason)


def commit_once(existing: DataFrame, proposals: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Committed rows plus, for keys not yet committed, the first proposal. A committed key never changes."""
    cols = [c for c in proposals.columns if c != key]
    first = proposals.groupBy(key).agg(F.min(F.struct(*order, *[c for c in cols if c not in order])).alias("_f"))
    fresh = first.select(key, *[F.col(f"_f.{c}").alias(c) for c in cols]).join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))
