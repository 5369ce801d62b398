"""Write-once triggers on streams and an idempotent sink for them."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from latentlake.plans.runtime import scratch_path
from latentlake.streaming.memory import ROCKSDB


class StableTrigger(StatefulProcessor):
    """Fires once per key, when the last ``width`` values average below the threshold."""

    def __init__(self, key: str, order: list[str], row_id: str, value: str, threshold: float, width: int):
        self.key, self.order, self.row_id, self.value = key, order, row_id, value
        self.threshold, self.width = threshold, width

    def init(self, handle):
        self.state = handle.getValueState("recent", "recent array<double>, fired boolean")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        recent, fired = self.state.get() if self.state.exists() else ([], False)
        recent, hit = list(recent), None
        if not fired:
            batch = pd.concat(list(rows)).sort_values(self.order)
            for rid, v in zip(batch[self.row_id], batch[self.value]):
                recent = [*recent, float(v)][-self.width:]
                if len(recent) == self.width and sum(recent) / self.width < self.threshold:
                    hit, fired, recent = rid, True, []
                    break
            self.state.update((recent, fired))
        if hit is not None:
            yield pd.DataFrame({self.key: [key[0]], self.row_id: [hit], "reason": ["drift_stable"]})

    def handleInitialState(self, key, initialState, timerValues):
        self.state.update(([], True))

    def close(self):
        pass


def stable_stream(stream: DataFrame, key: str, order: list[str], row_id: str, value: str, threshold: float = 0.01,
                  width: int = 10, fired: DataFrame | None = None) -> DataFrame:
    """(key, row_id, reason) of the row at which a key fires, once. ``fired``: keys that have fired in an earlier run."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    types = dict(stream.dtypes)
    return stream.groupBy(key).transformWithStateInPandas(
        StableTrigger(key, order, row_id, value, threshold, width),
        outputStructType=f"{key} {types[key]}, {row_id} {types[row_id]}, reason string", outputMode="Append", timeMode="None",
        initialState=None if fired is None else fired.select(key).distinct().groupBy(key))


def run_available(stream: DataFrame, sink, checkpoint: str | None = None) -> None:
    """Drive a stream over everything available now, handing each micro-batch to ``sink(batch, batch_id, run)``.

    ``checkpoint`` is the folder in which the stream remembers what it has read: with the same folder a later call goes on
    where this one ended, without one every call reads all there is. ``run`` names that folder to the sink, so batches
    counted anew by another run never replace those of this one. Rows of a key count in the order of their arrival: by
    micro-batch, and inside one by the order columns.
    """
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "stream")
    run = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    q = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).foreachBatch(lambda batch, batch_id: sink(batch, batch_id, run)).start()
    q.awaitTermination()


def keyed_sink(path: str, key: str):
    """Sink that adds each key once, whichever run or batch brings it first.

    A batch written again after a failure replaces its own folder; all other folders are what is already committed.
    """
    def write(batch: DataFrame, batch_id: int, run: str) -> None:
        known = _read(batch.sparkSession, path, batch).where((F.col("run") != run) | (F.col("batch") != batch_id))
        fresh = batch.join(known.select(key).distinct(), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch_id}")

    return write


def append_sink(path: str):
    def write(batch: DataFrame, batch_id: int, run: str) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch_id}")

    return write


def _read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    schema = T.StructType([*like.schema.fields, T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())])
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
