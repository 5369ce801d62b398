"""Streams over several micro-batches against the table versions."""

import numpy as np
import pytest
from helpers import vectors
from pyspark.sql import functions as F

from latentlake.catalog.composed import MEM, ORDER, fed
from latentlake.operators import traces
from latentlake.streaming import memory, triggers


@pytest.fixture(scope="module")
def parts(spark, sf, tmp_path_factory):
    """The events cut by time into four files, so that a stream takes four micro-batches."""
    path = str(tmp_path_factory.mktemp("ev"))
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumn("user_id", F.col("user_id") % 4)
    q = ev.approxQuantile("event_id", [0.25, 0.5, 0.75], 0.0)
    for i, (lo, hi) in enumerate(zip([-1, *q], [*q, 1e18])):
        ev.where((F.col("event_id") > lo) & (F.col("event_id") <= hi)).coalesce(1).write.mode("append").parquet(path)
    return path, ev


def stream(spark, parts):
    return spark.readStream.schema(parts[1].schema).option("maxFilesPerTrigger", 1).parquet(parts[0])


def test_stream_equals_table(spark, parts, tmp_path):
    out = memory.remember_stream(fed(stream(spark, parts)), "user_id", ["event_id"], "event_id", ["f1", "f2"], MEM, "kind")
    triggers.run_available(out, triggers.append_sink(str(tmp_path / "o")))
    got = {r.event_id: (r.status, r.y) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    table = memory.remember(fed(parts[1]).withColumn("x", F.array("f1", "f2")), "user_id", ["event_id"], "event_id", "x", MEM, "kind")
    want = {r.event_id: (r.status, r.y) for r in table.collect()}
    assert got.keys() == want.keys()
    for k, (s, y) in want.items():
        assert got[k][0] == s and (y is None) == (got[k][1] is None) and (y is None or np.allclose(y, got[k][1]))
    assert {s for s, _ in want.values()} >= {"step", "reset", "committed", "rejected"}


def test_chunked_table_equals_sequential(spark, parts):
    df = fed(parts[1]).withColumn("x", F.array("f1", "f2")).withColumn("user_id", F.lit(1))
    for kind in (None, "kind"):
        whole, cut = (memory.remember(df, "user_id", ORDER, "event_id", "x", MEM, kind, chunk_rows=c) for c in (10**6, 90))
        w, c = ({r.event_id: (r.status, r.y) for r in t.collect()} for t in (whole, cut))
        assert w == c


def test_trigger_fires_once_per_key(spark, parts, tmp_path):
    path = str(tmp_path / "c")
    rows = stream(spark, parts).select("event_id", "user_id", "value")
    out = triggers.stable_stream(rows, "user_id", ["event_id"], "event_id", "value", threshold=30.0)
    triggers.run_available(out, triggers.keyed_sink(path, "user_id"))
    got = sorted((r.user_id, r.event_id) for r in spark.read.parquet(path).collect())
    want = traces.first_stable(parts[1], ["user_id"], ["event_id"], "value", 30.0).where("first IS NOT NULL")
    assert got == sorted((r.user_id, r["first"].event_id) for r in want.collect())


def test_sink_ignores_a_repeated_batch(spark, tmp_path):
    sink = triggers.keyed_sink(str(tmp_path / "s"), "k")
    a = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    b = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v long")
    for batch, i in ((a, 0), (b, 1), (b, 1), (a, 0)):
        sink(batch, i, "run")
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_commits_survive_a_restart(spark, tmp_path):
    """x and y commit, then rows arrive for y and z: with the old checkpoint or a new one, x and y stay as they were."""
    source, schema = str(tmp_path / "in"), "event_id long, user_id string, value double"
    for new_run in (False, True):
        out, mark = str(tmp_path / f"out{new_run}"), str(tmp_path / f"mark{new_run}")
        src = f"{source}{new_run}"
        for at, keys in enumerate((("x", "y"), ("y", "z"))):
            rows = [(100 * at + 10 * i + j, k, 1.0) for i, k in enumerate(keys) for j in range(3)]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
            fired = triggers.stable_stream(stream, "user_id", ["event_id"], "event_id", "value", threshold=2.0, width=2)
            triggers.run_available(fired, triggers.keyed_sink(out, "user_id"), f"{mark}{at if new_run else ''}")
        assert sorted((r.user_id, r.event_id) for r in spark.read.parquet(out).collect()) == [("x", 1), ("y", 11), ("z", 111)]


def test_parameters_are_checked():
    for bad in (dict(d=0), dict(d=2, radius=1.0), dict(d=2, leak=0.0), dict(d=2, scale=0)):
        with pytest.raises(ValueError):
            memory.Memory(**bad)
    w_in, w_res, w_out = memory.Memory(3).matrices()
    assert w_in.shape == (12, 3) and w_out.shape == (3, 12) and abs(np.abs(np.linalg.eigvals(w_res)).max() - 0.9) < 1e-9


def test_a_stream_that_knows_only_the_table_rejects_what_is_committed(spark, parts, tmp_path):
    """The second half of the events with no checkpoint of the first: committed keys stay closed, others start anew."""
    ev = parts[1]
    half = ev.approxQuantile("event_id", [0.5], 0.0)[0]
    early = memory.remember(fed(ev.where(F.col("event_id") <= half)).withColumn("x", F.array("f1", "f2")), "user_id", ["event_id"], "event_id", "x", MEM, "kind")
    closed = early.where("status = 'committed'")
    keys = {r.user_id for r in closed.collect()}
    later = fed(ev.where(F.col("event_id") > half))
    source = str(tmp_path / "late")
    ev.where(F.col("event_id") > half).coalesce(1).write.parquet(source)
    rows = spark.readStream.schema(ev.schema).parquet(source)
    out = memory.remember_stream(fed(rows), "user_id", ["event_id"], "event_id", ["f1", "f2"], MEM, "kind", closed)
    triggers.run_available(out, triggers.append_sink(str(tmp_path / "o")))
    got = {r.event_id: r.status for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    want = {r.event_id: r.status for r in memory.statuses(later, "user_id", ["event_id"], "kind").collect()}
    own = {r.event_id: r.user_id for r in later.collect()}
    assert keys and got == {e: "rejected" if own[e] in keys else s for e, s in want.items()}


def test_a_trigger_that_knows_only_the_table_does_not_fire_again(spark, parts, tmp_path):
    fired = traces.first_stable(parts[1], ["user_id"], ["event_id"], "value", 30.0).where("first IS NOT NULL").select("user_id").limit(1)
    known = fired.first().user_id
    rows = stream(spark, parts).select("event_id", "user_id", "value")
    out = triggers.stable_stream(rows, "user_id", ["event_id"], "event_id", "value", threshold=30.0, fired=spark.createDataFrame([(known,)], "user_id long"))
    triggers.run_available(out, triggers.append_sink(str(tmp_path / "c")))
    keys = {r.user_id for r in spark.read.parquet(str(tmp_path / "c")).collect()}
    want = {r.user_id for r in traces.first_stable(parts[1], ["user_id"], ["event_id"], "value", 30.0).where("first IS NOT NULL").collect()}
    assert keys == want - {known}
