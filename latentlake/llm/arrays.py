"""Sorted arrays of 64-bit keys: counted in shards, kept as files in the shared folder, mapped into memory by workers."""

from __future__ import annotations

import mmap
import sys
import tempfile
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentlake.llm.text import pieces
from latentlake.plans.runtime import scratch_path

RUN_KEYS = 1_000_000  # keys that a task sorts before it sends them
OPEN = 4_096 if sys.version_info >= (3, 13) else 200  # files of a model that a worker keeps mapped at a time
_UNTRACKED = {"trackfd": False} if sys.version_info >= (3, 13) else {}


def system_of(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def array_folder(spark, name: str) -> str:
    """A folder in the shared one, as a URI."""
    folder = scratch_path(spark, name)
    return folder if ":" in folder.split("/")[0] else "file://" + folder


def save(folder: str, name: str, a: np.ndarray) -> str:
    """Write an array as a raw file; the name is the attempt's own, so attempts that run twice don't meet."""
    system, place = system_of(folder)
    system.create_dir(place, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}.bin"
    with system.open_output_stream(f"{place}/{name}") as f:
        f.write(memoryview(np.ascontiguousarray(a)).cast("B") if len(a) else b"")
    return name


def mapped(folder: str, name: str, kind) -> np.ndarray:
    """A file as an array, mapped into memory. The map needs no open file (Python 3.13 and later)."""
    from pyarrow import fs

    system, place = system_of(folder)
    local = isinstance(system, fs.LocalFileSystem)
    with open(f"{place}/{name}", "rb") if local else tempfile.TemporaryFile() as file:  # the copy has no name and goes with the map
        if not local:
            with system.open_input_stream(f"{place}/{name}") as source:
                while part := source.read(1 << 22):
                    file.write(part)
            file.flush()
        if not file.seek(0, 2):
            return np.zeros(0, kind)
        return np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, **_UNTRACKED), kind)


class Maps:
    """Mapped files of a folder, each mapped when it is first asked for; the ones unused for longest are let go."""

    def __init__(self, folder: str, most: int = OPEN):
        self.folder, self.most, self.held = folder, most, OrderedDict()

    def get(self, name: str, kind) -> np.ndarray:
        if name in self.held:
            self.held.move_to_end(name)
        else:
            self.held[name] = mapped(self.folder, name, kind)
            if len(self.held) > self.most:
                self.held.popitem(last=False)
        return self.held[name]


def narrowest(counts: np.ndarray):
    """The smallest type that holds all counts."""
    return np.min_scalar_type(int(counts.max(initial=0)))


def added(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their summed counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


RUN = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _narrow(counts: np.ndarray) -> bytes:
    """Counts with a byte each where that is enough."""
    wide = counts.max(initial=0) > 255
    return bytes([int(wide)]) + counts.astype(np.int64 if wide else np.uint8).tobytes()


def _widen(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64 if data[0] else np.uint8, offset=1).astype(np.int64)


def _runs(keys: np.ndarray, counts: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
    """Sorted keys cut into one run per shard; shard s begins at cuts[s]."""
    at = np.append(np.searchsorted(keys, cuts), len(keys))
    some = [s for s in range(len(cuts)) if at[s] < at[s + 1]]
    return pa.RecordBatch.from_arrays([
        pa.array(some, pa.int32()), pa.array([keys[at[s]:at[s + 1]].tobytes() for s in some], pa.binary()),
        pa.array([_narrow(counts[at[s]:at[s + 1]]) for s in some], pa.binary())], schema=RUN)


def sent(texts: DataFrame, to_keys, cuts: np.ndarray) -> DataFrame:
    """Runs (shard, keys, counts) of what ``to_keys()(column)`` makes of the texts, added up per task as far as memory goes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, held, size = to_keys(), [], 0
        for b in (piece for batch in batches for piece in pieces(batch, 0)):
            held.append(make(b.column(0)))
            size += len(held[-1])
            if size >= RUN_KEYS:
                yield _runs(*added(np.concatenate(held)), cuts)
                held, size = [], 0
        if held:
            yield _runs(*added(np.concatenate(held)), cuts)

    return texts.mapInArrow(run, "shard int, keys binary, counts binary")


def gathered(table: pa.Table, kind) -> tuple[np.ndarray, np.ndarray]:
    keys = [np.frombuffer(k.as_buffer(), kind) for k in table.column("keys")]
    counts = [_widen(c) for c in table.column("counts").to_pylist()]
    return added(np.concatenate(keys), np.concatenate(counts))


# --- byte strings by key -----------------------------------------------------------------------------------------------

STORE_BYTES = 32 << 20


def store(rows: DataFrame, folder: str, size: int) -> list[tuple[str, str, str] | None]:
    """Keep rows (cls: binary key of 16 bytes, data: binary) as mapped files, about ``size`` bytes in all. Rows of equal
    keys must be equal. Returns what ``Store`` needs: three file names per shard."""
    n = max(1, -(-size // STORE_BYTES))

    def shard(table: pa.Table) -> pa.Table:
        held = dict(zip(table.column("cls").to_pylist(), table.column("data").to_pylist()))
        keys = np.frombuffer(b"".join(held), np.uint64).reshape(-1, 2)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        data = list(held.values())
        ends = np.concatenate([[0], np.cumsum([len(data[i]) for i in order.tolist()])]).astype(np.int64)
        body = np.frombuffer(b"".join(data[i] for i in order.tolist()), np.uint8)
        return pa.table({"shard": table.column("shard")[:1], "keys": [save(folder, "keys", keys[order])], "ends": [save(folder, "ends", ends)], "data": [save(folder, "data", body)]})

    cut = rows.select(F.pmod(F.crc32("cls"), F.lit(n)).cast("int").alias("shard"), "cls", "data")
    names = {r["shard"]: (r["keys"], r["ends"], r["data"]) for r in cut.groupBy("shard").applyInArrow(
        shard, "shard int, keys string, ends string, data string").collect()}
    return [names.get(i) for i in range(n)]


class Store:
    """Byte strings by key, mapped shard by shard when first asked for."""

    def __init__(self, folder: str, names: list, kind):
        self.names, self.kind, self.maps = names, kind, Maps(folder)

    def __getitem__(self, key: bytes) -> np.ndarray:
        s = zlib.crc32(key) % len(self.names)
        keys, ends, data = (self.maps.get(n, t) for n, t in zip(self.names[s], (np.uint64, np.int64, np.uint8)))
        keys = keys.reshape(-1, 2)
        a, b = np.frombuffer(key, np.uint64)
        at = int(np.searchsorted(keys[:, 0], a))
        while keys[at, 1] != b:
            at += 1
        return data[ends[at]:ends[at + 1]].view(self.kind)
