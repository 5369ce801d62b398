"""Words and hashes shared by the corpus operators.

A word is a run of characters other than space and U+0009..U+000D, everywhere in this subpackage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentlake.plans.runtime import scratch_path

GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def let(value: Column, fn) -> Column:
    """fn(value), with value computed once however often fn uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.translate(F.coalesce(text, F.lit("")), BLANKS, "")).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and there whatever happens to the executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- inside tasks: many texts at once as one byte array ---------------------------------------------------------------

_MUL = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            for name, base in (("up", _MUL), ("down", _INV)):
                p = np.full(m, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end, and offsets (one more than texts). Null counts as empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = a.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    data = a.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: int, most: int = 1 << 19):
    """Slices of a batch whose texts have about ``most`` bytes, or one row: what a task works on at a time."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def rolling(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix, down): a substring [s, e) hashes to (prefix[e] - prefix[s]) * down[s], wherever it stands."""
    up, down = _powers.get(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:-1], out=prefix[1:])
    return prefix, down


def hashed_words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the number of words before each text (one more than texts)."""
    if lower:
        raw = _LOWER[raw]
    solid = ~_IS_BLANK[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[False], solid])
    after = np.concatenate([solid, [False]])
    starts = np.flatnonzero(after & (~before | cut))
    ends = np.flatnonzero(before & (~after | cut))
    prefix, down = rolling(raw)
    h = mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, offsets).astype(np.int64)


def owners(bounds: np.ndarray) -> np.ndarray:
    """For every element the text that it belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
