"""Words of whole batches of texts as numpy arrays, and storage of intermediate tables.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; a null text counts as empty.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.session import new_folder

#: White space as the operators' contracts have it, for Java's regular expressions.
SPACES = "[\\x20\\x09-\\x0D]+"

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text worked on at once; only a longer single row goes beyond.
PIECE = 2 << 20

_random = np.random.default_rng(20240607)
_BYTES = _random.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write a table into the shared folder and read it back: it cuts lineage, survives lost
    executors, and tells the planner its true size."""
    return stored_in(df, new_folder(df.sparkSession, name), **options)


def stored_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """``stored``, with a folder for each value of a column, so that a value is read alone."""
    folder = new_folder(df.sparkSession, name)
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != column]), F.lit(8))  # a value is not one task's
    df.repartition(column, salt).write.partitionBy(column).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def stored_in(df: DataFrame, folder: str, **options) -> DataFrame:
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a stored table that no plan reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that a table does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text",
           limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches that hold ``limit`` bytes of text, or one longer row."""
    for batch in batches:
        _, ends = flat(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row starts and ends in them."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0]:ends[-1]], ends - ends[0]


def spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    white = WHITE[data]
    first = np.empty(len(data), bool)
    first[0], first[1:] = True, white[:-1]
    first[ends[:-1][ends[:-1] < len(data)]] = True
    last = np.empty(len(data), bool)
    last[-1], last[:-1] = True, white[1:]
    last[ends[1:][ends[1:] > 0] - 1] = True
    starts = np.flatnonzero(first & ~white)
    return starts, np.flatnonzero(last & ~white) + 1, np.searchsorted(starts, ends)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


class _Kept(dict):
    """Tables of one process. Tasks are sent this module by value, so what it holds would go with each of
    them, as a broadcast of 33 MB; a copy starts empty and is filled where it is used."""

    def __reduce__(self):
        return _Kept, ()


_kept: dict[str, np.ndarray] = _Kept()


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for a usual piece are made once a worker."""
    if n > PIECE + 1:
        return powers(_BASE, n), powers(_INVERSE, n)
    if not _kept:
        _kept.update(up=powers(_BASE, PIECE + 1), down=powers(_INVERSE, PIECE + 1))
    return _kept["up"][:n], _kept["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, from running sums."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(int(np.searchsorted(ends, starts[at] + PIECE, "right")), at + 1)
        low, high = starts[at], ends[stop - 1]
        up, down = _tables(int(high - low) + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTES[data[low:high]] * up[:high - low], out=sums[1:])
        a, b = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _STEP)
        at = stop
    return out


def sequence_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the ``n`` values that start at each place, where so many are left."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out *= _BASE
        out += hashes[j:len(hashes) - n + 1 + j]
    return mixed(out)


def inside(counts_before: np.ndarray, n: int) -> np.ndarray:
    """Places of the windows of ``n`` words that lie in one row."""
    total = int(counts_before[-1])
    if total < n:
        return np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(counts_before) - 1), np.diff(counts_before))
    return np.flatnonzero(row[:total - n + 1] == row[n - 1:])
