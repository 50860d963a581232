"""Vectorised word and window hashing over Arrow string buffers (no Python loop per word)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U = np.uint64
#: Bytes that separate words: space and 0x09-0x0D. UTF-8 continuation bytes never fall here.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LAST = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_GOLD, SECOND = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
BASE, BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def own_session(spark: SparkSession) -> SparkSession:
    """A session with bounded batches beside the caller's, which keeps its settings.

    Workers get Arrow batches of at most a thousand rows and 8 MB; files read in it fill column batches of a few
    hundred rows outside the heap, as texts would make arrays of many MB on it.
    """
    own = type(spark)(spark.sparkContext, spark._jsparkSession.cloneSession())
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(rows, 1000) if rows > 0 else 1000))
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    own.conf.set("spark.sql.parquet.columnarReaderBatchSize", "256")
    own.conf.set("spark.sql.columnVector.offheap.enabled", "true")
    return own


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` in an ``own_session``; what is derived from it stays there."""
    return in_session(df, own_session(df.sparkSession))


def in_session(df: DataFrame, spark: SparkSession) -> DataFrame:
    """``df`` as a DataFrame of the session ``spark``, whose settings and catalog then hold for it."""
    plan = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, df._jdf.queryExecution().analyzed())
    return DataFrame(plan, spark)


def grouped(batches: Iterator[pa.RecordBatch], column: str, rows: int, size: int = 16 << 20) -> Iterator[pa.Table]:
    """Batches sorted by ``column`` as tables of whole groups, of about ``rows`` rows or ``size`` bytes; a larger group stands alone."""
    held, n, held_bytes = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, held_bytes = n + batch.num_rows, held_bytes + batch.nbytes
        if n >= rows or held_bytes >= size:
            table = pa.Table.from_batches(held)
            keys = table[column].to_numpy()
            whole = int(np.searchsorted(keys, keys[-1], "left"))
            if whole:
                yield table.slice(0, whole)
                held = table.slice(whole).to_batches()
                n, held_bytes = n - whole, sum(b.nbytes for b in held)
    if n:
        yield pa.Table.from_batches(held)


def trim() -> None:
    """Give freed memory back: workers are reused by later stages."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``width`` hashes (last ``width - 1`` starts left out)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, U)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(BASE, len(values)), out=total[1:])
    return mix((total[width:] - total[:n]) * powers(BASE_INV, n))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes; a longer row stands alone, whole."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


class Table:
    """64-bit hash -> number, by open addressing at half load at most."""

    def __init__(self, most: int):
        self.slots = 1 << (2 * most - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.keys, self.values = np.zeros(self.slots, U), np.zeros(self.slots, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        at = (h & U(self.slots - 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            seen = self.keys[at]
            hit = seen == h[left]
            out[left[hit]] = self.values[at[hit]]
            go = ~hit & (seen != 0)
            left, at = left[go], (at[go] + 1) & (self.slots - 1)
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """Distinct hashes that are not in the table."""
        at = (h & U(self.slots - 1)).astype(np.int64)
        while len(h):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[free]
            placed = self.keys[at] == h
            self.values[at[placed]] = values[placed]
            h, values, at = h[~placed], values[~placed], (at[~placed] + 1) & (self.slots - 1)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the total); ``lower`` folds A-Z only."""
    hashes, first, _, _ = word_spans(data, offsets, lower)
    return hashes, first


def word_spans(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_hashes``, and where each word begins and ends, counted from ``offsets[0]``."""
    data = data[offsets[0] : offsets[-1]]
    off = offsets - offsets[0]
    n = len(data)
    if not n:
        return np.empty(0, U), np.zeros(len(off), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~SEPARATOR[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(inside & (edge[:n] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return _hashed(_LOWER[data] if lower else data, starts, ends), np.searchsorted(starts, off), starts, ends


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each stretch of bytes: its blocks of eight bytes are mixed with their place before they are summed.

    A plain polynomial modulo 2**64 would give equal hashes to some long words that differ (Thue-Morse strings), whatever its base.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(padded) - 7,), "<u8", padded.data, 0, (1,))
    size = ends - starts
    total = mix((eight[starts] & _LAST[np.minimum(size, 8)]) ^ _GOLD)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8
        place = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        at = np.repeat(starts[long], more) + 8 * place
        blocks = eight[at] & _LAST[np.minimum(np.repeat(ends[long], more) - at, 8)]
        total[long] += np.add.reduceat(mix(blocks ^ mix((place.astype(U) + U(1)) * _GOLD)), np.cumsum(more) - more)
    return mix(total + size.astype(U) * SECOND)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, one after another, and the rows' bounds.

    A row with fewer words than ``width`` has its whole sequence as one shingle; without words, none.
    """
    hashes, first = word_hashes(data, offsets, lower=True)
    rolled = rolling(hashes, width)
    parts, bounds = [], np.zeros(len(first), np.int64)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a >= width:
            got = np.unique(rolled[a : b - width + 1])
        elif b > a:
            got = mix(np.add.reduce(hashes[a:b] * powers(BASE, b - a), keepdims=True) + U(b - a))
        else:
            got = hashes[:0]
        parts.append(got)
        bounds[i + 1] = bounds[i] + len(got)
    return (np.concatenate(parts) if parts else np.empty(0, U)), bounds
