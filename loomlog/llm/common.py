"""What the text operators share: sessions, partition counts, words and rolling hashes as numpy arrays.

Texts are handled as UTF-8 buffers of whole Arrow batches, cut into slices of whole documents
(``SLICE_BYTES`` of text, one document at least), so a task's memory is bounded by the largest
document and not by its partition.
"""

from __future__ import annotations

import ctypes
import functools
import math
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20
PARTITION_BYTES = 32 << 20
BATCH_ROWS = 1000
NULL_ID = (1 << 63) - 1

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240117))
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = int(_rng.integers(1 << 60, 1 << 62)) * 4 + 3
#: Bytes that separate words: space and U+0009 to U+000D.
IS_SEPARATOR = np.zeros(256, dtype=bool)
IS_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables: the cluster's own, or a new one where none is set (tests)."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    path = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="loomlog-checkpoint-")
    sc.setCheckpointDir(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its lineage, kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(df: DataFrame, bytes_each: int = PARTITION_BYTES) -> int:
    """Shuffle partitions that keep ``bytes_each`` of input apiece, never fewer than the session asks for."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    size = int(str(stats.sizeInBytes()))
    asked = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(asked, min(200_000, math.ceil(size / bytes_each)) if size < 1 << 60 else asked)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of documents in place of Spark's default of 10,000 rows, which is tens of MB of text on both sides of a pipe.

    A size that the session has set itself is kept.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def trim() -> None:
    """Give freed memory back to the system; Python workers are reused and would hold the peak of their last task."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library frees by itself


def trimmed(run: Callable) -> Callable:
    """A batch function that gives memory back at its end."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, where its files give fewer; a table of any size has more."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place where it can be."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(29)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(32)
    return x


#: A Mersenne prime. Modulo a power of two, a polynomial hash makes certain words equal whatever its base; modulo a prime, none by construction.
_P = (1 << 61) - 1


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` below 2^64 modulo the prime."""
    x = (x & _U(_P)) + (x >> _U(61))
    x -= (x >= _U(_P)) * _U(_P)
    return x


def _times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Product modulo the prime, from halves of 30 and 31 bits."""
    high, low = a >> _U(31), a & _U((1 << 31) - 1)
    high2, low2 = b >> _U(31), b & _U((1 << 31) - 1)
    middle = high * low2
    middle += low * high2
    high *= high2
    high += high
    low *= low2
    high += low
    high += middle >> _U(30)
    middle &= _U((1 << 30) - 1)
    middle <<= _U(31)
    high += middle
    return _reduced(high)


class _Powers:
    """Powers of the base modulo the prime and of its inverse, and of both modulo 2^64."""

    def __init__(self) -> None:
        self.up = self.down = self.plain_up = self.plain_down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> _Powers:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, base in (("up", _BASE % _P), ("down", pow(_BASE, -1, _P))):
                x, step = getattr(self, name), pow(base, len(getattr(self, name)), _P)
                while len(x) < n:  # twice as many each time
                    x, step = np.concatenate((x, _times(x, _U(step)))), step * step % _P
                setattr(self, name, x)
            for name, base in (("plain_up", _BASE), ("plain_down", pow(_BASE, -1, 1 << 64))):
                x = np.full(len(self.up), base & (1 << 64) - 1, dtype=np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self


_powers = _Powers()
_BLOCK = 1 << 13


def anchors(values: np.ndarray, k: int) -> np.ndarray:
    """A number for the ``k`` values from each one on: the same for equal ones, hardly ever for others. Fast, and no proof that they are equal."""
    n = len(values)
    powers = _powers.get(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers.plain_up[:n], out=sums[1:])
    m = max(0, n - k + 1)
    return mix((sums[k : k + m] - sums[:m]) * powers.plain_down[:m])


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` words from each one on: sums of the words' hashes, each times the key of its place."""
    m = max(0, len(words) - k + 1)
    out = np.full(m, k, dtype=np.uint64)
    for j, key in enumerate(_keys(np.arange(k))):
        out += words[j : j + m] * key
    return mix(out)


class Rolling:
    """Prefix sums of a polynomial hash modulo a prime over ``values``: the hash of any stretch in O(1)."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        powers = _powers.get(n + 1)
        self.down, self.sums = powers.down, np.zeros(n + 1, dtype=np.uint64)
        total = 0
        for a in range(0, n, _BLOCK):  # a block stays in the cache, and its halves cannot overflow
            z = min(n, a + _BLOCK)
            terms = _times(_reduced(values[a:z]), powers.up[a:z])
            low = np.cumsum(terms & _U((1 << 31) - 1), dtype=np.uint64)
            terms >>= _U(31)
            high = np.cumsum(terms, dtype=np.uint64)  # times 2^31: the upper bits of it come round
            low += (high & _U((1 << 30) - 1)) << _U(31)
            low += (high >> _U(30)) + _U(total)
            self.sums[a + 1 : z + 1] = _reduced(low)
            total = int(self.sums[z])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(_times(_reduced(self.sums[end] + _U(_P) - self.sums[start]), self.down[start]) + ((end - start).astype(np.uint64) << _U(40)))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, bytes, offsets)`` for stretches of rows; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all documents in a slice, and each document's first word (one more at the end)."""
    n = len(data)
    word = ~IS_SEPARATOR[data]
    start = word.copy()
    end = word.copy()
    if n:
        start[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        start[inner] = word[inner]
        end[inner - 1] = word[inner - 1]
    ws = np.flatnonzero(start)
    we = np.flatnonzero(end) + 1
    return ws, we, np.searchsorted(ws, offsets)


def _keys(at: np.ndarray) -> np.ndarray:
    return mix(at.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(_BASE))


_KEYS = _keys(np.arange(1 << 12))


def word_hashes(data: np.ndarray, ws: np.ndarray, we: np.ndarray) -> np.ndarray:
    """Of each word the sum of its bytes' values, each times the key of its place in the word."""
    if not len(ws):
        return np.zeros(0, dtype=np.uint64)
    begin = np.zeros(len(data), dtype=np.int64)
    begin[ws] = ws
    at = np.arange(len(data)) - np.maximum.accumulate(begin)
    longest = int((we - ws).max())
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * (_KEYS[np.minimum(at, len(_KEYS) - 1)] if longest <= len(_KEYS) else _keys(at)), out=sums[1:])
    return mix(sums[we] - sums[ws] + (we - ws).astype(np.uint64))
