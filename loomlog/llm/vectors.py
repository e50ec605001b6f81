"""What the operators on vectors share: components as exact integers, packed by row, and sums over blocks in a tree.

A vector goes in as an array of numbers and becomes ``dims`` and ``x``: the integers ``floor(scale * c)`` in
little-endian order, two bytes each where all fit, else eight. The width follows from the row alone, so equal
vectors have equal bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from . import common

#: Integers of this size on are refused: sums of two would leave 64 bits.
LIMIT = 1 << 62
FAN = 32


def integers(df: DataFrame, vector: str, keep: list[str], scale: int) -> DataFrame:
    """Columns ``keep``, ``dims`` and ``x`` of the rows whose vector is not null or empty and whose components are all finite numbers.

    Fails on components of ``LIMIT / scale`` or more, which have no exact 64-bit integer.
    """
    kind = df.schema[vector].dataType
    plain = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType | DoubleType)
    rows = df.select(*keep, F.col(vector) if plain else F.col(vector).cast("array<double>").alias(vector))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(keep))
            size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls come as NaN
            ends = np.cumsum(size)
            wrong = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
            good = np.flatnonzero((size > 0) & (wrong[ends] == wrong[ends - size]))
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(flat * scale)
            bodies = []
            for i in good.tolist():
                v = whole[ends[i] - size[i] : ends[i]]
                most = np.abs(v).max()
                if most >= LIMIT:
                    raise ValueError(f"a component of {most / scale:g} has no exact integer: at most {LIMIT // scale} can be taken")
                bodies.append(v.astype("<i2" if most < 1 << 15 else "<i8").tobytes())
            told = b.take(pa.array(good))
            yield pa.RecordBatch.from_arrays([*told.columns[:-1], pa.array(size[good].astype(np.int32)), pa.array(bodies, pa.binary())], names=[*keep, "dims", "x"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.drop(vector).dtypes)
    return rows.mapInArrow(run, f"{kinds}, dims int, x binary")


def commonest(rows: DataFrame) -> int:
    """The length that most rows of ``integers`` have, the smaller of equally frequent ones; 0 for an empty table."""
    found = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").first()
    return found.dims if found else 0


def matrix(bodies: pa.Array, dims: int) -> np.ndarray:
    """The vectors ``x`` of a batch as rows of 64-bit integers."""
    texts = bodies.to_pylist()
    if all(len(t) == 2 * dims for t in texts):
        return np.frombuffer(b"".join(texts), dtype="<i2").reshape(-1, dims).astype(np.int64)
    return np.stack([np.frombuffer(t, dtype="<i2" if len(t) == 2 * dims else "<i8").astype(np.int64) for t in texts])


def in_blocks(rows: DataFrame, body: Callable[[Iterator[pa.Array]], bytes]) -> DataFrame:
    """(block, body): what ``body`` makes of the first column of each partition, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = body(b.column(0) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([made], pa.binary())], names=["block", "body"])

    return rows.mapInArrow(common.trimmed(run), "block bigint, body binary")


def merged(blocks: DataFrame, n: int, merge: Callable[[list[bytes]], bytes]) -> bytes:
    """One body of all: ``FAN`` at a time are merged by a task, level by level, ``n`` being the number of blocks."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "body": pa.array([merge(rows["body"].to_pylist())], pa.binary())})

    while True:
        blocks = blocks.groupBy(F.expr(f"block div {FAN}").alias("up")).applyInArrow(run, "block bigint, body binary")
        n = -(-n // FAN)
        if n <= 1:
            return bytes(blocks.first().body)
