"""Embeddings whitened: projected on the principal directions of the table and scaled to deviation one, by one-sided Jacobi SVD.

A component c becomes the integer x = floor(SCALE * c) + OFFSET. The fit list is each distinct x-vector once. Its count
n and sums S are exact, and so is n * x - S, the centred vector n times; nothing is subtracted in floating point before that.

1. Blockwise TSQR: each task folds its centred rows batch by batch into a triangular R; the R of the tasks are
   stacked and folded again, some at a time, until one is left. It has as many columns as the vectors, whatever their number.
2. One-sided Jacobi: plane rotations make R's columns orthogonal. Their lengths over sqrt(n) are the standard deviations,
   small ones as accurately as large ones, and the accumulated rotations are the components.
3. A scan of all rows projects their centred vectors and divides by the deviations. How far the covariance of
   the whitened fit list is from the identity is measured on the data, from centred blocks merged in the same way.

Cases: vectors that are null, empty or hold null or non-finite components are dropped; of different lengths
the commonest counts (the smaller of equally common ones) and rows of others are dropped; null ids are kept; repeated rows each have
their rows in the result and count once in the fit; directions in which the fit list does not vary (deviation within rounding of
none) have no whitened values and no rows, so a table of one distinct vector gives none; an empty table gives an empty
result. ``deviation`` is null where it does not fit 64 bits. Other columns of any name are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectors

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
MAX_SWEEPS = 60

SCHEMA = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


class Fit(NamedTuple):
    """Count and sums of the fit list."""

    n: int
    sums: tuple[int, ...]

    def centred(self, packed: pa.Array) -> np.ndarray:
        """n * x - S of each packed vector: 64-bit integers, or Python's own where those could overflow."""
        x = vectors.matrix(packed, len(self.sums)) + OFFSET
        bound = self.n * int(np.abs(x).max()) + max(map(abs, self.sums))
        kind = np.int64 if bound < 1 << 63 else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)


class Whitening(NamedTuple):
    fit: Fit
    components: np.ndarray  # one a row, of falling deviation
    deviations: np.ndarray
    variance: float  # the whole, of all components


def _totals(rows: DataFrame, dims: int) -> Fit:
    """Count and exact sums of packed vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dims, dtype=object)
        for b in batches:
            if b.num_rows:
                x = vectors.matrix(b.column(0), dims) + OFFSET
                n += len(x)
                sums += x.astype(object).sum(axis=0) if int(np.abs(x).max()) * len(x) >= 1 << 63 else x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n] * dims, pa.int64()), pa.array(range(dims), pa.int32()), pa.array([int(s) for s in sums], pa.decimal128(38, 0))], names=["n", "at", "s"])

    found = rows.select("x").mapInArrow(run, "n bigint, at int, s decimal(38,0)").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("at").collect()  # a row a dimension
    return Fit(found[0].n if found else 0, tuple(int(r.s) for r in found))


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def tsqr(rows: DataFrame, fit: Fit) -> np.ndarray:
    """R of the centred rows."""
    dims = len(fit.sums)

    def fold(batches: Iterator[pa.Array]) -> bytes:
        r = np.zeros((0, dims))
        for packed in batches:
            r = _triangle(np.vstack((r, (fit.centred(packed) / fit.n).astype(np.float64))))
        return r.tobytes()

    def merge(bodies: list[bytes]) -> bytes:
        stacked = np.vstack([np.frombuffer(x).reshape(-1, dims) for x in bodies])
        return _triangle(stacked).tobytes()

    r = np.frombuffer(vectors.merged(vectors.in_blocks(rows.select("x"), fold), rows.rdd.getNumPartitions(), merge)).reshape(-1, dims)
    return np.vstack((r, np.zeros((max(0, dims - len(r)), dims))))


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n things in rounds of disjoint pairs."""
    seats = list(range(n + n % 2))
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(a, b) for a, b in zip(seats[:half], reversed(seats[half:]), strict=True) if max(a, b) < n]
        yield np.array([min(p) for p in pairs]), np.array([max(p) for p in pairs])
        seats = [seats[0], seats[-1], *seats[1:-1]]


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right singular vectors (rows) of ``r``, largest first; each vector's largest component is positive."""
    columns, turned = r.T.copy(), np.eye(r.shape[1])
    least = np.finfo(float).eps * math.sqrt(len(columns))
    rounds = list(_rounds(len(columns)))
    for _ in range(MAX_SWEEPS):
        rotated = False
        for p, q in rounds:
            a, b, c = (np.einsum("ij,ij->i", columns[i], columns[j]) for i, j in ((p, p), (q, q), (p, q)))
            turn = np.abs(c) > least * np.sqrt(a) * np.sqrt(b)
            if not turn.any():
                continue
            rotated = True
            p, q, a, b, c = p[turn], q[turn], a[turn], b[turn], c[turn]
            zeta = (b - a) / (2 * c)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = 1 / np.hypot(1.0, t)
            sin = (cos * t)[:, None]
            cos = cos[:, None]
            for m in (columns, turned):
                m[p], m[q] = cos * m[p] - sin * m[q], sin * m[p] + cos * m[q]
        if not rotated:
            break
    else:
        raise ArithmeticError(f"columns are not orthogonal after {MAX_SWEEPS} sweeps")
    values = np.sqrt(np.einsum("ij,ij->i", columns, columns))
    order = np.argsort(-values, kind="stable")
    turned = turned[order]
    turned *= np.where(turned[np.arange(len(turned)), np.abs(turned).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return values[order], turned


def fit(rows: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """Whitening by the distinct vectors ``rows`` (x), which are read twice."""
    totals = _totals(rows, dims)
    values, found = jacobi(tsqr(rows, totals))
    used = int(np.count_nonzero(values[:components] > values[0] * dims * np.finfo(float).eps))
    return Whitening(totals, found[:used], values[:used] / math.sqrt(totals.n), float((values**2).sum() / totals.n))


def _projected(w: Whitening, z: np.ndarray) -> np.ndarray:
    return (z / w.fit.n).astype(np.float64) @ w.components.T / w.deviations


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened ``rows``, the fit list, minus the identity."""
    k = len(w.components)

    def told(n: float, mean: np.ndarray, m: np.ndarray) -> bytes:
        return np.concatenate(([n], mean, m.ravel())).tobytes()

    def merge(bodies: list[bytes]) -> bytes:
        n, mean, m = 0.0, np.zeros(k), np.zeros((k, k))
        for v in map(np.frombuffer, bodies):
            if v[0]:
                apart = v[1 : k + 1] - mean
                m = m + v[k + 1 :].reshape(k, k) + np.outer(apart, apart) * (n * v[0] / (n + v[0]))
                n += v[0]
                mean = mean + apart * (v[0] / n)
        return told(n, mean, m)

    def fold(batches: Iterator[pa.Array]) -> bytes:
        held = told(0.0, np.zeros(k), np.zeros((k, k)))
        for packed in batches:
            y = _projected(w, w.fit.centred(packed))
            mean = y.mean(axis=0)
            held = merge([held, told(float(len(y)), mean, (y - mean).T @ (y - mean))])
        return held

    v = np.frombuffer(vectors.merged(vectors.in_blocks(rows.select("x"), fold), rows.rdd.getNumPartitions(), merge))
    return float(np.abs(v[k + 1 :].reshape(k, k) / v[0] - np.eye(k)).max()) if k else 0.0


def _squares(z: np.ndarray) -> list[int]:
    """Exact sums of the squares of each row."""
    most = int(np.abs(z).max())
    if z.dtype == object or most * most * z.shape[1] >= 1 << 63:
        z = z.astype(object)
    return [int(s) for s in (z * z).sum(axis=1)]


def transform(rows: DataFrame, w: Whitening, error: float, keep: list[str]) -> DataFrame:
    """A row for each of ``rows`` (``vectors.integers``) and each component."""
    held = rows.sparkSession.sparkContext.broadcast(w)  # dims * components numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Whitening = held.value
        k = len(known.components)
        explained = known.deviations**2 / known.variance
        for b in batches:
            if not b.num_rows or not k:
                continue
            z = known.fit.centred(b.column(len(keep)))
            each = np.repeat(np.arange(b.num_rows), k)
            columns = [b.column(i).take(pa.array(each)) for i in range(len(keep))]
            m = len(each)
            deviation = pa.array(_squares(z), pa.decimal128(38, 0)).take(pa.array(each))
            columns += [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(m, known.fit.n, dtype=np.int64)), deviation, pa.array(_projected(known, z).ravel()), pa.array(np.tile(explained, b.num_rows)), pa.array(np.full(m, error))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes)
    return rows.select(*keep, "x").mapInArrow(common.trimmed(run), f"{kinds}, {SCHEMA}")


def whiten(table: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """(key, component, n, deviation, whitened, explained, identity_error) of the vectors of ``table``, and what was fitted."""
    rows = vectors.integers(table, vector, [key], SCALE)
    rows = common.checkpointed(rows)
    dims = vectors.commonest(rows)
    rows = rows.filter(F.col("dims") == dims)
    if not dims:
        told = [x.strip().split(" ") for x in SCHEMA.replace("38,0", "38 0").split(", ")]
        return rows.select(key, *(F.lit(None).cast(" ".join(t).replace("38 0", "38,0")).alias(n) for n, *t in told)), None
    distinct = common.checkpointed(rows.select("x").distinct())
    w = fit(distinct, dims, components)
    return transform(rows, w, identity_error(distinct, w), [key]), w


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = whiten(common.table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))
