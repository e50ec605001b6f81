"""Vectors compressed to codes of parts: integer codebooks, learnt in rounds over the whole table.

Components become integers ``floor(SCALE * c)``; a vector is cut into ``PARTS`` consecutive parts of equal
length, and each part is replaced by the number of the nearest entry of its position's codebook. The codebooks
are a broadcast of ``PARTS * ENTRIES`` parts, whatever the table's size. Arrow batches compute the distances to all
entries at once as |x|^2 - 2 x.c + |c|^2, with an exact int64 matrix product, and take the first least one. In each
round a task adds up its rows by entry and sends one sum for each entry; a grouped shuffle merges those.

All arithmetic is exact: distances that could leave 64 bits are refused before the first round, and
sums over the table are decimals.

Cases: vectors that are null, empty or hold null or non-finite components are dropped; of different lengths
the commonest counts (the smaller of equally common ones) and rows of others are dropped; a length that ``PARTS``
does not divide fails; a null id sorts behind all others, rows of equal id by their integers; repeated rows each count,
also among the first entries; fewer rows than ``ENTRIES`` give as many entries; an empty table gives an empty
result. Other columns of any name are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectors

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4


class Codebooks:
    """``entries[p]``: the entries of the codebook of part ``p``, one a row."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.parts, self.size, self.width = entries.shape
        self._norms = (entries * entries).sum(axis=2)

    @property
    def dims(self) -> int:
        return self.parts * self.width

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of ``x`` and each part the nearest entry, the first of equally near ones, and its squared distance."""
        found = np.empty((len(x), self.parts), dtype=np.int64)
        least = np.empty_like(found)
        for p, (book, norms) in enumerate(zip(self.entries, self._norms, strict=True)):
            part = np.ascontiguousarray(x[:, p * self.width : (p + 1) * self.width])
            far = part @ book.T
            far *= -2
            far += norms
            found[:, p] = far.argmin(axis=1)
            least[:, p] = far[np.arange(len(x)), found[:, p]] + (part * part).sum(axis=1)
        return found, least

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that rows of entry numbers stand for."""
        return np.concatenate([book[codes[:, p]] for p, book in enumerate(self.entries)], axis=1)


def _sums(books) -> callable:
    """Packed vectors to the sums and counts of the parts by nearest entry, once a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Codebooks = books.value
        total = np.zeros(held.entries.shape, dtype=np.int64)
        count = np.zeros(held.entries.shape[:2], dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = vectors.matrix(b.column(0), held.dims)
            found, _ = held.nearest(x)
            for p in range(held.parts):
                order = np.argsort(found[:, p], kind="stable")
                used, first, n = np.unique(found[order, p], return_index=True, return_counts=True)
                total[p, used] += np.add.reduceat(x[order, p * held.width : (p + 1) * held.width], first, axis=0)
                count[p, used] += n
        part, entry = np.nonzero(count)
        sums = pa.FixedSizeListArray.from_arrays(pa.array(total[part, entry].ravel()), held.width).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), sums], names=["part", "entry", "n", "sums"])

    return common.trimmed(run)


def train(rows: DataFrame, order: str, dims: int, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of ``rows`` (``vectors.integers``), all of ``dims`` components; None for an empty table.

    They begin with the parts of the first rows by ``order``.
    """
    if dims % parts:
        raise ValueError(f"{dims} components cannot be cut into {parts} equal parts")
    spark = rows.sparkSession
    first = [r.v for r in rows.select(order, _listed(rows, dims).alias("v")).orderBy(F.asc_nulls_last(order), "v").limit(entries).collect()]
    if not first:
        return None
    width = dims // parts
    books = Codebooks(np.ascontiguousarray(np.array(first, dtype=np.int64).reshape(-1, parts, width).transpose(1, 0, 2)))
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(books)
        told = rows.select("x").mapInArrow(_sums(held), "part int, entry int, n bigint, sums array<bigint>")
        exact = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
        new = books.entries.copy()
        for part, entry, n, *sums in told.groupBy("part", "entry").agg(F.sum("n"), *exact).collect():  # at most parts * entries rows
            new[part, entry] = [int(s) // n for s in sums]
        held.unpersist()
        books = Codebooks(new)
    return books


def _listed(rows: DataFrame, dims: int):
    """The packed vectors as arrays of integers, which sort by their components."""

    @F.pandas_udf("array<bigint>")
    def listed(x):
        return type(x)(list(vectors.matrix(pa.array(x, pa.binary()), dims)) if len(x) else [], dtype=object)

    return listed("x")


def encode(rows: DataFrame, books: Codebooks, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``rows`` with ``code`` (two hexadecimal digits a part) and ``error``, the squared distance to what the code stands for."""
    held = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Codebooks = held.value
        for b in batches:
            if not b.num_rows:
                continue
            found, least = known.nearest(vectors.matrix(b.column(len(keep)), known.dims))
            codes = [bytes(c).hex() for c in found.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(codes), pa.array(least.sum(axis=1))], names=[*keep, "code", "error"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes)
    return rows.select(*keep, "x").mapInArrow(common.trimmed(run), f"{kinds}, code string, error bigint")


def decode(coded: DataFrame, books: Codebooks, *, scale: int = SCALE) -> DataFrame:
    """``coded`` with ``vector``: what each code stands for, in the scale of the components."""
    held = coded.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf("array<double>")
    def vector(codes):
        known = held.value
        numbers = np.frombuffer(bytes.fromhex("".join(codes)), dtype=np.uint8).reshape(len(codes), known.parts)
        return type(codes)(list(known.decoded(numbers) / scale), dtype=object)

    return coded.withColumn("vector", vector("code"))


def exact_range(rows: DataFrame, dims: int) -> None:
    """Fails where distances between vectors of these components could leave 64 bits."""
    most = math.isqrt(((1 << 63) - 1) // (4 * dims))
    wide = rows.filter(F.octet_length("x") > 2 * dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([int(np.abs(vectors.matrix(b.column(0), dims)).max())])], names=["most"])

    found = wide.select("x").mapInArrow(run, "most bigint").agg(F.max("most")).first()[0] or 0
    if max(found, 1 << 15) > most:
        raise ValueError(f"integers up to {found} in {dims} components: squared distances could leave 64 bits")


def compress(table: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(key, label, code, error) of the vectors of ``table``, and the codebooks."""
    if entries > 256:
        raise ValueError("a code has one byte a part: at most 256 entries")
    rows = common.checkpointed(vectors.integers(table, vector, [key, label], scale))
    dims = vectors.commonest(rows)
    rows = rows.filter(F.col("dims") == dims)
    if not dims:
        return rows.select(key, label, F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), None
    exact_range(rows, dims)
    books = train(rows, key, dims, parts=parts, entries=entries, rounds=rounds)
    return encode(rows, books, [key, label]), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(common.table(spark, sf_dir, "embeddings"))
    coded = common.checkpointed(coded)
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    told = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return told.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))
