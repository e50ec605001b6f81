"""Near-duplicates by SimHash: fingerprints at two or fewer differing bits are linked, found by covering locality-sensitive hashing.

A fingerprint has bit i where over half of the document's shingles have it in their XXH64. Each of the 64 bits has one of the seven
non-zero vectors over three binary places, by turns. A table belongs to each of the same seven vectors v; its mask keeps the
bits whose vector has an odd number of ones in common with v. The vectors of any two bits leave some v orthogonal to
both, whose mask ignores them: so every pair within ``RADIUS`` collides in some table, without exception.

Equal fingerprints are one class. In a table, classes of a bucket are compared pair by pair, where they are ``BUCKET`` at most. In
larger buckets two classes are within the radius exactly when some fingerprint is within one bit of both; so each class names
itself and its neighbours at one of the bits that the mask ignores, and all that name the same one, 65 at most, are linked to the
least of them. Both ways are exact, and no bucket is compared as a whole in one task.

Words are compared with A-Z lower-cased; shingles have ``SHINGLE`` words (the whole text where it has fewer), and repeated ones count each time.

Cases: null, empty and blank texts have fingerprint zero and link as any other; a null doc_id counts as the largest and
gives a null component_id only where no other is reached; rows of equal doc_id are linked by their texts alone; repeated rows
have the same result; an empty table gives an empty result; texts of any length are hashed in stretches; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .jaccard_join import components

SHINGLE = 3
SEED = 42
RADIUS = 2
BITS = 64
BUCKET = 64

_STRETCH = 1 << 16
_VECTORS = range(1, 1 << RADIUS + 1)
#: Of each table the bits that it keeps.
KEPT = [[i for i in range(BITS) if (v & (i % len(_VECTORS) + 1)).bit_count() % 2] for v in _VECTORS]


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def mask(bits: list[int]) -> int:
    return _signed(sum(1 << i for i in bits))


def shingles(data: np.ndarray, ws: np.ndarray, we: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of one document with the words ``ws`` to ``we`` of ``data``, in stretches."""
    n = max(1, len(ws) - k + 1)
    for a in range(0, n, _STRETCH):
        z = min(n, a + _STRETCH)
        low, high = ws[a : z + k - 1], we[a : z + k - 1]
        size = high - low
        ends = np.cumsum(size + 1)
        # words with one space behind each, as one text
        text = np.full(int(ends[-1]), 0x20, dtype=np.uint8)
        text[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)]
        body, begins, stops = text.tobytes(), (ends - size - 1).tolist(), (ends - 1).tolist()
        last = min(k, len(low)) - 1
        hashed = xxhash.xxh64_intdigest
        yield np.fromiter((hashed(body[s:e], SEED) for s, e in zip(begins, stops[last:], strict=False)), dtype=np.uint64, count=z - a)


def fingerprint(data: np.ndarray, ws: np.ndarray, we: np.ndarray, k: int = SHINGLE) -> int:
    if not len(ws):
        return 0
    counts, n = np.zeros(BITS, dtype=np.int64), 0
    for h in shingles(data, ws, we, k):
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, place, fp) of each row of ``docs`` (doc_id, text); ``place`` is the id, or the largest where it is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.zeros(b.num_rows, dtype=np.uint64)
            for i, j, data, offsets in common.text_slices(b.column(1)):
                data = common.LOWER[data]
                ws, we, first = common.word_bounds(data, offsets)
                for d in range(i, j):
                    a, z = int(first[d - i]), int(first[d - i + 1])
                    found[d] = fingerprint(data, ws[a:z], we[a:z], k)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(0).fill_null(common.NULL_ID), pa.array(found.view(np.int64))], names=["doc_id", "place", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(common.trimmed(run), "doc_id bigint, place bigint, fp bigint")


def links(classes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) of ``classes`` (fp, place), as structs (place, fp), that join all fingerprints within the radius, directly or by others within it."""
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(mask(kept))).alias("key")) for t, kept in enumerate(KEPT)))
    keyed = classes.select("fp", "place", F.explode(tables).alias("at")).select("at.t", "at.key", "fp", "place")
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = common.checkpointed(keyed.join(sizes, ["t", "key"]))
    node = lambda fp, place: F.struct(F.col(place).alias("place"), F.col(fp).alias("fp"))
    few = shared.filter(F.col("n") <= bucket).drop("n")
    other = few.select("t", "key", F.col("fp").alias("fp2"), F.col("place").alias("place2"))
    near = (F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS)
    pairs = few.join(other, (few["t"] == other["t"]) & (few["key"] == other["key"]) & near).select(node("fp", "place").alias("u"), node("fp2", "place2").alias("v"))
    free = F.array(*(F.array(F.lit(0).cast("bigint"), *(F.lit(mask([i])) for i in range(BITS) if i not in kept)) for kept in KEPT))
    named = shared.filter(F.col("n") > bucket).select("fp", "place", F.explode(F.element_at(free, F.col("t") + 1)).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"), node("fp", "place").alias("of"))
    around = named.groupBy("centre").agg(F.collect_set("of").alias("of")).filter(F.size("of") > 1)  # at most BITS + 1
    stars = around.select(F.array_min("of").alias("u"), F.explode("of").alias("v")).filter("u <> v")
    return pairs.unionByName(stars)


def group_documents(docs: DataFrame, *, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id (least doc_id of its component)."""
    common.small_batches(docs.sparkSession)
    told = common.checkpointed(fingerprints(docs, shingle))
    classes = common.checkpointed(told.groupBy("fp").agg(F.min("place").alias("place")))
    linked = components(links(classes, bucket))
    node = F.struct("place", "fp")
    rooted = classes.withColumn("node", node).join(linked, "node", "left").select("fp", F.coalesce("root", "node")["place"].alias("root"))
    root = F.when(F.col("root") != common.NULL_ID, F.col("root"))
    return told.join(rooted, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), root.alias("component_id"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_documents(common.documents(spark, sf_dir))
