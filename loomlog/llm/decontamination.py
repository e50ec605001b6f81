"""Benchmark decontamination by spaced seeds.

Words are compared with A-Z lower-cased. Fixed masks pick seven of up to eleven neighbouring words; the hash of
the picked words is a seed. Wherever two words of eleven are substituted, one mask still fits between them, so every
stretch that the rule below calls a leak has a seed in each of its windows. Items of fewer words have masks of their own
length, which ignore any words that the rule lets be substituted. Seeds of the documents are looked up among those of the benchmark, and around
each hit the document and the item are laid side by side: a stretch of ``MIN_WORDS`` words (the whole item
where it is shorter) with at least ``MIN_IDENTITY`` of its words equal is a leak, whatever words were substituted.

The benchmark is a query set against all rows: it is taken in blocks of at most ``BLOCK_BYTES`` of text,
each broadcast once and matched in one scan of the documents.

Cases: null or blank texts and items match nothing; null ids are kept; repeated rows give repeated
findings; items of fewer than ``MIN_WORDS`` words are sought whole; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed masks; 1: the word counts, 0: it is ignored. Together they fit around any two words of ``SPAN``.
MASKS = ("11101111", "110111011", "1111010011", "11000011111", "111110101", "10101001111", "10011110011")
SPAN = max(map(len, MASKS))
MIN_WORDS = 13
MIN_IDENTITY = 0.8
BLOCK_BYTES = 32 << 20

_FILTER_BITS = 22
SCHEMA = "doc_id bigint, item_id bigint, start_word bigint, end_word bigint, n_equal bigint"


def _words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row of a slice, hashes of its words and each row's first word."""
    for i, _, data, offsets in common.text_slices(texts):
        data = common.LOWER[data]
        ws, we, first = common.word_bounds(data, offsets)
        yield i, common.word_hashes(data, ws, we), first


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed at each word at which the mask fits into ``words``."""
    n = len(words) - len(mask) + 1
    h = np.zeros(max(n, 0), dtype=np.uint64)
    if n > 0:
        for j, c in enumerate(mask):
            if c == "1":
                h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return common.mix(h)


def least_equal(n: int) -> int:
    """How many of ``n`` words have to be equal."""
    return math.ceil(MIN_IDENTITY * n)


def short_masks(n: int) -> list[str]:
    """Masks for items of ``n`` words: two blocks more than words may be substituted, of which each mask ignores as many as that.

    Substituted words lie in no more blocks than that, so one mask ignores all of them.
    """
    spare = n - least_equal(n)
    block = np.arange(n) * (spare + 2) // n
    return ["".join("01"[b not in ignored] for b in block) for ignored in itertools.combinations(range(spare + 2), spare)] if spare else ["1" * n]


class Benchmark:
    """Words of one block of items and a sorted table of their seeds for each mask."""

    def __init__(self, ids: list[int | None], texts: list[str | None]) -> None:
        self.ids, self.items = ids, []
        for _, words, first in _words(pa.array(texts, pa.string())):
            self.items += [words[a:z] for a, z in zip(first[:-1], first[1:], strict=True)]
        short = sorted({len(w) for w in self.items if 0 < len(w) < SPAN})
        self.tables = []
        for mask, least, most in [*((m, SPAN, math.inf) for m in MASKS), *((m, n, n) for n in short for m in short_masks(n))]:
            mine = [(j, w) for j, w in enumerate(self.items) if least <= len(w) <= most]
            if not mine:
                continue
            found = [seeds(w, mask) for _, w in mine]
            h = np.concatenate(found)
            item = np.repeat([j for j, _ in mine], [len(f) for f in found])
            at = np.concatenate([np.arange(len(f)) for f in found])
            order = np.argsort(h, kind="stable")
            known = np.zeros(1 << _FILTER_BITS, dtype=bool)
            known[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.tables.append((mask, h[order], item[order], at[order], known))

    def leaks(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document of the slice, item, first word, end, equal words) of each leak."""
        found: set[tuple[int, int, int]] = set()
        for mask, h, item, at, known in self.tables:
            mine = seeds(words, mask)
            some = np.flatnonzero(known[(mine >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            left = np.searchsorted(h, mine[some], "left")
            right = np.searchsorted(h, mine[some], "right")
            doc = np.searchsorted(first, some, "right") - 1
            inside = (right > left) & (some + len(mask) <= first[doc + 1])
            for p, d, a, z in zip(some[inside].tolist(), doc[inside].tolist(), left[inside].tolist(), right[inside].tolist(), strict=True):
                found.update((d, int(item[k]), p - int(at[k])) for k in range(a, z))
        for d, j, diagonal in sorted(found):
            yield from self._verified(words, int(first[d]), int(first[d + 1]), d, j, diagonal)

    def _verified(self, words: np.ndarray, begin: int, end: int, d: int, j: int, diagonal: int) -> Iterator[tuple[int, int, int, int, int]]:
        item = self.items[j]
        a, z = max(diagonal, begin), min(diagonal + len(item), end)
        equal = words[a:z] == item[a - diagonal : z - diagonal]
        w = min(MIN_WORDS, len(item))
        if len(equal) < w:
            return
        sums = np.concatenate(([0], np.cumsum(equal)))
        good = np.flatnonzero(sums[w:] - sums[:-w] >= least_equal(w))
        while len(good):
            split = np.flatnonzero(np.diff(good) > w)
            stop = split[0] + 1 if len(split) else len(good)
            s, e = int(good[0]), int(good[stop - 1]) + w
            same = np.flatnonzero(equal[s:e])
            s, e = s + int(same[0]), s + int(same[-1]) + 1
            yield d, j, a + s - begin, a + e - begin, int(sums[e] - sums[s])
            good = good[stop:]


def _blocks(benchmark: DataFrame) -> Iterator:
    """Broadcasts of the benchmark, block by block."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.length(F.trim("text")) > 0)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = math.ceil(size / BLOCK_BYTES)
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        got = part.orderBy("item_id", "text").collect()  # at most about BLOCK_BYTES of text
        yield spark.sparkContext.broadcast(Benchmark([r.item_id for r in got], [r.text for r in got]))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each stretch of a row of ``docs`` (doc_id, text) that repeats an item of ``benchmark`` (item_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for held in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known = held.value
            for b in batches:
                found: list[tuple] = []
                ids = b.column(0).to_pylist()
                for i, words, first in _words(b.column(1)):
                    found += [(ids[i + d], known.ids[j], s, e, n) for d, j, s, e, n in known.leaks(words, first)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["doc_id", "item_id", "start_word", "end_word", "n_equal"])

        found = rows.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text repeats no item of ``benchmark``, with all their columns."""
    for held in _blocks(benchmark):

        @F.pandas_udf("boolean")
        def clean(texts, held=held):
            ok = np.ones(len(texts), dtype=bool)
            for i, words, first in _words(pa.array(texts, pa.string())):
                for d, *_ in held.value.leaks(words, first):
                    ok[i + d] = False
            return type(texts)(ok)

        docs = docs.filter(clean(F.col("text").cast("string")))
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
