"""N-gram Jaccard join: documents whose sets of word shingles overlap by ``threshold`` or more, and their components.

1. Each document becomes its set of shingle hashes, a parity bitmap of it (as many bits as shingles, or
   more) and a key of the set. Equal sets are one class; one representative of each class is compared.
2. Two sets that overlap enough share one of their first few shingles in any fixed order. Frequent shingles
   come last in that order, so common passages do not bring unlike documents together. Shingle by shingle
   the documents meet in tiles, banded by size: only sizes that allow the threshold are paired, and only where
   enough of both sets lies behind the shingle, which holds at the first one that two such sets share.
3. In a small tile pairs are listed once, and the bit counts of their bitmaps bound the overlap from above.
   What passes forms groups around the least document that it leads to. To a larger tile each document sends its
   bitmap, and what these leave connected is a group by its least document, so that the tiles of one cluster meet
   in one; so documents of one common passage cost a bitmap each and no pairs. A tile of more than ``BLOCK``
   documents is cut into blocks by size, and each pair of blocks is compared. A group is compared where its bitmaps
   and sorted arrays are: pairs that are connected already are skipped, then bounded by bit counts, then
   intersected exactly. It returns a spanning forest, never all pairs. Only texts that a group asks for are sent.
   Shingles that, by the counts of all documents, more than ``BLOCK`` documents have are crowded and never meet in
   one task. Representatives that share one follow the least document of it. They are compared in hashed blocks,
   each with the least document of its band of sizes, which connects a cluster of near copies in linear work. Only what
   is then outside the largest component of the followers is compared with all of them, in pairs of blocks.
4. Components of the links, by alternating star contractions; a node of very many links is never one task's.

The order of step 2 only affects speed; the result is exact for any order.

Cases: null, empty and blank texts have no shingles and are linked with nothing; texts of fewer words than
a shingle have one; a null doc_id counts as the largest and stays null; repeated rows are one class; of rows
with equal doc_id each text stands for itself; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, repeats

SHINGLE = 4
PERCENT = 85
SMALL_TILE = 8
BLOCK = 4096
HOT_LOCAL = 3
HOT_LEAST = 24
HOT_SHARE = 1e-4
HUB = 10_000
HUB_SHARE = 1e-4
FLUSH_TOKENS = 200_000
PAGE_BITS = 1 << 19
FILTER_BITS = 1 << 28

_TOKEN = np.dtype([("token", "<u8"), ("doc", "<i8"), ("check", "<u4"), ("n", "<i4"), ("at", "<i4")])
_PAIR = np.dtype([("doc", "<i8"), ("check", "<u4"), ("doc2", "<i8"), ("check2", "<u4")])
_HEAD = np.dtype([("group", "<u8"), ("doc", "<i8"), ("check", "<u4"), ("n", "<i4"), ("side", "u1")])
TOKENS, PAIRS, ASKED, ARRAYS, CROWDED = 0, 1, 2, 3, 4
#: What tiles give. The last two are place and check of the other document, group and side, or token and size.
TILED = "kind int, place bigint, check bigint, x bigint, y bigint"
LINKS = "doc bigint, check bigint, doc2 bigint, check2 bigint"
_SHORT = np.uint64((1 << 48) - 1)
LEFT, RIGHT, ALL = 0, 1, 2


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row and its sorted distinct shingle hashes; rows without words are left out."""
    for i, j, data, offsets in common.text_slices(texts):
        data = common.LOWER[data]
        ws, we, first = common.word_bounds(data, offsets)
        words = common.word_hashes(data, ws, we)
        grams = common.shingle_hashes(words, k)
        for d in range(i, j):
            a, z = int(first[d - i]), int(first[d - i + 1])
            if z - a >= k:
                yield d, np.unique(grams[a : z - k + 1])
            elif z > a:
                yield d, common.shingle_hashes(words[a:z], z - a)


def set_key(s: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return np.array([common.mix(s).sum(), common.mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum() + np.uint64(len(s))], dtype=np.uint64).tobytes()


def bitmap(values: np.ndarray) -> np.ndarray:
    """Parities of the shingles by bit, in 64-bit words: a power of two, at least as many bits as shingles."""
    words = max(1, 1 << max(0, (len(values) - 1).bit_length() - 6))
    bit = values % np.uint64(words * 64)
    odd = np.bincount(bit.astype(np.int64), minlength=words * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(b: np.ndarray, words: int) -> np.ndarray:
    while b.shape[-1] > words:
        half = b.shape[-1] // 2
        b = b[..., :half] ^ b[..., half:]
    return b


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap of sets of these sizes for the threshold."""
    return -((-percent * (a + b)) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -((-percent * n) // 100) + 1


class _Filter:
    """A bit for the hash of each document of ``found`` (place, check); documents without a bit are surely not among them.

    Sixteen bits a document, up to ``FILTER_BITS``: a larger table only lets more documents pass that are none of it.
    """

    def __init__(self, found: DataFrame) -> None:
        count = found.count()
        self.bits = min(FILTER_BITS, max(PAGE_BITS, 1 << (16 * count).bit_length()))
        slot = F.pmod(self.hashed(), F.lit(self.bits))
        slots = found.select(F.shiftright(slot, PAGE_BITS.bit_length() - 1).cast("int").alias("page"), slot.bitwiseAND(PAGE_BITS - 1).cast("int").alias("at"))
        self.held = np.zeros(self.bits // 8, dtype=np.uint8)
        size = PAGE_BITS // 8
        for r in slots.repartition("page").mapInArrow(self._pages, "page int, held binary").toLocalIterator():
            self.held[r.page * size : (r.page + 1) * size] = np.frombuffer(r.held, dtype=np.uint8)
        self.shared = found.sparkSession.sparkContext.broadcast((self.bits, self.held))

    @staticmethod
    def hashed() -> Column:
        return F.xxhash64("place", "check")

    @staticmethod
    def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            page, at = (np.asarray(b.column(i)) for i in (0, 1))
            for p in np.unique(page).tolist():
                held.setdefault(p, np.zeros(PAGE_BITS, dtype=bool))[at[page == p]] = True
        for p, on in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], names=["page", "held"])

    @staticmethod
    def passed(shared, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The rows that may be among the documents; their last column is ``hashed``."""
        bits, held = shared.value
        slot = np.asarray(batch.column(batch.num_columns - 1)).view(np.uint64) & np.uint64(bits - 1)
        return batch.filter(pa.array(held[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1))


def _passing(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _Filter.passed(shared, b).select(["place", "check", "text"])

    return common.trimmed(run)


def _describe(k: int) -> Callable:
    """(doc_id, place, check, text) to sizes, set keys and bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.zeros(b.num_rows, dtype=np.int64)
            key: list[bytes | None] = [None] * b.num_rows
            bits: list[bytes | None] = [None] * b.num_rows
            for d, s in shingle_sets(b.column(3), k):
                n[d] = len(s)
                key[d], bits[d] = set_key(s), bitmap(s).tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n), pa.array(key, pa.binary()), pa.array(bits, pa.binary())], names=["doc_id", "place", "check", "n", "key", "bits"])

    return common.trimmed(run)


def _frequent(k: int) -> Callable:
    """Shingles that are in several documents of one stretch, with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= HOT_LOCAL
            return pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(n[often])], names=["shingle", "n"])

        for b in batches:
            for _, s in shingle_sets(b.column(0), k):
                held.append(s)
                count += len(s)
                if count >= 4 * FLUSH_TOKENS:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    return common.trimmed(run)


class Order:
    """Shingles in the order of the prefix: rare ones by hash, then the frequent ones, rarer first; ``crowded`` are those of more than ``block`` documents."""

    def __init__(self, frequent: list[tuple[int, int]], block: int) -> None:
        self.crowded = np.unique(np.array([x[0] for x in frequent if x[1] > block], dtype=np.int64).view(np.uint64) & _SHORT)
        h = np.array([x[0] for x in frequent], dtype=np.int64).view(np.uint64)
        rank = np.empty(len(h), dtype=np.uint64)
        rank[np.lexsort((h, [x[1] for x in frequent]))] = np.arange(len(h), dtype=np.uint64)
        by = np.argsort(h)
        self.h, self.rank = h[by], rank[by]

    def first(self, s: np.ndarray, m: int) -> np.ndarray:
        if not len(self.h):
            return s[:m]
        at = np.minimum(np.searchsorted(self.h, s), len(self.h) - 1)
        hot = self.h[at] == s
        rare = s[~hot]
        if len(rare) >= m:
            return rare[:m]
        mine = np.flatnonzero(hot)
        return np.concatenate((rare, s[mine[np.argsort(self.rank[at[mine]])][: m - len(rare)]]))


def _prefixes(order, reps, k: int, percent: int, buckets: int) -> Callable:
    """(place, check, text, hash) to blobs of prefix shingles of what passes the filter ``reps``; of equal sets in a flush only the first is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks: Order = order.value
        out, held, count, seen = repeats._Outbox(buckets), [], 0, set()

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held)
            if len(ranks.crowded):
                apart = ranks.crowded[np.minimum(np.searchsorted(ranks.crowded, rows["token"]), len(ranks.crowded) - 1)] == rows["token"]
                out.put(CROWDED, repeats.by_document(rows[apart]), rows[apart])
                rows = rows[~apart]
            out.put(TOKENS, rows["token"], rows)
            return out.take()

        for b in batches:
            b = _Filter.passed(reps, b)
            place, check = (np.asarray(b.column(i)) for i in (0, 1))
            for d, s in shingle_sets(b.column(2), k):
                key = set_key(s)
                if key in seen:
                    continue
                seen.add(key)
                first = ranks.first(s, prefix_length(len(s), percent))
                rows = np.empty(len(first), dtype=_TOKEN)
                rows["token"], rows["doc"], rows["check"], rows["n"], rows["at"] = first & _SHORT, place[d], check[d], len(s), np.arange(len(first))
                held.append(rows)
                count += len(rows)
                if count >= FLUSH_TOKENS:
                    yield flush()
                    held, count, seen = [], 0, set()
        if held:
            yield flush()

    return common.trimmed(run)


def has_partner(n: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """Of members of a tile, ordered by size, with the places of its shingle in them: whether enough of the set lies behind that for any other member."""
    low = np.searchsorted(100 * n, percent * n)  # the smallest set that is large enough, and if that is the set itself, the next one
    i = np.arange(len(n))
    other = np.where(low < i, low, np.minimum(i + 1, len(n) - 1))
    return (other != i) & (percent * n[other] <= 100 * n) & (n - at >= needed(n, n[other], percent))


def _rows(kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ``TILED``."""
    for i in range(0, len(columns[0]), 100_000):
        part = [np.ascontiguousarray(c[i : i + 100_000]).astype(np.int64, copy=False) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind, dtype=np.int32)), *map(pa.array, part)], names=["kind", "place", "check", "x", "y"])


def _tiles(percent: int, small: int, block: int) -> Callable:
    """Blobs of prefix shingles to listed pairs of small tiles and to memberships in larger ones or in pairs of their blocks (``TILED``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            for kind, body in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                rows = repeats.unpack(body.as_py(), _TOKEN)
                if kind == TOKENS:
                    held.append(rows)
                else:
                    yield from _rows(CROWDED, rows["doc"], rows["check"], rows["token"], rows["n"])
        if not held:
            return
        rows = np.concatenate(held)
        del held
        rows = rows[np.argsort(rows["token"])]
        same = np.zeros(len(rows), dtype=bool)
        same[1:] = rows["token"][1:] == rows["token"][:-1]
        same[:-1] |= same[1:].copy()
        rows = rows[same]
        rows = rows[np.lexsort((rows["at"], rows["check"], rows["doc"], rows["n"], rows["token"]))]
        if not len(rows):
            return
        rows = rows[np.concatenate(([True], rows[1:] != rows[:-1]))]  # repeated rows
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(rows["token"]) != 0) + 1, [len(rows)]))
        pairs, asked = [], []
        # small tiles: neighbours at each distance, all tiles at once
        size = np.diff(cuts)
        ends = np.repeat(cuts[1:], size)
        is_small = np.repeat(size <= small, size)
        at = np.flatnonzero(is_small)
        for step in range(1, small):
            at = at[at + step < ends[at]]
            at = at[percent * rows["n"][at + step].astype(np.int64) <= 100 * rows["n"][at].astype(np.int64)]  # ordered by size: further ones are larger
            if not len(at):
                break
            x, y = rows[at], rows[at + step]
            met = np.minimum(x["n"] - x["at"], y["n"] - y["at"]) >= needed(x["n"].astype(np.int64), y["n"].astype(np.int64), percent)
            x, y = x[met], y[met]
            p = np.empty(len(x), dtype=_PAIR)
            for n in ("doc", "check"):
                p[n], p[f"{n}2"] = x[n], y[n]
            swap = (p["doc"] > p["doc2"]) | ((p["doc"] == p["doc2"]) & (p["check"] > p["check2"]))
            p[swap] = np.rec.fromarrays([p["doc2"][swap], p["check2"][swap], p["doc"][swap], p["check"][swap]], dtype=_PAIR)
            pairs.append(p)
        if pairs:
            p = np.unique(np.concatenate(pairs))
            p = p[(p["doc"] != p["doc2"]) | (p["check"] != p["check2"])]
            yield from _rows(PAIRS, *(p[n] for n in _PAIR.names))
        for t in np.flatnonzero(size > small):
            tile = rows[cuts[t] : cuts[t + 1]]
            tile = tile[has_partner(tile["n"].astype(np.int64), tile["at"], percent)]
            if len(tile) < 2:
                continue
            number = np.arange(len(tile)) // block
            token = int(tile["token"][0])
            for i in range(int(number[-1]) + 1):
                for j in range(i, int(number[-1]) + 1):
                    low, high = tile[number == i], tile[number == j]
                    if percent * int(high["n"][0]) > 100 * int(low["n"][-1]):
                        break
                    group = int(common.mix(np.array([token ^ (i << 52) ^ (j << 40)], dtype=np.uint64))[0])
                    for side, part in ((ALL, low),) if i == j else ((LEFT, low), (RIGHT, high)):
                        asked.append((part["doc"], part["check"], np.full(len(part), group, dtype=np.uint64).view(np.int64), np.full(len(part), side)))
        if asked:
            yield from _rows(ASKED, *map(np.concatenate, zip(*asked, strict=True)))

    return common.trimmed(run)


def _bounded(percent: int) -> Callable:
    """Pairs with both bitmaps to those that the bit counts allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, n2 = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("n", "n2"))
            keep = np.zeros(b.num_rows, dtype=bool)
            bits, bits2 = (b.column(b.schema.get_field_index(c)) for c in ("bits", "bits2"))
            for i in range(b.num_rows):
                x, y = np.frombuffer(bits[i].as_py(), dtype="<u8"), np.frombuffer(bits2[i].as_py(), dtype="<u8")
                words = min(len(x), len(y))
                differ = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
                keep[i] = (n[i] + n2[i] - differ) // 2 >= needed(int(n[i]), int(n2[i]), percent)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in _PAIR.names], names=list(_PAIR.names)).filter(pa.array(keep))

    return common.trimmed(run)


class _Shipment:
    """Arrays of documents on their way to groups."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.held, self.size = buckets, [], 0

    def add(self, asked: pa.ListScalar, doc: int, check: int, n: int, array: np.ndarray) -> bool:
        """One document's array for its memberships (group, side); whether it is time to ``take``."""
        group, side = asked.values.flatten()
        heads = np.empty(len(group), dtype=_HEAD)
        heads["group"], heads["side"], heads["doc"], heads["check"], heads["n"] = np.asarray(group).view(np.uint64), np.asarray(side), doc, check, n
        self.held.append((heads, array))
        self.size += array.nbytes + heads.nbytes
        return self.size >= 4 << 20

    def take(self) -> pa.RecordBatch:
        out = repeats._Outbox(self.buckets)
        by: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for heads, s in self.held:
            bucket = (common.mix(heads["group"].copy()) % np.uint64(self.buckets)).astype(np.int64)
            for b in np.unique(bucket).tolist():
                by.setdefault(b, []).append((heads[bucket == b], s))
        for b, parts in by.items():  # an array once for each bucket, however many of its groups are there
            heads = np.concatenate([h for h, _ in parts])
            which = np.repeat(np.arange(len(parts), dtype=np.int32), [len(h) for h, _ in parts])
            sizes = np.array([len(s) for _, s in parts], dtype=np.int32)
            body = [repeats.pack(heads), repeats.zstandard.compress(which.tobytes(), 1), repeats.zstandard.compress(sizes.tobytes(), 1), repeats.zstandard.compress(b"".join(s.tobytes() for _, s in parts), 1)]
            out.rows.append((b, ARRAYS, b"".join(len(x).to_bytes(4, "little") + x for x in body)))
        self.held, self.size = [], 0
        return out.take()


def _arrived(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """The groups of a shipment, each with its members' heads, ordered by size, and their arrays."""
    heads, places, arrays = [], [], []
    for b in batches:
        for x in b.column(2):
            body, at, parts = x.as_py(), 0, []
            for _ in range(4):
                size = int.from_bytes(body[at : at + 4], "little")
                parts.append(body[at + 4 : at + 4 + size])
                at += 4 + size
            h = repeats.unpack(parts[0], _HEAD)
            which, sizes = (np.frombuffer(repeats.zstandard.decompress(p), dtype="<i4") for p in parts[1:3])
            flat = np.frombuffer(repeats.zstandard.decompress(parts[3]), dtype="<u8")
            heads.append(h)
            places.append(which + len(arrays))
            arrays += np.split(flat, np.cumsum(sizes)[:-1])
    if not heads:
        return
    h, at = np.concatenate(heads), np.concatenate(places)
    order = np.lexsort((h["side"], h["check"], h["doc"], h["n"], h["group"]))
    h, at = h[order], at[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(h["group"]) != 0) + 1, [len(h)]))
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if z - a > 1:
            yield h[a:z], [arrays[x] for x in at[a:z]]


def _bitmaps(buckets: int) -> Callable:
    """(place, check, n, bits, memberships) to the bitmaps for each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _Shipment(buckets)
        for b in batches:
            place, check, n = (np.asarray(b.column(i)) for i in range(3))
            for d in range(b.num_rows):
                if sent.add(b.column(4)[d], place[d], check[d], n[d], np.frombuffer(b.column(3)[d].as_py(), dtype="<u8")):
                    yield sent.take()
        if sent.held:
            yield sent.take()

    return common.trimmed(run)


def _arrays(k: int, buckets: int) -> Callable:
    """(place, check, text, memberships) to the shingle arrays for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _Shipment(buckets)
        for b in batches:
            place, check = (np.asarray(b.column(i)) for i in (0, 1))
            for d, s in shingle_sets(b.column(2), k):
                if sent.add(b.column(3)[d], place[d], check[d], len(s), s):
                    yield sent.take()
        if sent.held:
            yield sent.take()

    return common.trimmed(run)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))


def linked_in_tile(n: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between members; with two sides only across them."""
    words = 1 << max(0, (int(n.max()) - 1).bit_length() - 6)
    words = max(1, min(words, *(len(bitmap(s)) for s in (sets[int(np.argmin(n))],))))
    bits = np.stack([folded(bitmap(s), words) for s in sets])
    label = np.arange(len(n))
    n = n.astype(np.int64)
    for i in range(len(n)):
        other = np.flatnonzero(label != label[i])
        other = other[(other > i) & (percent * np.maximum(n[other], n[i]) <= 100 * np.minimum(n[other], n[i]))]
        if side[i] != ALL:
            other = other[side[other] != side[i]]
        if not len(other):
            continue
        differ = np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1, dtype=np.int64)
        need = needed(n[other], n[i], percent)
        for j, least in zip(other[(n[other] + n[i] - differ) // 2 >= need].tolist(), need[(n[other] + n[i] - differ) // 2 >= need].tolist(), strict=True):
            if label[j] != label[i] and overlap(sets[i], sets[j]) >= least:
                yield i, j
                label[label == label[j]] = label[i]


def alike(n: np.ndarray, bits: list[np.ndarray], side: np.ndarray, percent: int) -> np.ndarray:
    """Labels of members, ordered by size: one for all that pairs connect whose bit counts allow the threshold; with two sides only across them."""
    n, label, width = n.astype(np.int64), np.arange(len(n)), np.array([len(b) for b in bits])
    ends = np.searchsorted(percent * n, 100 * n, "right")  # behind the largest set that is small enough
    for w in np.unique(width).tolist():  # these grow with the sizes
        a, m = np.searchsorted(width, w), np.searchsorted(width, w, "right")
        flat = np.stack([folded(b, w) for b in bits[a : ends[m - 1]]])
        for i in range(a, m):
            other = i + 1 + np.flatnonzero(label[i + 1 : ends[i]] != label[i])
            if side[i] != ALL:
                other = other[side[other] != side[i]]
            if len(other):
                differ = np.bitwise_count(flat[other - a] ^ flat[i - a]).sum(axis=1, dtype=np.int64)
                other = other[(n[other] + n[i] - differ) // 2 >= needed(n[other], n[i], percent)]
            if len(other):
                label[np.isin(label, label[other])] = label[i]
    return label


def _near(percent: int) -> Callable:
    """Bitmaps by tile to documents and the least ones (x, y) of those that they leave connected with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for h, bits in _arrived(batches):
            label = alike(h["n"], bits, h["side"], percent)
            order = np.lexsort((h["check"], h["doc"], label))
            h, label = h[order], label[order]
            opens = np.concatenate(([True], label[1:] != label[:-1]))
            least = np.flatnonzero(opens)[np.cumsum(opens) - 1]
            joined = np.bincount(label)[label] > 1
            found.append([c[joined] for c in (h["doc"], h["check"], h["doc"][least], h["check"][least])])
        if found:
            yield from _rows(ASKED, *map(np.concatenate, zip(*found, strict=True)))

    return common.trimmed(run)


def _verify(percent: int) -> Callable:
    """Arrays by group to exact links (place, check, place2, check2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, arrays in _arrived(batches):
            links = list(linked_in_tile(h["n"], arrays, h["side"], percent))
            if links:
                i, j = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).astype(np.int64)) for c in (h["doc"][i], h["check"][i], h["doc"][j], h["check"][j])], names=list(_PAIR.names))

    return common.trimmed(run)


def _with_least(edges: DataFrame, least: DataFrame, hub: float) -> DataFrame:
    """``edges`` (u, v) with ``m`` of their u, from ``least`` (u, m, n), n being how many edges u has.

    Nodes of more than ``hub`` edges are broadcast, so that the edges of one never meet in a task.
    """
    hubs = least.filter(F.col("n") > hub).select("u", "m")
    if hubs.isEmpty():
        return edges.join(least.select("u", "m"), "u")
    marked = edges.join(F.broadcast(hubs), "u", "left")
    others = marked.filter("m is null").drop("m").join(least.filter(F.col("n") <= hub).select("u", "m"), "u")
    return marked.filter("m is not null").unionByName(others)


def components(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """(node, root) of every node in ``edges`` (u, v), the root being its component's least node.

    Large and small stars in turn until nothing changes; each is kept in the shared folder. Nodes of more than ``hub`` edges
    and ``HUB_SHARE`` of all, of which there are at most 1 / ``HUB_SHARE``, are joined by broadcast.
    """
    state = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    e = common.checkpointed(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = state(e)
    while mark[0]:
        over = max(hub, 2 * HUB_SHARE * mark[0])
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.checkpointed(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = common.checkpointed(_with_least(both.filter("v > u"), least, over).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        least = common.checkpointed(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        small = _with_least(large, least, over)
        e = common.checkpointed(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = state(e)
        if now == mark:
            break
        mark = now
    return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")


def around(members: DataFrame) -> DataFrame:
    """Memberships of documents (place, check) in the groups around others (x, y)."""
    return members.select("place", "check", F.xxhash64("x", "y").alias("group"), F.lit(ALL).alias("side"))


class _Comparison:
    """Exact comparison in groups: memberships (place, check, group, side) to links."""

    def __init__(self, rows: DataFrame, shingle: int, percent: int, parts: int) -> None:
        self.rows, self.shingle, self.percent, self.parts = rows, shingle, percent, parts

    @staticmethod
    def gathered(asked: DataFrame) -> DataFrame:
        """Memberships by document."""
        return asked.groupBy("place", "check").agg(F.collect_set(F.struct("group", "side")).alias("asked"))

    def near(self, asked: DataFrame, sized: DataFrame) -> DataFrame:
        """Memberships in tiles, with the bitmaps of ``sized`` (place, check, n, bits), to memberships around documents."""
        sent = sized.join(self.gathered(asked), ["place", "check"]).select("place", "check", "n", "bits", "asked").mapInArrow(_bitmaps(self.parts), repeats.BLOB_SCHEMA)
        return around(sent.repartition(self.parts, "bucket").mapInArrow(_near(self.percent), TILED))

    def links(self, asked: DataFrame) -> DataFrame:
        gathered = common.checkpointed(self.gathered(asked))
        texts = self.rows.select("place", "check", "text", _Filter.hashed()).mapInArrow(_passing(_Filter(gathered).shared), "place bigint, check bigint, text string")
        arrays = texts.join(gathered, ["place", "check"]).select("place", "check", "text", "asked").mapInArrow(_arrays(self.shingle, self.parts), repeats.BLOB_SCHEMA)
        return arrays.repartition(self.parts, "bucket").mapInArrow(_verify(self.percent), LINKS)


class _Crowd:
    """Representatives that share crowded shingles, from ``shared`` (token, place, check, n)."""

    def __init__(self, shared: DataFrame, percent: int, block: int) -> None:
        lead = shared.groupBy("token").agg(F.min(F.struct("place", "check")).alias("lead"))
        # sets alike enough are in one band or in neighbouring ones; the factor covers rounding
        band = F.floor(F.log("n") / (1.000001 * math.log(100 / percent))).cast("int")
        self.followers = common.checkpointed(shared.join(lead, "token").select("lead", "place", "check", band.alias("band")).distinct())
        self.block = block

    @staticmethod
    def _group(*parts) -> Column:
        return F.xxhash64("lead.place", "lead.check", *parts).alias("group")

    @staticmethod
    def _part(first: str, second: str, n: str) -> Column:
        return F.pmod(F.xxhash64(first, second), F.col(n))

    @staticmethod
    def _each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    _near = staticmethod(lambda: F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("at"))

    def blocks(self) -> DataFrame:
        """Memberships in blocks, each with the least documents of its band and of the neighbouring ones."""
        sizes = self.followers.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / self.block).alias("blocks"))
        own = self.followers.join(sizes, "lead").select("place", "check", self._group(F.lit(1), "band", self._part("place", "check", "blocks")), F.lit(ALL).alias("side"))
        least = self.followers.groupBy("lead", "band").agg(F.min(F.struct("place", "check")).alias("least")).join(sizes, "lead")
        least = least.select("lead", "least", "blocks", self._near()).select("lead", "least", "at", self._each("blocks").alias("b"))
        return own.unionByName(least.select("least.place", "least.check", self._group(F.lit(1), "at", "b"), F.lit(ALL).alias("side")))

    def rest(self, linked: DataFrame) -> DataFrame | None:
        """Given the components of the links so far: memberships that bring what is outside a lead's largest component
        together with all its followers; None where nothing is."""
        node = F.struct("place", "check")
        rooted = self.followers.withColumn("node", node).join(linked, "node", "left").select("lead", "place", "check", "band", F.coalesce("root", "node").alias("root"))
        rooted = common.checkpointed(rooted)
        counted = rooted.groupBy("lead", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("lead").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("most"))
        outside = F.col("all") - F.col("most.n")
        left_open = common.checkpointed(counted.filter(outside > 0).select("lead", F.col("most.root").alias("major"), F.ceil(F.col("all") / self.block).alias("blocks"), F.ceil(outside / self.block).alias("outer")))
        if left_open.isEmpty():
            return None
        every = rooted.join(left_open, "lead")
        right = every.select("lead", "place", "check", "band", self._part("place", "check", "blocks").alias("b"), self._each("outer").alias("r"))
        right = right.select("place", "check", self._group(F.lit(2), "band", "b", "r"), F.lit(RIGHT).alias("side"))
        left = every.filter("root <> major").select("lead", "place", "check", "blocks", self._part("check", "place", "outer").alias("r"), self._near())
        left = left.select("lead", "place", "check", "r", "at", self._each("blocks").alias("b"))
        return left.select("place", "check", self._group(F.lit(2), "at", "b", "r"), F.lit(LEFT).alias("side")).unionByName(right)


def join_documents(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, small_tile: int = SMALL_TILE, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (least doc_id of its component) and ``first``.

    ``first`` is true for one row of each component: the least by doc_id, then by checksum of the text;
    repeated rows are all first or none.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    parts = common.partitions(docs)
    rows = repeats.keyed(docs)
    told = common.checkpointed(rows.mapInArrow(_describe(shingle), "doc_id bigint, place bigint, check bigint, n bigint, key binary, bits binary"))
    node = F.struct("place", "check")
    # kept on its own, so that the join below has shuffles on both sides, which Spark can split where a key is hot
    classes = common.checkpointed(told.filter("n > 0").groupBy("key").agg(F.min(node).alias("rep")))
    # the order of shingles
    least = max(HOT_LEAST, HOT_SHARE * told.count())
    frequent = rows.select("text").mapInArrow(_frequent(shingle), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    order = spark.sparkContext.broadcast(Order([(r.shingle, r.n) for r in frequent.collect()], block))  # at most shingles a document / HOT_SHARE
    reps = _Filter(classes.select("rep.place", "rep.check"))
    cut = rows.select("place", "check", "text", _Filter.hashed()).mapInArrow(_prefixes(order, reps.shared, shingle, percent, parts), repeats.BLOB_SCHEMA)
    tiled = common.checkpointed(cut.repartition(parts, "bucket").mapInArrow(_tiles(percent, small_tile, block), TILED))
    pairs = tiled.filter(F.col("kind") == PAIRS).select(F.col("place").alias("doc"), "check", F.col("x").alias("doc2"), F.col("y").alias("check2")).distinct()
    # representatives and bitmaps of both sides
    named = told.filter("n > 0").join(classes, "key")
    rep_of = named.select(F.col("place"), F.col("check"), "rep").distinct()
    of = lambda a, b, c, d: rep_of.select(F.col("place").alias(a), F.col("check").alias(b), F.col("rep.place").alias(c), F.col("rep.check").alias(d))
    paired = pairs.join(of("doc", "check", "r", "rc"), ["doc", "check"]).join(of("doc2", "check2", "r2", "rc2"), ["doc2", "check2"])
    paired = paired.select(F.least(F.struct("r", "rc"), F.struct(F.col("r2").alias("r"), F.col("rc2").alias("rc"))).alias("a"), F.greatest(F.struct("r", "rc"), F.struct(F.col("r2").alias("r"), F.col("rc2").alias("rc"))).alias("b")).filter("a <> b").distinct()
    sized = told.filter("n > 0").select("place", "check", "n", "bits").dropDuplicates(["place", "check"])
    bits = lambda *names: sized.select(*(F.col(c).alias(x) for c, x in zip(("place", "check", "n", "bits"), names, strict=True)))
    with_bits = paired.select(F.col("a.r").alias("doc"), F.col("a.rc").alias("check"), F.col("b.r").alias("doc2"), F.col("b.rc").alias("check2")).join(bits("doc", "check", "n", "bits"), ["doc", "check"]).join(bits("doc2", "check2", "n2", "bits2"), ["doc2", "check2"])
    left = with_bits.mapInArrow(_bounded(percent), LINKS)
    left = common.checkpointed(left.select(F.struct(F.col("doc").alias("place"), "check").alias("a"), F.struct(F.col("doc2").alias("place"), F.col("check2").alias("check")).alias("b")))
    # exact comparison: both documents of a pair go to the least document that the first is paired with
    least_of = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("to"))
    members = left.join(least_of, "a")
    members = members.select(F.col("a").alias("m"), "to").unionByName(members.select(F.col("b").alias("m"), "to")).distinct()
    compare = _Comparison(rows, shingle, percent, parts)
    asked = around(members.select("m.place", "m.check", F.col("to.place").alias("x"), F.col("to.check").alias("y")))
    asked = asked.unionByName(compare.near(tiled.filter(F.col("kind") == ASKED).select("place", "check", F.col("x").alias("group"), F.col("y").cast("int").alias("side")), sized))
    crowd = None
    if len(order.value.crowded):
        shared = tiled.filter(F.col("kind") == CROWDED).select(F.col("x").alias("token"), F.col("place").alias("doc"), "check", F.col("y").alias("n"))
        shared = shared.join(of("doc", "check", "r", "rc"), ["doc", "check"]).select("token", F.col("r").alias("place"), F.col("rc").alias("check"), "n").distinct()
        crowd = _Crowd(shared, percent, block)
        asked = asked.unionByName(crowd.blocks())
    # components over representatives, so that copies add no links; members of larger tiles are named by theirs
    at = lambda a, b: F.struct(F.col(a).alias("place"), F.col(b).alias("check"))
    edges = lambda links: links.join(of("doc", "check", "r", "rc"), ["doc", "check"]).join(of("doc2", "check2", "r2", "rc2"), ["doc2", "check2"]).select(at("r", "rc").alias("u"), at("r2", "rc2").alias("v"))
    linked = components(edges(compare.links(asked)))
    if crowd and (rest := crowd.rest(linked)) is not None:
        linked = components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(edges(compare.links(rest))))
    rooted = classes.join(linked, classes["rep"] == linked["node"], "left").select("key", F.coalesce("root", "rep").alias("root"))
    found = told.join(rooted, "key", "left")
    root = F.coalesce("root", node)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(root["place"] == common.NULL_ID, F.lit(None)).otherwise(root["place"]).alias("component_id"), (root == node).alias("first"), "place", "check")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each component stays: the first of ``join_documents``."""
    first = join_documents(docs, **options).filter("first").select(F.col("place").alias("_p"), F.col("check").alias("_c")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(common.NULL_ID)).alias("_p"), F.xxhash64(text).bitwiseAND(0xFFFFFFFF).alias("_c"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    return rows.join(first, ["_p", "_c"], "left_semi").groupBy("_p", "_c").agg(F.first("_row").alias("_row")).select("_row.*")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(common.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
