"""Candidate search shared by the two repeat removers: which windows of L units also start earlier.

Units are words or bytes. A window's anchor is its smallest k-gram by hash (leftmost of equals), so
equal windows have equal anchors at equal offsets. Consecutive windows with one anchor are a context.

1. Tasks cut documents into contexts and send (anchor hash, context hash, place) to the anchor's bucket.
   Equal contexts of one flush meet before the shuffle: only the earliest is sent. Crowded anchors, which a
   count over all documents finds beforehand, do not meet in one bucket: theirs is chosen by the context as well.
2. A bucket sees all contexts of an anchor. All but the earliest of equal contexts are repeats as a
   whole. An anchor with one context needs no more; where contexts differ, the earliest of each is contested.
   Of a crowded anchor the earliest of each context always is.
3. Contested contexts are fetched from their documents and go to the group of their anchor; where an anchor is crowded
   or has more than ``GROUP_BUDGET`` contexts, its windows go one by one by the hash of the whole window.
4. A group's index (suffix trees or a run-length index, see the callers) tells which windows start earlier.

A place is (doc_id, start); a null doc_id counts as the largest. Rows of equal doc_id are the same place
when their starts are equal, and neither is earlier then. Rows are told apart by doc_id and a checksum
of their text, so repeated rows get the same result.

A document of more than ``PIECE_BYTES`` is read in pieces that overlap by a window less one unit, so memory does
not follow its length. Where a context is cut does not matter: equal windows still share their anchor.

Tasks exchange blobs of packed arrays; every group of equal things is cut down to one a flush before a
shuffle, so a passage that a third of all documents hold costs one record for each flush.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FLUSH_ROWS = 200_000
PIECE_BYTES = 4 << 20
GROUP_BUDGET = 20_000
#: An anchor is crowded where it has more contexts than ``GROUP_BUDGET`` and than this share of all; so at most a million are.
CROWD_SHARE = 1e-6
CROWD_LOCAL = 3
_POSITION = np.uint64((1 << 28) - 1)

#: What travels: a record array as compressed bytes.
PLACED = np.dtype([("anchor", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("check", "<u4"), ("start", "<i4"), ("windows", "<i4")])
SPAN = np.dtype([("doc", "<i8"), ("check", "<u4"), ("start", "<i4"), ("end", "<i4")])
WANTED = np.dtype([("doc", "<i8"), ("check", "<u4"), ("start", "<i4"), ("windows", "<i4"), ("anchor", "<u8"), ("split", "?")])
BLOB_SCHEMA = "bucket int, kind int, body binary"
_BLOBS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])
SEND, REPEAT, FETCH, SPLIT = 0, 1, 2, 3


class Units(NamedTuple):
    """One slice: hash values of its units, first unit of each document (one more at the end), the units themselves."""

    values: np.ndarray
    offsets: np.ndarray
    raw: np.ndarray


Reader = Callable[[np.ndarray, np.ndarray], Units]


def word_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    ws, we, first = common.word_bounds(data, offsets)
    h = common.word_hashes(data, ws, we)
    return Units(h, first, h)


def byte_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    return Units(common.BYTE_VALUES[data], offsets, data)


def stretches(reader: Reader, data: np.ndarray, offsets: np.ndarray, length: int, piece: int) -> Iterator[tuple[Units, int]]:
    """Units of a slice, and where they start in their document; more than one stretch only for a single long document."""
    if len(offsets) > 2 or len(data) <= piece:
        yield reader(data, offsets), 0
        return
    at = base = 0
    held = Units(*(np.zeros(0, dtype=x.dtype) for x in reader(data[:0], np.zeros(2, dtype=np.int64))))
    while at < len(data):
        end = min(at + piece, len(data))
        if reader is word_units and end < len(data):  # between words
            gaps = np.flatnonzero(common.IS_SEPARATOR[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                later = np.flatnonzero(common.IS_SEPARATOR[data[end:]])
                end = end + int(later[0]) + 1 if len(later) else len(data)
        units = reader(data[at:end], np.array([0, end - at]))
        values, raw = np.concatenate((held.values, units.values)), np.concatenate((held.raw, units.raw))
        yield Units(values, np.array([0, len(values)]), raw), base
        keep = max(0, len(values) - (length - 1))
        held, base, at = Units(values[keep:], units.offsets, raw[keep:]), base + keep, end


def pack(a: np.ndarray) -> bytes:
    """Columns one after the other, compressed."""
    return zstandard.compress(len(a).to_bytes(4, "little") + b"".join(np.ascontiguousarray(a[n]).tobytes() for n in a.dtype.names), 1)


def unpack(body: bytes, dtype: np.dtype) -> np.ndarray:
    raw = zstandard.decompress(body)
    n, at = int.from_bytes(raw[:4], "little"), 4
    out = np.empty(n, dtype=dtype)
    for name in dtype.names:
        kind = dtype[name]
        out[name] = np.frombuffer(raw, dtype=kind, count=n, offset=at)
        at += n * kind.itemsize
    return out


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    p = 1
    while 2 * p <= w:
        x = np.minimum(x[:-p], x[p:])
        p *= 2
    return np.minimum(x[: len(x) - (w - p)], x[w - p :]) if p < w else x


def contexts(units: Units, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Of one slice: anchor hash, context hash, first window, number of windows, document, in document order."""
    n = len(units.values)
    none = tuple(np.zeros(0, dtype=t) for t in ("u8", "u8", "i8", "i8", "i8"))
    if n < length:
        return none
    roll = common.Rolling(units.values)
    grams = common.anchors(units.values, k)
    key = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    least = _sliding_min(key, length - k + 1)
    valid = np.ones(len(least), dtype=bool)
    for a, b in zip(units.offsets[:-1], units.offsets[1:], strict=True):
        valid[max(a, b - length + 1) : b] = False
    change = np.empty(len(least), dtype=bool)
    change[0] = True
    np.not_equal(least[1:], least[:-1], out=change[1:])
    begin = change.copy()
    begin[1:] |= ~valid[:-1]
    begin &= valid
    stop = np.ones(len(least), dtype=bool)
    stop[:-1] = change[1:] | ~valid[1:]
    stop &= valid
    first, last = np.flatnonzero(begin), np.flatnonzero(stop)
    if not len(first):
        return none
    doc = np.searchsorted(units.offsets, first, "right") - 1
    return grams[(least[first] & _POSITION).astype(np.int64)], roll.spans(first, last + length), first, last - first + 1, doc


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (may be null), place id, checksum and text of each row."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(common.NULL_ID)).alias("place"), F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(0xFFFFFFFF).alias("check"), text.alias("text"))


class _Outbox:
    """Blobs by bucket and kind."""

    def __init__(self, buckets: int) -> None:
        self.buckets = np.uint64(buckets)
        self.rows: list[tuple[int, int, bytes]] = []

    def put(self, kind: int, by: np.ndarray, rows: np.ndarray) -> None:
        if not len(rows):
            return
        bucket = (common.mix(by.astype(np.uint64)) % self.buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for part, b in zip(np.split(rows, cuts), bucket[np.concatenate(([0], cuts))], strict=True):
            self.rows.append((int(b), kind, pack(part)))

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _BLOBS.types, strict=True)], schema=_BLOBS)


def by_document(rows: np.ndarray) -> np.ndarray:
    """What spreads rows by their document; documents of one id, or without one, are told apart by their texts."""
    return rows["doc"].astype(np.uint64) ^ common.mix(rows["check"].astype(np.uint64))


def spans_of(rows: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(len(rows), dtype=SPAN)
    for n in ("doc", "check", "start"):
        out[n] = rows[n]
    out["end"] = rows["start"] + rows["windows"] + (length - 1)
    return out


def earliest(rows: np.ndarray, keys: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``rows`` ordered by keys and place, whether each opens its class, and whether it is at the earliest place of it.

    Of repeated rows, which are equal in place and text, one is left.
    """
    order = np.lexsort((rows["check"], rows["start"], rows["doc"], *(rows[k] for k in reversed(keys))))
    rows = rows[order]
    opens = np.ones(len(rows), dtype=bool)
    if len(rows) > 1:
        opens[1:] = np.logical_or.reduce([rows[k][1:] != rows[k][:-1] for k in keys])
        new = opens.copy()
        new[1:] |= np.logical_or.reduce([rows[k][1:] != rows[k][:-1] for k in ("doc", "start", "check")])
        rows, opens = rows[new], opens[new]
    head = np.flatnonzero(opens)[np.cumsum(opens) - 1]
    return rows, opens, (rows["doc"] == rows["doc"][head]) & (rows["start"] == rows["start"][head])


def _crowds(reader: Reader, length: int, k: int, piece: int) -> Callable:
    """Over (text): anchors with several contexts in a flush and how many, and with no anchor the number of all contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, total = [], 0, 0

        def flush() -> pa.RecordBatch:
            anchor, context = (np.concatenate(x) for x in zip(*held, strict=True))
            a = np.sort(anchor)
            alike = np.unique(a[1:][a[1:] == a[:-1]])  # most anchors have one context and are out here
            at = np.minimum(np.searchsorted(alike, anchor), max(len(alike) - 1, 0))
            some = alike[at] == anchor if len(alike) else np.zeros(len(anchor), dtype=bool)
            _, first = np.unique(anchor[some] ^ (context[some] * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
            a, n = np.unique(anchor[some][first], return_counts=True)
            often = n >= CROWD_LOCAL
            return pa.RecordBatch.from_arrays([pa.array(a[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["anchor", "n"])

        for b in batches:
            for _, _, data, offsets in common.text_slices(b.column(0), min(common.SLICE_BYTES, piece)):
                for units, _ in stretches(reader, data, offsets, length, piece):
                    anchor, context, *_ = contexts(units, length, k)
                    held.append((anchor, context))
                    count += len(anchor)
                    if count >= FLUSH_ROWS:
                        yield flush()
                        held, count, total = [], 0, total + count
        if count:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total + count], pa.int64())], names=["anchor", "n"])

    return common.trimmed(run)


def crowded(texts: DataFrame, reader: Reader, *, length: int, k: int, budget: int, piece: int) -> np.ndarray:
    """Sorted hashes of the crowded anchors. They only say where contexts meet: results are the same for any choice."""
    told = texts.mapInArrow(_crowds(reader, length, k, piece), "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))
    told = common.checkpointed(told.filter(F.col("anchor").isNull() | (F.col("n") > budget)))
    total = told.filter("anchor is null").first()
    least = max(budget, CROWD_SHARE * (total.n if total else 0))
    found = told.filter("anchor is not null").filter(F.col("n") > least).select("anchor").collect()  # at most 1 / CROWD_SHARE
    return np.sort(np.array([r.anchor for r in found], dtype=np.int64).view(np.uint64))


def _cut(reader: Reader, length: int, k: int, buckets: int, piece: int, crowds) -> Callable:
    """Step 1, over (place, check, text); ``crowds``: a broadcast of the crowded anchors."""

    def flush(held: list[np.ndarray], out: _Outbox) -> None:
        rows = np.concatenate(held)
        both = rows["anchor"] ^ (rows["context"] * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(both)
        both = both[order]
        same = np.zeros(len(rows), dtype=bool)
        same[1:] = both[1:] == both[:-1]
        same[:-1] |= same[1:].copy()
        often = order[same]
        alone = np.ones(len(rows), dtype=bool)
        if len(often):
            alone[often] = False
            several, _, first = earliest(rows[np.sort(often)], ("anchor", "context"))
            repeats = spans_of(several[~first], length)
            out.put(REPEAT, by_document(repeats), repeats)
            rows = np.concatenate((rows[alone], several[first]))
        known = crowds.value
        if len(known):
            hot = known[np.minimum(np.searchsorted(known, rows["anchor"]), len(known) - 1)] == rows["anchor"]
            out.put(SPLIT, rows["anchor"][hot] ^ common.mix(rows["context"][hot]), rows[hot])
            rows = rows[~hot]
        out.put(SEND, rows["anchor"], rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, count = _Outbox(buckets), [], 0
        for b in batches:
            place, check = (np.asarray(b.column(i)) for i in (0, 1))
            for i, _, data, offsets in common.text_slices(b.column(2), min(common.SLICE_BYTES, piece)):
                for units, base in stretches(reader, data, offsets, length, piece):
                    anchor, context, first, windows, doc = contexts(units, length, k)
                    rows = np.empty(len(anchor), dtype=PLACED)
                    rows["anchor"], rows["context"], rows["windows"] = anchor, context, windows
                    rows["doc"], rows["check"], rows["start"] = place[i + doc], check[i + doc], first - units.offsets[doc] + base
                    held.append(rows)
                    count += len(rows)
                    if count >= FLUSH_ROWS:
                        flush(held, out)
                        held, count = [], 0
                        if out.rows:
                            yield out.take()
        if count:
            flush(held, out)
        if out.rows:
            yield out.take()

    return common.trimmed(run)


def _decide(length: int, buckets: int, budget: int) -> Callable:
    """Step 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, apart = _Outbox(buckets), [], []
        for b in batches:
            for bucket, kind, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if kind in (SEND, SPLIT):
                    (held if kind == SEND else apart).append(unpack(body.as_py(), PLACED))
                else:
                    out.rows.append((bucket, kind, body.as_py()))
            if out.rows:
                yield out.take()

        def ask(rows: np.ndarray, split: np.ndarray | bool) -> None:
            asked = np.empty(len(rows), dtype=WANTED)
            for n in ("doc", "check", "start", "windows", "anchor"):
                asked[n] = rows[n]
            asked["split"] = split
            out.put(FETCH, by_document(asked), asked)

        if apart:
            rows, _, first = earliest(np.concatenate(apart), ("anchor", "context"))
            del apart
            repeats = spans_of(rows[~first], length)
            out.put(REPEAT, by_document(repeats), repeats)
            ask(rows[first], True)
            if out.rows:
                yield out.take()
        if not held:
            return
        rows = np.concatenate(held)
        order = np.argsort(rows["anchor"])
        a = rows["anchor"][order]
        same = np.zeros(len(a), dtype=bool)
        same[1:] = a[1:] == a[:-1]
        same[:-1] |= same[1:].copy()
        rows, opens, first = earliest(rows[order[same]], ("anchor", "context"))
        repeats = spans_of(rows[~first], length)
        out.put(REPEAT, by_document(repeats), repeats)
        group = np.cumsum(np.concatenate(([True], rows["anchor"][1:] != rows["anchor"][:-1]))) - 1 if len(rows) else np.zeros(0, dtype=np.int64)
        distinct = np.bincount(group, weights=opens).astype(np.int64) if len(rows) else group
        contested = first & (distinct[group] > 1)
        ask(rows[contested], distinct[group][contested] > budget)
        if out.rows:
            yield out.take()

    return common.trimmed(run)


def _gather(kinds: dict[int, np.dtype]) -> Callable:
    """Blobs of a partition to one row for each document: place, check and the packed rows of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {k: [] for k in kinds}
        for b in batches:
            for kind, body in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                if kind in kinds:
                    held[kind].append(unpack(body.as_py(), kinds[kind]))
        for kind, parts in held.items():
            if not parts:
                continue
            rows = np.concatenate(parts)
            rows = rows[np.lexsort((rows["start"], rows["check"], rows["doc"]))]
            cuts = np.flatnonzero((np.diff(rows["doc"]) != 0) | (np.diff(rows["check"].astype(np.int64)) != 0)) + 1
            heads = rows[np.concatenate(([0], cuts))]
            for i in range(0, len(heads), 10_000):
                ends = [*cuts, len(rows)]
                bodies = [rows[(cuts[j - 1] if j else 0) : ends[j]].tobytes() for j in range(i, min(i + 10_000, len(heads)))]
                yield pa.RecordBatch.from_arrays([pa.array(heads["doc"][i : i + 10_000]), pa.array(heads["check"][i : i + 10_000].astype(np.int64)), pa.array(bodies, pa.binary())], names=["place", "check", "body"])

    return common.trimmed(run)


def _fetch(reader: Reader, length: int, buckets: int, piece: int) -> Callable:
    """Step 3, over (place, check, text, wanted, doc_id): contested contexts with their units, as one record for each flush and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, heads, bodies, size = _Outbox(buckets), [], [], 0

        def flush() -> None:
            rows, units = np.concatenate(heads), np.concatenate(bodies)
            at = np.concatenate(([0], np.cumsum(rows["windows"].astype(np.int64) + (length - 1))))
            whole = ~rows["split"]
            if (~whole).any():
                split = np.flatnonzero(~whole)
                each = rows["windows"][split].astype(np.int64)
                parent = np.repeat(split, each)
                shift = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                lone = rows[parent]
                lone["start"] += shift.astype(np.int32)
                lone["windows"] = 1
                begin = at[parent] + shift
                lone["anchor"] = common.Rolling(common.BYTE_VALUES[units] if units.dtype == np.uint8 else units).spans(begin, begin + length)
                lone_rows = np.empty(len(lone), dtype=[*PLACED.descr, ("at", "<i8")])
                for n in ("anchor", "doc", "check", "start", "windows"):
                    lone_rows[n] = lone[n]
                lone_rows["context"], lone_rows["at"] = 0, begin
                lone_rows, _, first = earliest(lone_rows, ("anchor",))
                repeats = spans_of(lone_rows[~first], length)
                out.put(REPEAT, by_document(repeats), repeats)
                kept = lone_rows[first]
                send(kept["anchor"], kept, kept["at"], units)
            if whole.any():
                send(rows["anchor"][whole], rows[whole], at[:-1][whole], units)

        def send(by: np.ndarray, rows: np.ndarray, begin: np.ndarray, units: np.ndarray) -> None:
            bucket = (common.mix(by.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            head = np.empty(len(rows), dtype=WANTED)
            for n in ("doc", "check", "start", "windows", "anchor"):
                head[n] = rows[n]
            head["split"] = False
            for b in np.unique(bucket):
                mine = np.flatnonzero(bucket == b)
                lengths = rows["windows"][mine].astype(np.int64) + (length - 1)
                pick = np.repeat(begin[mine] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
                first = pack(head[mine])
                out.rows.append((int(b), SEND, len(first).to_bytes(4, "little") + first + zstandard.compress(units[pick].tobytes(), 1)))

        for b in batches:
            place, check = (np.asarray(b.column(i)) for i in (0, 1))
            for i, j, data, offsets in common.text_slices(b.column(2), min(common.SLICE_BYTES, piece)):
                reached = 0
                for units, base in stretches(reader, data, offsets, length, piece):
                    for d in range(i, j):
                        rows = np.frombuffer(b.column(3)[d].as_py(), dtype=WANTED)
                        ends = rows["start"].astype(np.int64) + rows["windows"] + (length - 1)
                        if j - i == 1:  # a context is in the stretch that reaches its end
                            rows = rows[(ends > reached) & (ends <= base + len(units.values))]
                        at = units.offsets[d - i] + rows["start"].astype(np.int64) - base
                        lengths = rows["windows"].astype(np.int64) + (length - 1)
                        pick = np.repeat(at - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
                        heads.append(rows)
                        bodies.append(units.raw[pick])
                        size += bodies[-1].nbytes
                        if size >= 4 << 20:
                            flush()
                            heads, bodies, size = [], [], 0
                            yield out.take()
                    reached = base + len(units.values)
        if heads:
            flush()
            if out.rows:
                yield out.take()

    return common.trimmed(run)


class Contested(NamedTuple):
    """Contexts of one group, ordered by place, and their units one after the other."""

    head: np.ndarray
    at: np.ndarray
    units: np.ndarray


def _index(later: Callable[[Contested, int], np.ndarray], length: int, unit: np.dtype, buckets: int, chunk_units: int) -> Callable:
    """Step 4: spans of the windows for which ``later`` says that they start earlier too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, heads, bodies = _Outbox(buckets), [], []
        for b in batches:
            for bucket, kind, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                body = body.as_py()
                if kind == SEND:
                    k = int.from_bytes(body[:4], "little")
                    heads.append(unpack(body[4 : 4 + k], WANTED))
                    bodies.append(np.frombuffer(zstandard.decompress(body[4 + k :]), dtype=unit))
                else:
                    out.rows.append((bucket, kind, body))
            if out.rows:
                yield out.take()
        if not heads:
            return
        head, units = np.concatenate(heads), np.concatenate(bodies)
        del heads, bodies
        lengths = head["windows"].astype(np.int64) + (length - 1)
        at = np.cumsum(lengths) - lengths
        order = np.argsort(head["anchor"], kind="stable")
        ends = np.flatnonzero(np.diff(head["anchor"][order]) != 0) + 1
        ends = np.append(ends, len(order))
        done = np.cumsum(lengths[order])
        begin = 0
        while begin < len(order):  # whole anchors, about chunk_units at a time
            base = done[begin - 1] if begin else 0
            i = int(np.searchsorted(done[ends - 1], base + chunk_units, "right")) - 1
            end = int(ends[i]) if i >= 0 and ends[i] > begin else int(ends[np.searchsorted(ends, begin, "right")])
            mine = order[begin:end]
            mine = mine[np.lexsort((head["start"][mine], head["doc"][mine]))]
            n = lengths[mine]
            first = np.cumsum(n) - n
            pick = np.repeat(at[mine] - first, n) + np.arange(n.sum())
            group = Contested(head[mine], first, units[pick])
            late = later(group, length)  # for each window of each context
            each = group.head["windows"].astype(np.int64)
            parent = np.repeat(np.arange(len(mine)), each)[late]
            shift = (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each))[late]
            spans = np.empty(len(parent), dtype=SPAN)
            spans["doc"], spans["check"] = group.head["doc"][parent], group.head["check"][parent]
            spans["start"] = group.head["start"][parent] + shift
            spans["end"] = spans["start"] + length
            spans = merged(spans)
            out.put(REPEAT, by_document(spans), spans)
            if out.rows:
                yield out.take()
            begin = end

    return common.trimmed(run)


def merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching spans of a document as one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["check"], spans["doc"]))]
    key = np.cumsum(np.concatenate(([0], (np.diff(spans["doc"]) != 0) | (np.diff(spans["check"].astype(np.int64)) != 0))))
    shifted = key.astype(np.int64) << 32
    reach = np.maximum.accumulate(shifted + spans["end"])
    opens = np.ones(len(spans), dtype=bool)
    opens[1:] = shifted[1:] + spans["start"][1:] > reach[:-1]
    head = np.flatnonzero(opens)
    out = spans[head].copy()
    out["end"] = (reach[np.append(head[1:], len(spans)) - 1] - shifted[head]).astype(np.int32)
    return out


def places(group: Contested) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of the contexts: its first unit in ``units``, its doc and its start there."""
    each = group.head["windows"].astype(np.int64)
    shift = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return np.repeat(group.at, each) + shift, np.repeat(group.head["doc"], each), np.repeat(group.head["start"].astype(np.int64), each) + shift


def repeated_spans(docs: DataFrame, reader: Reader, unit: np.dtype, later: Callable, *, length: int, k: int, chunk_units: int, budget: int = GROUP_BUDGET, piece: int = PIECE_BYTES) -> DataFrame:
    """``keyed(docs)`` with ``body``: the packed spans (``SPAN``) of units in windows that start earlier too, or null."""
    common.small_batches(docs.sparkSession)
    n = common.partitions(docs)
    rows = keyed(docs)
    crowds = docs.sparkSession.sparkContext.broadcast(crowded(rows.select("text"), reader, length=length, k=k, budget=budget, piece=piece))
    cut = rows.select("place", "check", "text").mapInArrow(_cut(reader, length, k, n, piece, crowds), BLOB_SCHEMA)
    decided = common.checkpointed(cut.repartition(n, "bucket").mapInArrow(_decide(length, n, budget), BLOB_SCHEMA))
    schema = "place bigint, check bigint, body binary"
    asked = decided.filter(F.col("kind") == FETCH).repartition(n, "bucket").mapInArrow(_gather({FETCH: WANTED}), schema)
    # both joins take the same columns, so that the texts are shuffled once
    wanted = rows.join(asked, ["place", "check"]).select("place", "check", "text", "body", "doc_id").mapInArrow(_fetch(reader, length, n, piece), BLOB_SCHEMA)
    indexed = wanted.repartition(n, "bucket").mapInArrow(_index(later, length, unit, n, chunk_units), BLOB_SCHEMA)
    spans = decided.filter(F.col("kind") == REPEAT).unionByName(indexed).repartition(n, "bucket").mapInArrow(_gather({REPEAT: SPAN}), schema)
    return rows.join(spans, ["place", "check"], "left")
