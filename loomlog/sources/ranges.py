"""Logs read by ranges of chunks: listing, headers as zone maps, pushed conditions, and Arrow batches of only the asked columns.

A chunk's header takes 512 bytes and tells its first and last record id. With a condition on ids, only headers are read
first, and a chunk that cannot hold a wanted record is never read. A header counts as a zone map where its checksum holds
and it is not flagged as dirty; its ids are those of the chunk's records then, as the checks D2 and D3 say.
"""

from __future__ import annotations

import operator
import struct
import time
import zlib
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa

from ..functions import values
from ..functions.eventxml import NAMES
from . import container
from .binxml import CHUNK_SIZE, ChunkXml

HEAD = 512
#: Chunks of one sequential read, and of one Arrow batch.
READ_CHUNKS = 16

#: All columns of an event row as a range gives it.
EVENT_TYPES = {
    "file": pa.string(), "span": pa.int64(), "chunk_place": pa.int64(), "chunk_rank": pa.int32(), "chunk_total": pa.int64(), "chunk_ms": pa.float64(),
    "record_seq": pa.int32(), "record_id": pa.int64(), "ticks": pa.decimal128(20, 0), "timestamp": pa.string(), "xml": pa.string(),
    **{n: pa.int32() if n == "level" else pa.string() for n in NAMES}, "error": pa.string(),
}
#: Of a chunk's head.
HEAD_TYPES = {
    "file": pa.string(), "span": pa.int64(), "chunk_place": pa.int64(), "chunk_start": pa.int64(), "is_chunk": pa.bool_(), "first_record_id": pa.int64(), "last_record_id": pa.int64(), "flags": pa.int64(), "header_ok": pa.bool_(),
}
_TEXTS = frozenset((*NAMES, "xml"))
_FIELDS = frozenset(NAMES)
_OPERATORS = {"=": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "in": lambda a, b: a in b, "is not null": lambda a, _: True}


class Span(NamedTuple):
    """Chunks ``first`` to ``first + count`` of a file of ``total`` places; ``error`` in place of them where it is no log."""

    file: str
    header: int
    first: int
    count: int
    total: int
    number: int
    error: str | None = None


class Condition(NamedTuple):
    column: str
    how: str
    value: object = None

    def holds(self, found: object) -> bool:
        return found is not None and _OPERATORS[self.how](found, self.value)


class Zone(NamedTuple):
    low: int
    high: int


def opened(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list:
    """(file system, file information) of the logs under ``path``, or of the file itself, by path."""
    from pyarrow import fs

    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    hidden = lambda i: any(p.startswith(("_", ".")) for p in i.path[len(at) :].split("/"))
    return sorted(((system, i) for i in found if i.type == fs.FileType.File and (info.type == fs.FileType.File or (i.path.lower().endswith(".evtx") and not hidden(i)))), key=lambda x: x[1].path)


class Header(NamedTuple):
    size: int
    is_dirty: bool


def file_header(f) -> Header | None:
    """What the head of a log says; None where the file is no log."""
    head = f.read(128)
    if not head.startswith(bytes(container.FILE_MAGIC)):
        return None
    return Header(int.from_bytes(head[40:42], "little"), bool(len(head) >= 124 and head[120] & 1))


def places(size: int, header: Header) -> int:
    return max(0, (size - header.size) // CHUNK_SIZE)


def spans(file: str, header: int, first: int, end: int, total: int, step: int) -> Iterator[Span]:
    """Ranges of at most ``step`` chunks, cut at multiples of it."""
    while first < end:
        n = min(step - first % step, end - first)
        yield Span(file, header, first, n, total, first // step)
        first += n


def zone(head: bytes) -> Zone | None:
    """The record ids of a chunk, by its header; None where it cannot be relied on."""
    flags, checksum = struct.unpack_from("<II", head, 120)
    if flags & 1 or zlib.crc32(head[128:HEAD], zlib.crc32(head[:120])) != checksum:
        return None
    return Zone(*struct.unpack_from("<QQ", head, 24))


def may_hold(z: Zone | None, conditions: Iterable[Condition]) -> bool:
    """Whether a chunk of this zone can hold a record that meets the conditions on ids."""
    if z is None:
        return True
    for c in conditions:
        if c.column == "record_id":
            if c.how in (">", ">=") and not _OPERATORS[c.how](z.high, c.value):
                return False
            if c.how in ("<", "<=") and not _OPERATORS[c.how](z.low, c.value):
                return False
            if c.how in ("=", "in") and not any(z.low <= v <= z.high for v in ((c.value,) if c.how == "=" else c.value)):
                return False
    return True


def at_place(place: int, conditions: Iterable[Condition]) -> bool:
    return all(c.holds(place) for c in conditions if c.column == "chunk_place")


def _chunks(f, span: Span, conditions: Sequence[Condition], count: dict) -> Iterator[tuple[int, int, bytes]]:
    """(place, rank among the span's chunks, chunk) of the chunks that may hold wanted records."""
    magic, rank = bytes(container.CHUNK_MAGIC), -1
    by_head = any(c.column in ("record_id", "chunk_place") for c in conditions)
    for a in range(span.first, span.first + span.count, 1 if by_head else READ_CHUNKS):
        n = 1 if by_head else min(READ_CHUNKS, span.first + span.count - a)
        f.seek(span.header + a * CHUNK_SIZE)
        block = f.read(HEAD if by_head else n * CHUNK_SIZE)
        for k in range(n):
            if block[k * CHUNK_SIZE : k * CHUNK_SIZE + len(magic)] != magic:
                continue
            rank += 1
            if by_head:
                if not at_place(a, conditions) or not may_hold(zone(block), conditions):
                    continue
                block += f.read(CHUNK_SIZE - HEAD)
            count["opened"] = count.get("opened", 0) + 1
            yield a + k, rank, block[k * CHUNK_SIZE : (k + 1) * CHUNK_SIZE]


def events(chunk: bytes, asked: Sequence[str], conditions: Sequence[Condition] = ()) -> dict[str, list]:
    """The asked columns of a chunk's events; texts are only made where one is asked, and only of records that meet the conditions."""
    xml = None
    if texts := _TEXTS.intersection(asked):
        xml = ChunkXml(chunk)
        xml.preload(struct.unpack_from("<32I", chunk, 384))
    fields = bool(_FIELDS & texts)
    tested = [c for c in conditions if c.column in ("record_id", "timestamp")]
    seqs, ids, ticks, stamps, bodies, rows = [], [], [], [], [], []
    stamped = "timestamp" in asked or any(c.column == "timestamp" for c in tested)
    for seq, (at, size, record, moment, _) in enumerate(container.walk(chunk)):
        stamp = values.filetime_text(moment) if stamped else None
        record_id = record if record < 1 << 63 else None
        if tested and not all(c.holds(record_id if c.column == "record_id" else stamp) for c in tested):
            continue
        seqs.append(seq)
        ids.append(record_id)
        ticks.append(moment)
        stamps.append(stamp)
        if xml:
            text, _ = xml.event(record, at + 24, at + size - 4)
            bodies.append(text)
            if fields:
                rows.append(xml.fields(text))
    found = {"record_seq": seqs, "record_id": ids, "ticks": ticks, "timestamp": stamps, "xml": bodies}
    if fields:
        found.update(zip(NAMES, zip(*rows, strict=True) if rows else [()] * len(NAMES), strict=True))
    return found


def array(found: Sequence, kind: pa.DataType) -> pa.Array:
    return pa.array(found, pa.uint64()).cast(kind) if pa.types.is_decimal(kind) else pa.array(found, kind)


def event_batches(root: str, span: Span, asked: Sequence[str], conditions: Sequence[Condition] = (), count: dict | None = None) -> Iterator[pa.RecordBatch]:
    """The events of a range with the columns ``asked``; ``count`` tells how many chunks were opened."""
    schema = pa.schema([(n, EVENT_TYPES[n]) for n in asked])
    if span.error:
        told = {"file": span.file, "span": span.number, "error": span.error}
        yield pa.RecordBatch.from_arrays([pa.array([told.get(n)], EVENT_TYPES[n]) for n in asked], schema=schema)
        return
    count = {} if count is None else count
    held: dict[str, list] = {n: [] for n in asked}
    chunks = 0

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([array(held[n], EVENT_TYPES[n]) for n in asked], schema=schema) if asked else pa.RecordBatch.from_arrays([], names=[])
        for found in held.values():
            found.clear()
        return made

    system, _ = opened(root)
    with system.open_input_file(span.file) as f:
        for place, rank, chunk in _chunks(f, span, conditions, count):
            began = time.perf_counter()
            found = events(chunk, asked, conditions)
            n = len(found["record_seq"])
            for name in asked:
                if name in found:
                    held[name].extend(found[name])
                elif name == "chunk_ms":  # once a chunk, so that sums are right
                    held[name].extend([(time.perf_counter() - began) * 1000, *[None] * (n - 1)][:n])
                else:
                    held[name].extend([{"file": span.file, "span": span.number, "chunk_place": place, "chunk_rank": rank, "chunk_total": span.total}.get(name)] * n)
            chunks += 1
            if chunks % READ_CHUNKS == 0:
                yield batch()
    if chunks % READ_CHUNKS:
        yield batch()


def head_batches(root: str, span: Span, asked: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The heads of a range's chunks; of places without a chunk only where they are."""
    system, _ = opened(root)
    rows = []
    magic = bytes(container.CHUNK_MAGIC)
    with system.open_input_file(span.file) as f:
        for k in range(span.first, span.first + span.count):
            start = span.header + k * CHUNK_SIZE
            f.seek(start)
            head = f.read(HEAD)
            row = {"file": span.file, "span": span.number, "chunk_place": k, "chunk_start": start, "is_chunk": head.startswith(magic)}
            if row["is_chunk"]:
                first, last = struct.unpack_from("<QQ", head, 24)
                flags, checksum = struct.unpack_from("<II", head, 120)
                told = lambda x: x if x < 1 << 63 else None
                row |= {"first_record_id": told(first), "last_record_id": told(last), "flags": flags, "header_ok": zlib.crc32(head[128:HEAD], zlib.crc32(head[:120])) == checksum}
            rows.append(row)
    schema = pa.schema([(n, HEAD_TYPES[n]) for n in asked])
    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], HEAD_TYPES[n]) for n in asked], schema=schema)
