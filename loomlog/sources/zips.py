"""Zip archives of any size, by seeks: their directories, single members, logs inside them in chunks, and a writer.

A first pass reads only the directory at an archive's end, which gives a row for each member; those rows are spread, so a
member is what a task reads, from its own place in the archive. Neither an archive nor, where it is a log, a member has to fit
into a row: a log is unpacked as a stream and leaves the task chunk by chunk.

Defined cases: an archive that cannot be read is one row that tells its problem, an empty one gives no row; folders are left out. A
member that is broken, cut, encrypted, packed by an unknown method, or of another length or checksum than its directory says
has no content and tells its problem, as does one of more than ``most`` bytes. Members of equal names are rows of their own.
"""

from __future__ import annotations

import bz2
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_type
from . import ranges
from .binxml import CHUNK_SIZE

#: Bytes of a member that are handed out as one value; a row of Spark ends at 2 GiB.
MOST_BYTES = 1 << 30
STEP = 1 << 20
_LOCAL_HEAD = 30
_ENCRYPTED = 1
_DIRECTORY = pa.schema([("archive", pa.string()), ("place", pa.int32()), ("name", pa.string()), ("size", pa.int64()), ("compressed_size", pa.int64()), ("at", pa.int64()), ("method", pa.int32()), ("flags", pa.int32()), ("crc", pa.int64()), ("problem", pa.string())])
_MEMBERS = pa.schema([("archive", pa.string()), ("place", pa.int32()), ("name", pa.string()), ("size", pa.int64()), ("compressed_size", pa.int64()), ("content", pa.binary()), ("problem", pa.string())])
_CHUNKS = pa.schema([("file", pa.string()), ("chunk_index", pa.int32()), ("chunk_start", pa.int64()), ("chunk", pa.binary()), ("problem", pa.string())])
_WRITTEN = pa.schema([("archive", pa.string()), ("file", pa.string()), ("members", pa.int64())])
_SQL = {pa.string(): "string", pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary"}
_FAILURES = (zipfile.BadZipFile, zlib.error, OSError, EOFError, ValueError, struct.error)


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


class Member(NamedTuple):
    archive: str
    place: int | None
    name: str | None
    size: int | None
    compressed_size: int | None
    at: int | None
    method: int | None
    flags: int | None
    crc: int | None
    problem: str | None

    @property
    def file(self) -> str:
        return f"{self.archive}::{self.name}"


class _Seeks(io.RawIOBase):
    """An Arrow file whose seeks before the beginning fail as those of Python's files do."""

    def __init__(self, f) -> None:
        self.f = f

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        return self.f.readinto(into)

    def tell(self) -> int:
        return self.f.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + (0, self.f.tell(), self.f.size())[whence]
        if at < 0:
            raise OSError("a place before the beginning")
        return self.f.seek(at)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column(0).to_pylist():
            system, at = ranges.opened(path)
            try:
                with system.open_input_file(at) as f, zipfile.ZipFile(io.BufferedReader(_Seeks(f))) as archive:
                    members = [m for m in archive.infolist() if m.filename and not m.is_dir()]
            except _FAILURES as e:
                yield pa.RecordBatch.from_pylist([{"archive": path, "problem": str(e)}], schema=_DIRECTORY)
                continue
            for first in range(0, len(members), 1000):
                rows = [Member(path, k, m.filename, m.file_size, m.compress_size, m.header_offset, m.compress_type, m.flag_bits, m.CRC, None) for k, m in enumerate(members[first : first + 1000], first)]
                yield pa.RecordBatch.from_pylist([r._asdict() for r in rows], schema=_DIRECTORY)


def _entries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    # without its content, a file of any length is a row
    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(_listed, _ddl(_DIRECTORY))


def directory(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(archive, place, name, type, size, compressed_size, problem) of all members, which are not read for it."""
    return _entries(spark, path).select("archive", "place", "name", file_type(F.col("name")).alias("type"), "size", "compressed_size", "problem")


def _inflated(pieces: Iterator[bytes], method: int) -> Iterator[bytes]:
    """The bytes behind ``pieces``, at most ``STEP`` at once."""
    match method:
        case zipfile.ZIP_STORED:
            yield from pieces
        case zipfile.ZIP_DEFLATED:
            unpack = zlib.decompressobj(-zlib.MAX_WBITS)
            for raw in pieces:
                while True:
                    out = unpack.decompress(raw, STEP)
                    yield out
                    raw = unpack.unconsumed_tail
                    if not raw and len(out) < STEP:
                        break
            if not unpack.eof:
                raise EOFError("the member is cut")
        case zipfile.ZIP_BZIP2:
            unpack = bz2.BZ2Decompressor()
            for raw in pieces:
                yield unpack.decompress(raw, STEP)
                while not unpack.needs_input and not unpack.eof:
                    yield unpack.decompress(b"", STEP)
        case _:
            raise ValueError(f"compression method {method} is not supported")


def unpacked(f, m: Member) -> Iterator[bytes]:
    """The member's bytes in pieces; a fault is raised at the end at the latest."""
    if m.flags & _ENCRYPTED:
        raise ValueError("the member is encrypted")
    f.seek(m.at)
    head = f.read(_LOCAL_HEAD)
    if not head.startswith(b"PK\x03\x04"):
        raise zipfile.BadZipFile("no member at its place")
    f.seek(m.at + _LOCAL_HEAD + sum(struct.unpack_from("<HH", head, 26)))

    def packed() -> Iterator[bytes]:
        left = m.compressed_size
        while left:
            raw = f.read(min(STEP, left))
            if not raw:
                raise EOFError("the archive is cut")
            left -= len(raw)
            yield raw

    size = crc = 0
    for piece in _inflated(packed(), m.method):
        size, crc = size + len(piece), zlib.crc32(piece, crc)
        if size > m.size:
            break
        yield piece
    if size != m.size:
        raise zipfile.BadZipFile(f"the member has another size than {m.size}")
    if crc != m.crc:
        raise zipfile.BadZipFile("the member's checksum does not hold")


def _opened_members(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Member]]:
    """Members with their archive opened, which stays so for the members that follow."""
    held, f = None, None
    try:
        for b in batches:
            for row in b.to_pylist():
                m = Member(**row)
                if m.problem is None and m.archive != held:
                    if f is not None:
                        f.close()
                    system, at = ranges.opened(m.archive)
                    held, f = m.archive, system.open_input_file(at)
                yield f, m
    finally:
        if f is not None:
            f.close()


def _spread(members: DataFrame) -> DataFrame:
    """Small rows that stand for much work: a stated number of partitions is kept, where sizes would have them merged."""
    spark = members.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return members.repartition(n, "archive", "place").sortWithinPartitions("archive", "place")


def read_members(spark: SparkSession, path: str | list[str], *, most: int = MOST_BYTES) -> DataFrame:
    """(archive, place, name, type, size, compressed_size, content, problem): a task unpacks single members."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, m in _opened_members(batches):
            content, problem = None, m.problem
            if problem is None and m.size > most:
                problem = f"{m.size} bytes do not fit into a row of at most {most}"
            elif problem is None:
                try:
                    content = b"".join(unpacked(f, m))
                except _FAILURES as e:
                    problem = str(e)
            yield pa.RecordBatch.from_pylist([{n: getattr(m, n) for n in _MEMBERS.names if n not in ("content", "problem")} | {"content": content, "problem": problem}], schema=_MEMBERS)

    found = _spread(_entries(spark, path)).mapInArrow(read, _ddl(_MEMBERS))
    return found.select("archive", "place", "name", file_type(F.col("name")).alias("type"), "size", "compressed_size", "content", "problem")


def _cut(pieces: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
    """(start, chunk) of the places of a log that comes in pieces."""
    held, at, header = bytearray(), 0, None
    for piece in pieces:
        held += piece
        if header is None and len(held) >= 128:
            if not held.startswith(bytes(ranges.container.FILE_MAGIC)):
                raise ValueError("not a binary log")
            header = int.from_bytes(held[40:42], "little")
        if header is None or (not at and len(held) < header):
            continue
        first = 0 if at else header
        at = at or header
        while len(held) - first >= CHUNK_SIZE:
            yield at, bytes(held[first : first + CHUNK_SIZE])
            first, at = first + CHUNK_SIZE, at + CHUNK_SIZE
        del held[:first]
    if header is None:
        raise ValueError("not a binary log")


def log_chunks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, chunk_index, chunk_start, chunk, problem) of the logs inside archives, as ``container.chunks`` gives them for files.

    A log is unpacked as a stream by one task, for packed bytes have one beginning, and never held whole. Where it breaks off, the chunks
    before are given and a row without a chunk tells the problem; so do archives that cannot be read.
    """
    magic = bytes(ranges.container.CHUNK_MAGIC)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, m in _opened_members(batches):
            rows, index, problem = [], 0, m.problem
            if problem is None:
                try:
                    for start, chunk in _cut(unpacked(f, m)):
                        if chunk.startswith(magic):
                            rows.append((m.file, index, start, chunk, None))
                            index += 1
                        if len(rows) >= ranges.READ_CHUNKS:
                            yield _batch(rows)
                            rows = []
                except _FAILURES as e:
                    problem = str(e)
            if problem is not None:
                rows.append((m.archive if m.name is None else m.file, None, None, None, problem))
            if rows:
                yield _batch(rows)

    logs = _entries(spark, path).filter((file_type(F.col("name")) == "evtx") | F.col("problem").isNotNull())
    return _spread(logs).mapInArrow(read, _ddl(_CHUNKS))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CHUNKS.types, strict=True)], schema=_CHUNKS)


def write_archives(members: DataFrame, path: str) -> DataFrame:
    """(archive, file, members): of ``members`` (archive, name, content) a zip for each archive, members by name.

    A zip is one file and so one task's, which holds one member at a time. It gets its name once it is complete, so a lost
    task leaves nothing that a reader takes for an archive. Rows without a name are left out; no content counts as empty.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = ranges.opened(path)
        root = root.rstrip("/")
        name, out, stream, staged, n = None, None, None, None, 0

        def end() -> Iterator[pa.RecordBatch]:
            if out is None:
                return
            out.close()
            stream.close()
            target = f"{root}/{name.replace('/', '_')}.zip"
            system.move(staged, target)
            yield pa.RecordBatch.from_pylist([{"archive": name, "file": target, "members": n}], schema=_WRITTEN)

        for b in batches:
            for archive, member, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if archive != name:
                    yield from end()
                    name, n, staged = archive, 0, f"{root}/_staging-{uuid.uuid4().hex}"
                    system.create_dir(root, recursive=True)
                    stream = system.open_output_stream(staged)
                    out = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                out.writestr(zipfile.ZipInfo(member), content or b"", zipfile.ZIP_DEFLATED)
                n += 1
        yield from end()

    placed = members.filter("archive is not null and name is not null").select("archive", "name", F.col("content").cast("binary").alias("content"))
    return placed.repartition("archive").sortWithinPartitions("archive", "name").mapInArrow(write, _ddl(_WRITTEN))
