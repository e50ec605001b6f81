"""The binary log container: files to 64 KiB chunks to records and events.

A chunk is the unit of parallelism and the scope of all offsets in it. Chunks are cut out natively from
``binaryFile`` rows; ``decode`` turns each into one row with its header, records, events, templates and
diagnostics, in one Arrow pass. The tables of the log are projections of that.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import eventxml, values
from ..functions.text import level_text
from ..functions.time import filetime_iso, filetime_timestamp
from .binxml import CHUNK_SIZE, ChunkXml

FILE_MAGIC = bytearray(b"ElfFile")
CHUNK_MAGIC = bytearray(b"ElfChnk")
RECORD_MAGIC = 0x00002A2A
RECORDS_START = 512
RECORD_FRAME = 28

_TEXT = [n for n in eventxml.NAMES if n != "level"]
_RECORD = "record_seq int, chunk_offset bigint, record_id decimal(20,0), ticks decimal(20,0), size bigint, size_copy bigint, binxml_length bigint, binxml_first_byte int, binxml binary"
_EVENT = f"record_seq int, record_id decimal(20,0), ticks decimal(20,0), xml string, level int, {', '.join(f'{n} string' for n in _TEXT)}"
_HEADER = "first_event_record_number decimal(20,0), last_event_record_number decimal(20,0), first_event_record_id decimal(20,0), last_event_record_id decimal(20,0), header_size bigint, last_event_record_offset bigint, free_space_offset bigint, event_records_checksum bigint, flags bigint, header_checksum bigint, common_string_offsets array<bigint>, template_pointers array<bigint>"
DECODED = f"""file string, chunk_index int, chunk_start bigint, header struct<{_HEADER.replace(" bigint", ":bigint").replace(" decimal", ":decimal").replace(" array", ":array")}>,
records array<struct<{", ".join(x.replace(" ", ":", 1) for x in _RECORD.split(", "))}>>,
events array<struct<{", ".join(x.replace(" ", ":", 1) for x in _EVENT.split(", "))}>>,
template_defs array<struct<def_data_offset:bigint, guid:string, data_size:bigint, first_seen_record:decimal(20,0)>>,
reference_count bigint, missing_refs array<struct<record_id:decimal(20,0), guid:string, def_data_offset:bigint>>,
parse_errors array<struct<record_id:decimal(20,0), error:string>>, record_count bigint"""
#: Parts for which the binary XML of the records is read.
_READ = frozenset(("events", "template_defs", "reference_count", "missing_refs", "parse_errors"))


def little_endian(data: Column, at: int, width: int) -> Column:
    """An unsigned little-endian integer at a 0-based place of a binary column; wide ones are decimals."""
    reversed_hex = F.concat(*(F.hex(F.substring(data, at + i + 1, 1)) for i in reversed(range(width))))
    return F.conv(reversed_hex, 16, 10).cast("decimal(20,0)" if width == 8 else "bigint")


def read_files(spark: SparkSession, path: str | list[str], *, recursive: bool = True) -> DataFrame:
    """(file, content) of the containers under ``path``; other files are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.select(F.col("path").alias("file"), "content")


def file_headers(files: DataFrame) -> DataFrame:
    """Of each row of ``files`` (file, content): header_block_size, flags, is_dirty, is_full; null where it is no container."""
    c = F.col("content")
    ok = F.substring(c, 1, len(FILE_MAGIC)) == F.lit(FILE_MAGIC)
    flags = little_endian(c, 120, 4)
    told = lambda x, name: F.when(ok, x).alias(name)
    return files.select("file", ok.alias("is_log"), told(little_endian(c, 40, 2).cast("int"), "header_block_size"), told(flags, "flags"), told(flags.bitwiseAND(1) == 1, "is_dirty"), told(flags.bitwiseAND(2) == 2, "is_full"))


def chunks(files: DataFrame) -> DataFrame:
    """(file, chunk_index, chunk_start, chunk) of ``files`` (file, content).

    Only whole chunks with the chunk's magic count; others are skipped, and indexes stay dense. A file
    without the file's magic fails the query.
    """

    def pieces(content: Column) -> Column:
        header = little_endian(content, 40, 2).cast("int")
        last = F.length(content) - CHUNK_SIZE
        places = F.when(last >= header, F.sequence(header, last, F.lit(CHUNK_SIZE))).otherwise(F.array().cast("array<int>"))
        checked = F.coalesce(F.when(F.substring(content, 1, len(FILE_MAGIC)) == F.lit(FILE_MAGIC), places), F.raise_error(F.concat(F.lit("not a binary log: "), F.col("file"))).cast("array<int>"))
        starts = F.filter(checked, lambda at: F.substring(content, at + 1, F.lit(len(CHUNK_MAGIC))) == F.lit(CHUNK_MAGIC))
        return F.transform(starts, lambda at: F.struct(at.cast("bigint").alias("chunk_start"), F.substring(content, at + 1, F.lit(CHUNK_SIZE)).alias("chunk")))

    # the content as a lambda's variable is read from its row once; as a column it would be copied for every chunk
    cut = F.element_at(F.transform(F.array("content"), pieces), 1)
    return files.select("file", F.posexplode(cut).alias("chunk_index", "c")).select("file", "chunk_index", "c.chunk_start", "c.chunk")


def piece_chunks(pieces: DataFrame) -> DataFrame:
    """``chunks`` of ``pieces`` (file, start, skip, content) as ``files.read_pieces`` cuts them; a chunk's index is its place in the file."""

    def found(content: Column) -> Column:
        last = F.length(content) - CHUNK_SIZE
        places = F.when(last >= F.col("skip"), F.sequence(F.col("skip"), last, F.lit(CHUNK_SIZE))).otherwise(F.array().cast("array<int>"))
        checked = F.coalesce(F.when(F.col("skip").isNotNull(), places), F.raise_error(F.concat(F.lit("not a binary log: "), F.col("file"))).cast("array<int>"))
        starts = F.filter(checked, lambda at: F.substring(content, at + 1, F.lit(len(CHUNK_MAGIC))) == F.lit(CHUNK_MAGIC))
        return F.transform(starts, lambda at: F.struct((F.col("start") + at).alias("chunk_start"), F.substring(content, at + 1, F.lit(CHUNK_SIZE)).alias("chunk")))

    cut = F.element_at(F.transform(F.array("content"), found), 1)
    return pieces.select("file", F.explode(cut).alias("c")).select("file", F.floor(F.col("c.chunk_start") / CHUNK_SIZE).cast("int").alias("chunk_index"), "c.chunk_start", "c.chunk")


def walk(chunk: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    """(offset, size, record id, ticks, size copy) of the records; the first that is not valid ends the chunk."""
    at, free = RECORDS_START, struct.unpack_from("<I", chunk, 48)[0]
    while at < free and at + RECORD_FRAME <= CHUNK_SIZE:
        magic, size, record, ticks = struct.unpack_from("<IIQQ", chunk, at)
        if magic != RECORD_MAGIC or size < RECORD_FRAME or at + size > CHUNK_SIZE:
            return
        yield at, size, record, ticks, struct.unpack_from("<I", chunk, at + size - 4)[0]
        at += size


def decode_chunk(chunk: bytes, parts: Sequence[str] | None = None) -> dict:
    """All that one chunk tells, as a row of ``DECODED`` without its place; nested rows are tuples in the order of their fields.

    Of other parts than ``parts`` only what costs nothing is told.
    """
    asked = _READ | {"records"} if parts is None else frozenset(parts)
    numbers = struct.unpack_from("<QQQQIIII", chunk, 8)
    xml = ChunkXml(chunk)
    heads = struct.unpack_from("<32I", chunk, 384)
    xml.preload(heads)
    records, events, seq = [], [], -1
    with_records, with_events, reading = "records" in asked, "events" in asked, bool(asked & _READ)
    for seq, (at, size, record, ticks, copy) in enumerate(walk(chunk)):
        begin, end = at + 24, at + size - 4
        if with_records:
            records.append((seq, at, record, ticks, size, copy, size - RECORD_FRAME, chunk[begin] if end > begin else None, chunk[begin:end]))
        if reading:
            text, _ = xml.event(record, begin, end)
        if with_events:
            event_id, level, *rest = xml.fields(text)
            events.append((seq, record, ticks, text, level, event_id, *rest))
    flags, checksum = struct.unpack_from("<II", chunk, 120)
    audit = xml.audit
    return {
        "header": (*numbers, flags, checksum, list(struct.unpack_from("<64I", chunk, 128)), list(heads)),
        "records": records,
        "events": events,
        "template_defs": [(d.offset, d.guid, d.size, d.first_record) for d in audit.definitions.values()],
        "reference_count": audit.references,
        "missing_refs": audit.missing,
        "parse_errors": audit.errors,
        "record_count": seq + 1,
    }


def _column(found: Sequence, kind: pa.DataType) -> pa.Array:
    """An Arrow array of plain values, of tuples (structs) or of lists of them."""
    if pa.types.is_decimal(kind):
        return pa.array(found, pa.uint64()).cast(kind)
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays([_column(c, f.type) for c, f in zip(zip(*found, strict=True) if found else [()] * len(kind), kind, strict=True)], fields=list(kind))
    if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type):
        ends = list(itertools.accumulate(map(len, found), initial=0))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _column([x for rows in found for x in rows], kind.value_type), type=kind)
    return pa.array(found, kind)


def decode(cut: DataFrame, *, parallelism: int | None = None, parts: Sequence[str] | None = None, spread: bool = True) -> DataFrame:
    """One row ``DECODED`` for each chunk of ``cut`` (file, chunk_index, chunk_start, chunk), or only its columns ``parts`` besides the place.

    Chunks of one file come from one input row, so they are spread before decoding; without ``spread`` they are decoded where they are.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    full = StructType.fromDDL(DECODED)
    schema = StructType([f for k, f in enumerate(full.fields) if k < 3 or parts is None or f.name in parts])
    kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 16):  # some MB of nested rows at a time
                part = b.slice(i, 16)
                rows = [decode_chunk(c.as_py(), parts) for c in part.column(3)]
                columns = [part.column(k).cast(kinds.field(k).type) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, *(_column([r[f.name] for r in rows], f.type) for f in list(kinds)[3:])], schema=kinds)

    spark = cut.sparkSession
    n = parallelism or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = cut.select("file", "chunk_index", "chunk_start", "chunk")
    return (cut.repartition(n, "file", "chunk_index") if spread else cut).mapInArrow(run, schema)


def events(decoded: DataFrame) -> DataFrame:
    """Event rows: the columns of the reference table, with their file, place, ticks and a timestamp in microseconds."""
    e = decoded.select("file", "chunk_index", F.explode("events").alias("e"))
    ticks = F.col("e.ticks")
    return e.select(
        "file",
        F.col("chunk_index"),
        F.col("e.record_seq"),
        F.col("e.record_id").cast("bigint").alias("record_id"),
        filetime_iso(ticks).alias("timestamp"),
        F.col("e.xml"),
        F.col("e.event_id"),
        F.col("e.level"),
        level_text(F.col("e.level")).alias("level_text"),
        *(F.col(f"e.{n}") for n in _TEXT if n != "event_id"),
        ticks.alias("ticks"),
        filetime_timestamp(ticks).alias("ts"),
    )


def records(decoded: DataFrame) -> DataFrame:
    r = decoded.select("file", "chunk_index", "chunk_start", F.explode("records").alias("r"))
    return r.select("file", "chunk_index", "r.record_seq", (F.col("chunk_start") + F.col("r.chunk_offset")).alias("file_offset"), "r.chunk_offset", F.col("r.record_id").cast("bigint").alias("record_id"), filetime_iso(F.col("r.ticks")).alias("timestamp"), "r.size", "r.size_copy", (F.col("r.size") == F.col("r.size_copy")).alias("size_match"), "r.binxml_length", "r.binxml_first_byte", "r.binxml")


def chunk_headers(decoded: DataFrame) -> DataFrame:
    h = decoded.select("file", "chunk_index", "chunk_start", "header.*")
    return h.withColumn("last_event_record_offset", F.col("chunk_start") + F.col("last_event_record_offset")).withColumn("free_space_offset", F.col("chunk_start") + F.col("free_space_offset"))


def template_defs(decoded: DataFrame) -> DataFrame:
    return decoded.select("file", "chunk_index", F.inline("template_defs"))


def file_summary(decoded: DataFrame) -> DataFrame:
    """Totals of each file; a definition counts once a file by its GUID.

    Numbers and GUIDs of a chunk are rows of one pass, so chunks are decoded once.
    """
    of_chunk = {"num_chunks": F.lit(1), "total_records": F.col("record_count"), "reference_count": F.col("reference_count"), "missing_count": F.size("missing_refs"), "parse_error_count": F.size("parse_errors")}
    row = lambda guid, numbers: F.struct(guid.cast("string").alias("guid"), *(c.cast("bigint").alias(n) for n, c in numbers.items()))
    rows = F.concat(F.array(row(F.lit(None), of_chunk)), F.transform(F.array_distinct("template_defs.guid"), lambda g: row(g, dict.fromkeys(of_chunk, F.lit(0)))))
    sums = [F.sum(n).alias(n) for n in of_chunk]
    found = decoded.select("file", F.inline(rows)).groupBy("file", "guid").agg(*sums).groupBy("file").agg(*sums, F.count("guid").alias("definition_count"))
    return found.select("file", "num_chunks", "total_records", "definition_count", "reference_count", "missing_count", "parse_error_count")


def first_seen(decoded: DataFrame) -> DataFrame:
    """(file, guid, first_seen_record): the record that brought a template; 0 where a chunk's table had it."""
    d = template_defs(decoded)
    return d.groupBy("file", "guid").agg(F.min_by(F.col("first_seen_record").cast("bigint"), F.struct("chunk_index", F.when(F.col("first_seen_record") == 0, 0).otherwise(1), "first_seen_record")).alias("first_seen_record"))


def read_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The events of all containers under ``path``."""
    return events(decode(chunks(read_files(spark, path)), parts=["events"]))


def value_text(raw: bytes, kind: int) -> str:
    """A single value on its own, as it would read in an event."""
    return values.render(raw, 0, len(raw), kind)
