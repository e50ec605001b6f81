"""Integrity checks of chunks and records, as rows (file, chunk_index, phase, record_seq, check_id, message).

The texts of the messages are fixed values.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import container


_GAP, _HEAD, _TAIL = range(3)


def _same(a: pa.Table, b: pa.Table, names: list[str]) -> pa.ChunkedArray:
    """Row by row, whether both have the same key; nulls are equal."""
    found = None
    for n in names:
        equal = pc.or_(pc.fill_null(pc.equal(a[n], b[n]), False), pc.and_(pc.is_null(a[n]), pc.is_null(b[n])))
        found = equal if found is None else pc.and_(found, equal)
    return found if found is not None else pa.chunked_array([pa.array([True] * a.num_rows)])


def _gaps_in_range(partition: list[str], value: str):
    """Sorted rows of one range to those that do not follow the row before, and the first and last of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        number = TaskContext.get().partitionId()

        def told(rows: pa.Table, previous: pa.ChunkedArray | None, kind: int) -> Iterator[pa.RecordBatch]:
            n = rows.num_rows
            if n:
                previous = pa.nulls(n, rows[value].type) if previous is None else previous
                yield from rows.append_column("previous", previous).append_column("_kind", pa.array([kind] * n, pa.int32())).append_column("_range", pa.array([number] * n, pa.int32())).to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b])
            if held is None:
                yield from told(rows.slice(0, 1), None, _HEAD)
            else:
                rows = pa.concat_tables([held, rows])
            before, after = rows.slice(0, rows.num_rows - 1), rows.slice(1)
            same = _same(before, after, partition)
            follows = pc.equal(after[value], pc.add(before[value], 1))
            gap = pc.and_(same, pc.fill_null(pc.invert(follows), False))
            yield from told(after.filter(gap), before[value].filter(gap), _GAP)
            other = pc.invert(same)
            yield from told(after.filter(other), None, _HEAD)
            yield from told(before.filter(other), None, _TAIL)
            held = rows.slice(rows.num_rows - 1)
        if held is not None:
            yield from told(held, None, _TAIL)

    return run


def sequence_gaps(rows: DataFrame, partition: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value does not follow the one before, with that as ``previous``.

    Rows are dealt by ranges of key and order, so a key of any size is spread; a range finds its own gaps in one pass. Across ranges
    only the first and last row of each key are compared: two rows for each range and key.
    """
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    value_type = dict(rows.dtypes)[value]
    ranged = rows.repartitionByRange(*partition, order).sortWithinPartitions(*partition, order)
    found = ranged.mapInArrow(_gaps_in_range(partition, value), f"{kinds}, previous {value_type}, _kind int, _range int")
    ends = found.filter(F.col("_kind") != _GAP)
    before = F.lag(value).over(Window.partitionBy(*partition).orderBy("_range", "_kind"))
    across = ends.withColumn("previous", before).filter((F.col("_kind") == _HEAD) & (F.col(value) != F.col("previous") + 1))
    return found.filter(F.col("_kind") == _GAP).unionByName(across).drop("_kind", "_range")


def count_mismatch(rows: DataFrame, partition: list[str], first: str, last: str, n: str) -> DataFrame:
    return rows.select(*partition, (F.col(last) - F.col(first) + 1).alias("expected"), F.col(n).alias("found")).filter("expected <> found")


def _message(template: str, *args: Column) -> Column:
    """``{}`` filled in with the arguments as text."""
    parts = template.split("{}")
    filled = [F.lit(parts[0])]
    for a, p in zip(args, parts[1:], strict=True):
        filled += [a.cast("string"), F.lit(p)]
    return F.concat(*filled)


def warnings(decoded: DataFrame) -> DataFrame:
    """All findings in the order of ``phase`` and ``record_seq``: chunk flag, count, gaps, then each record's.

    Everything is computed within the chunk's own row, so there is no shuffle.
    """
    h, r = F.col("header"), F.col("records")
    n, ci = F.size(r), F.col("chunk_index")
    ids = h["first_event_record_id"], h["last_event_record_id"]
    row = lambda phase, seq, check, message: F.struct(F.lit(phase).alias("phase"), seq.cast("int").alias("record_seq"), F.lit(check).alias("check_id"), message.alias("message"))
    none = F.lit(None)
    chunk_level = F.array(
        F.when(h["flags"].bitwiseAND(1) == 1, row(0, none, "D1", _message("Chunk {}: has dirty/corrupted flag (0x01) — often benign, e.g. unclean shutdown", ci))),
        F.when(ids[1] - ids[0] + 1 != n, row(1, none, "D2", _message("Chunk {}: expected {} records (IDs {}..{}), found {}", ci, ids[1] - ids[0] + 1, *ids, n))),
    )
    previous = lambda i: F.get(r, i - 1)["record_id"]
    gaps = F.transform(r, lambda x, i: F.when((i > 0) & (x["record_id"] != previous(i) + 1), row(2, x["record_seq"], "D3", _message("Chunk {}, record {}: non-sequential ID (previous was {})", ci, x["record_id"], previous(i)))))

    def of_record(x: Column) -> Column:
        rid, first, length = x["record_id"], x["binxml_first_byte"], x["binxml_length"]
        return F.array(
            F.when(x["size"] != x["size_copy"], row(3, x["record_seq"], "D4", _message("Record {}: size mismatch — header says {}, trailing copy says {}", rid, x["size"], x["size_copy"]))),
            F.when(first != 0x0F, row(3, x["record_seq"], "D5", _message("Record {}: BinXml starts with 0x{} instead of 0x0F (FragmentHeader)", rid, F.lpad(F.hex(first), 2, "0")))),
            F.when(length == 0, row(3, x["record_seq"], "D6", _message("Record {}: empty BinXml payload (0 bytes)", rid))),
            F.when((length > 0) & (length < 4), row(3, x["record_seq"], "D7", _message("Record {}: BinXml payload suspiciously small ({} bytes)", rid, length))),
            F.when(x["ticks"] == 0, row(3, x["record_seq"], "D8", _message("Record {}: missing or zero timestamp", rid))),
        )

    found = F.filter(F.concat(chunk_level, gaps, F.flatten(F.transform(r, of_record))), lambda x: x.isNotNull())
    return decoded.select("file", "chunk_index", F.posexplode(found).alias("pos", "w")).select("file", "chunk_index", "w.phase", "w.record_seq", "w.check_id", "w.message", "pos").orderBy("file", "chunk_index", "pos").drop("pos")


def checksums(chunks: DataFrame) -> DataFrame:
    """An extension: of each chunk (file, chunk_index, chunk), whether the stored checksums of its records and header hold."""
    c = F.col("chunk")
    at = lambda o: container.little_endian(c, o, 4)
    records = F.substring(c, 513, (at(48) - 512).cast("int"))
    header = F.concat(F.substring(c, 1, 120), F.substring(c, 129, 384))
    return chunks.select("file", "chunk_index", (F.crc32(records) == at(52)).alias("records_ok"), (F.crc32(header) == at(124)).alias("header_ok"))
