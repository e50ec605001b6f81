"""Exports: XML dumps, JSON of records, comment blocks, pretty text.

Labels of the detail view and of the comment blocks, and the dump's first and last lines, are fixed values.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import eventxml
from ..functions.text import hex32
from ..sources import ranges

XML_HEAD = '<?xml version="1.0" encoding="utf-8"?>\n<Events>\n'
XML_TAIL = "</Events>"
RECORD_FIELDS = ("record_id", "timestamp", "event_id", "level_text", "provider", "computer", "channel", "event_data", "xml")
_JSON_NAMES = ("recordId", "timestamp", "eventId", "level", "provider", "computer", "channel", "eventData", "xml")
DEFAULT_VIEW = ("timestamp", "level_text", "provider", "event_data")
FULL_VIEW = ("record_id", "timestamp", "level_text", "event_id", "provider", "channel", "computer", "task", "opcode", "keywords", "version", "process_id", "thread_id", "security_user_id", "activity_id", "related_activity_id", "event_data")


def xml_dump(events: DataFrame, by: str = "file", part: str = "chunk_index", order: tuple[str, ...] = ("record_seq",)) -> DataFrame:
    """(by, part, text): the dump of each ``by`` in parts that follow one another, records in order.

    A part holds the records of one chunk, so its size is bounded by the format; the first opens the document
    and the last closes it.
    """
    rows = F.sort_array(F.collect_list(F.struct(*order, F.concat(F.col("xml"), F.lit("\n\n")).alias("x"))))
    parts = events.groupBy(by, part).agg(F.array_join(F.transform(rows, lambda r: r["x"]), "").alias("text"))
    ends = events.groupBy(by).agg(F.min(part).alias("_first"), F.max(part).alias("_last"))
    head, tail = F.when(F.col(part) == F.col("_first"), XML_HEAD).otherwise(""), F.when(F.col(part) == F.col("_last"), XML_TAIL).otherwise("")
    return parts.join(ends, by).select(by, part, F.concat(head, "text", tail).alias("text"))


def write_xml(events: DataFrame, path: str, order: tuple[str, ...] = ("file", "chunk_index", "record_seq")) -> None:
    """A dump of any size as ordered text parts; the first opens the document and the last closes it."""
    spark = events.sparkSession
    ordered = events.orderBy(*order).select(F.col("xml").alias("value"), F.lit("\n").alias("gap"))
    body = ordered.select(F.concat("value", "gap").alias("value"))
    spark.createDataFrame([(XML_HEAD.rstrip("\n"),)], "value string").coalesce(1).unionAll(body).unionAll(spark.createDataFrame([(XML_TAIL,)], "value string").coalesce(1)).write.text(path)


class XmlWriter(DataSourceArrowWriter):
    """Writes the documents of ``XmlSink``."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _staging(self) -> tuple:
        system, at = ranges.opened(self.path)
        return system, at, f"{at}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> XmlParts:
        task = TaskContext.get()
        system, _, staging = self._staging()
        done = XmlParts([])
        out = None
        try:
            for b in iterator:
                for file, xml in zip(b.column("file").to_pylist(), b.column("xml").to_pylist(), strict=True):
                    if not done.parts or done.parts[-1][0] != file:
                        if out is not None:
                            out.close()
                        part = f"{task.partitionId():08d}-{task.taskAttemptId()}-{len(done.parts)}.xml"
                        done.parts.append((file, part))
                        system.create_dir(staging, recursive=True)
                        out = system.open_output_stream(f"{staging}/{part}")
                    out.write(f"{xml or ''}\n\n".encode())
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages: list[XmlParts | None]) -> None:
        from pyarrow import fs

        system, at, staging = self._staging()
        of: dict[str, list[str]] = {}
        for m in messages:
            for file, part in m.parts if m else ():
                of.setdefault(file, []).append(part)
        for file, parts in of.items():
            folder = f"{at}/{re.sub('[^A-Za-z0-9._-]+', '_', file or 'events')}"
            if system.get_file_info(folder).type != fs.FileType.NotFound:
                if not self.overwrite:
                    raise FileExistsError(folder)
                system.delete_dir(folder)
            system.create_dir(folder, recursive=True)
            for k, part in enumerate(sorted(parts)):
                system.move(f"{staging}/{part}", f"{folder}/1-{k:08d}.xml")
            for name, text in (("0-head.xml", XML_HEAD), ("2-tail.xml", XML_TAIL)):
                with system.open_output_stream(f"{folder}/{name}") as out:
                    out.write(text.encode())
        self.abort(messages)

    def abort(self, messages: list[XmlParts | None]) -> None:
        from pyarrow import fs

        system, _, staging = self._staging()
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


@dataclass
class XmlParts(WriterCommitMessage):
    """(file, name) of the parts of a task, in order."""

    parts: list[tuple[str, str]]


class XmlSink(DataSource):
    """``winlog_xml``: rows (file, xml), sorted by file over the partitions, to a folder a file.

    The files of a folder, one after the other by name, are one well-formed document: a head, parts of the tasks in the order of
    the partitions, a tail. The commit moves parts by name only and writes heads and tails; no text passes through the driver.
    """

    @classmethod
    def name(cls) -> str:
        return "winlog_xml"

    def writer(self, schema: StructType, overwrite: bool) -> XmlWriter:
        if not {"file", "xml"} <= set(schema.names):
            raise ValueError("a document needs the columns file and xml")
        return XmlWriter(self.options["path"], overwrite)


def write_documents(events: DataFrame, path: str, *, order: tuple[str, ...] = ("chunk_index", "record_seq"), overwrite: bool = False) -> None:
    """One XML document for each file of ``events``, of any size. Rows are dealt by ranges of file and order; nothing is sorted as a whole."""
    events.sparkSession.dataSource.register(XmlSink)
    ranged = events.repartitionByRange("file", *order).sortWithinPartitions("file", *order).select("file", "xml")
    ranged.write.format("winlog_xml").mode("overwrite" if overwrite else "append").save(path)


def record_json(events: DataFrame) -> DataFrame:
    """(record_id, json) with the nine fields of a copied record, indented."""
    fields = F.struct(*(F.col(c).alias(n) for c, n in zip(RECORD_FIELDS, _JSON_NAMES, strict=True)))
    return events.select("record_id", F.to_json(fields, {"pretty": "true"}).alias("json"))


def result_json(events: DataFrame) -> DataFrame:
    return events.select(F.to_json(F.struct("*")).alias("value"))


def detail_rows(events: DataFrame) -> DataFrame:
    """(record_id, section, position, label, value) of the detail view, without empty values."""
    named = (
        ("", (("Event ID", "event_id"), ("Level", "level_text"), ("Time Created", "timestamp"), ("Source", "provider"), ("Computer", "computer"), ("Channel", "channel"))),
        ("Execution", (("Process ID", "process_id"), ("Thread ID", "thread_id"))),
        ("Additional Info", (("Task", "task"), ("Opcode", "opcode"), ("Keywords", "keywords"), ("Version", "version"), ("Record ID", "record_id"))),
        ("Security", (("User ID", "security_user_id"),)),
        ("Correlation", (("Activity ID", "activity_id"), ("Related Activity ID", "related_activity_id"))),
    )
    entries = [F.struct(F.lit(s).alias("section"), F.lit(label).alias("label"), F.col(c).cast("string").alias("value")) for s, fields in named for label, c in fields]
    rows = events.select("record_id", F.posexplode(F.array(*entries)).alias("position", "d"))
    return rows.select("record_id", "d.section", "position", "d.label", "d.value").filter("value <> ''")


def pretty_xml(xml: Column) -> Column:
    """Indented text. Indentation depends on all tags before, which no built-in function follows."""

    @F.pandas_udf("string")
    def indented(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else eventxml.pretty(x))

    return indented(xml)


def text_with_lines(files: DataFrame, text: str = "text") -> DataFrame:
    return files.withColumn("line_count", F.size(F.split(text, "\n")))


def _used(values: Column, label: str) -> Column:
    """The non-zero entries with their places, four a line."""
    entries = F.filter(F.transform(values, lambda x, i: F.when(x != 0, F.concat(F.lit("["), i.cast("string"), F.lit("]="), hex32(x)))), lambda x: x.isNotNull())
    n = F.size(entries)
    lines = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 4).cast("int")), lambda k: F.concat(F.lit("    "), F.array_join(F.slice(entries, k * 4 + 1, 4), "  ")))
    return F.when(n == 0, F.lit(f"  {label} (none)")).otherwise(F.concat(F.lit(f"  {label[:-1]} ("), n.cast("string"), F.lit(" used):\n"), F.array_join(lines, "\n")))


def chunk_comments(headers: DataFrame) -> DataFrame:
    """(file, chunk_index, comment) of chunk headers."""
    c, s = F.col, lambda x: F.col(x).cast("string")
    line = lambda label, *v: F.concat(F.lit(f"  {label}:".ljust(17)), *v)
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("<!-- ═══ Chunk "), s("chunk_index"), F.lit(" ═══")),
        line("fileOffset", hex32(c("chunk_start"))),
        line("records", s("first_event_record_id"), F.lit(" .. "), s("last_event_record_id")),
        line("recordNumbers", s("first_event_record_number"), F.lit(" .. "), s("last_event_record_number")),
        line("headerSize", s("header_size")),
        line("lastRecOff", hex32(c("last_event_record_offset"))),
        line("freeSpaceOff", hex32(c("free_space_offset"))),
        line("evtRecCRC32", hex32(c("event_records_checksum"))),
        line("hdrCRC32", hex32(c("header_checksum"))),
        line("flags", hex32(c("flags")), F.when(c("flags").bitwiseAND(1) == 1, " (CORRUPTED)").otherwise("")),
        _used(c("common_string_offsets"), "commonStrings:"),
        _used(c("template_pointers"), "templatePtrs:"),
        F.lit("-->"),
    )
    return headers.select("file", "chunk_index", text.alias("comment"))


def record_comments(records: DataFrame) -> DataFrame:
    """(file, chunk_index, record_seq, comment) of physical records."""
    c, s = F.col, lambda x: F.col(x).cast("string")
    line = lambda label, *v: F.concat(F.lit(f"  {label}:".ljust(17)), *v)
    first = c("binxml_first_byte")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("<!-- record="), s("record_id")),
        line("timestamp", c("timestamp")),
        line("chunk", s("chunk_index")),
        line("fileOffset", hex32(c("file_offset"))),
        line("chunkOffset", hex32(c("chunk_offset"))),
        line("size", s("size"), F.lit(" bytes")),
        line("sizeCopy", s("size_copy"), F.when(c("size_match"), " (match)").otherwise(" (MISMATCH!)")),
        line("binxml", F.lit("length="), s("binxml_length"), F.lit(" bytes")),
        F.when(first.isNotNull(), line("binxmlStart", F.lit("0x"), F.lpad(F.hex(first), 2, "0"), F.when(first == 0x0F, " (FragmentHeader)").otherwise(" (UNEXPECTED!)"))),
        F.lit("-->"),
    )
    return records.select("file", "chunk_index", "record_seq", text.alias("comment"))
