"""``winlog``: logs of any size as a source for batches and streams and as a sink, and ``winlog_chunks``, the heads of their chunks.

Chunks have a fixed size, so a partition is a byte range of whole chunks; no task holds a whole file.

Reading. Option ``path``: a file, folder or URI; ``chunksPerPartition``: 512 by default (32 MiB); ``badFiles``: ``fail`` (the
default) or ``row``, which gives a row with ``error`` for a file that is no log. A schema of some columns, as in
``spark.read.format("winlog").schema("record_id bigint, xml string")``, reads only those: without texts no record is decoded. Conditions on
``record_id``, ``timestamp``, ``file`` and ``chunk_place`` are pushed: files and, by their headers, chunks are skipped unread, other records undecoded.
``record_id`` is null where it leaves 63 bits. ``load`` adds dense chunk indexes and times.

Streaming. The offset holds how many chunks of each file have been read, so of a growing log only what is new is read. Of a log that its
header calls open, the last chunk waits until it is followed by another or the log is closed. ``maxChunksPerTrigger`` bounds a batch.

Writing. Rows with ``record_id``, ``ticks`` and the columns of ``encoder.SLOTS`` become containers, in the order in which they come; an
optional ``file`` names them. A task writes to a staging folder, and the commit moves what has succeeded; ``maxChunksPerFile`` is where a
file is followed by another.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import datasource as api
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.text import level_text
from ..functions.time import filetime_timestamp
from . import encoder, ranges
from .ranges import Condition, Span

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
STEP = 512
_SQL = {pa.string(): "string", pa.int64(): "bigint", pa.int32(): "int", pa.float64(): "double", pa.bool_(): "boolean", pa.decimal128(20, 0): "decimal(20,0)"}
TYPES = {n: _SQL[t] for n, t in ranges.EVENT_TYPES.items()}
HEAD_TYPES = {n: _SQL[t] for n, t in ranges.HEAD_TYPES.items()}
_PUSHED = ("record_id", "timestamp", "file", "chunk_place")
#: Filters that are taken, by their kind.
_KINDS = {api.EqualTo: "=", api.GreaterThan: ">", api.GreaterThanOrEqual: ">=", api.LessThan: "<", api.LessThanOrEqual: "<=", api.In: "in", api.IsNotNull: "is not null"}


def ddl(types: dict[str, str]) -> str:
    return ", ".join(f"{n} {t}" for n, t in types.items())


def _option(options: dict, name: str, default: str) -> str:
    return options.get(name, options.get(name.lower(), default))


def _asked(schema: StructType, types: dict[str, str]) -> list[str]:
    for f in schema.fields:
        if types.get(f.name) != f.dataType.simpleString():
            raise ValueError(f"no column {f.name} {f.dataType.simpleString()}: there are {ddl(types)}")
    return schema.names


class _Partition(InputPartition):
    def __init__(self, value: Span) -> None:
        super().__init__(value)
        self.span = value


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict, types: dict[str, str]) -> None:
        self.path, self.step = options["path"], int(_option(options, "chunksPerPartition", str(STEP)))
        self.bad_rows = _option(options, "badFiles", "fail") == "row"
        self.asked = _asked(schema, types)
        self.conditions: list[Condition] = []

    def partitions(self) -> list[InputPartition]:
        out = []
        for system, info in ranges.listed(self.path):
            if not all(c.holds(info.path) for c in self.conditions if c.column == "file"):
                continue
            with system.open_input_file(info.path) as f:
                header = ranges.file_header(f)
            if header is None:
                if not self.bad_rows:
                    raise ValueError(f"not a binary log: {info.path}")
                out.append(_Partition(Span(info.path, 0, 0, 0, 0, 0, f"not a binary log: {info.path}")))
                continue
            n = ranges.places(info.size, header)
            found = ranges.spans(info.path, header.size, 0, n, n, self.step)
            placed = [c for c in self.conditions if c.column == "chunk_place"]
            out += [_Partition(s) for s in found if not placed or any(ranges.at_place(k, placed) for k in range(s.first, s.first + s.count))]
        return out


class WinlogReader(_Reader):
    def __init__(self, schema: StructType, options: dict) -> None:
        super().__init__(schema, options, TYPES)
        self.count: dict[str, int] = {}

    def pushFilters(self, filters: list[api.Filter]) -> Iterable[api.Filter]:
        for f in filters:
            how, column = _KINDS.get(type(f)), ".".join(getattr(f, "attribute", ()))
            if how and column in _PUSHED:
                self.conditions.append(Condition(column, how, getattr(f, "value", None)))
            else:
                yield f

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # where there are no partitions, Spark asks for one without a place
            return iter(())
        conditions = [c for c in self.conditions if c.column != "file"]
        return ranges.event_batches(self.path, partition.span, self.asked, conditions, self.count)


class HeadReader(_Reader):
    def __init__(self, schema: StructType, options: dict) -> None:
        super().__init__(schema, options, HEAD_TYPES)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return ranges.head_batches(self.path, partition.span, self.asked) if partition is not None and not partition.span.error else iter(())


class WinlogStreamReader(DataSourceStreamReader):
    """Offsets are {file: chunks read}; -1 for a file that is no log, which has given its row then."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.path, self.step = options["path"], int(_option(options, "chunksPerPartition", str(STEP)))
        self.limit = int(_option(options, "maxChunksPerTrigger", "0"))
        self.asked = _asked(schema, TYPES)
        self.reached: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        self.reached = {}
        return {}

    def _ready(self, f, header: ranges.Header, size: int, done: int) -> int:
        """How many places of a log are ready to be read."""
        n = ranges.places(size, header)
        if not header.is_dirty:
            return n
        magic, k = bytes(ranges.container.CHUNK_MAGIC), max(0, done)
        while k < n:
            f.seek(header.size + k * ranges.CHUNK_SIZE)
            if not f.read(len(magic)).startswith(magic):
                break
            k += 1
        return max(done, k - 1)  # the last one may still grow

    def latestOffset(self) -> dict:
        done = dict(self.reached or {})
        left = self.limit if self.limit and self.reached is not None else None
        for system, info in ranges.listed(self.path):
            before = done.get(info.path, 0)
            with system.open_input_file(info.path) as f:
                header = ranges.file_header(f)
                now = -1 if header is None else self._ready(f, header, info.size, max(0, before))
            if left is not None and now > before:
                now = min(now, max(0, before) + left)
                left -= now - max(0, before)
            if now != before:
                done[info.path] = now
        self.reached = done
        return done

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.reached = dict(end)
        system, _ = ranges.opened(self.path)
        out = []
        for file, now in sorted(end.items()):
            before = start.get(file, 0)
            if now == before:
                continue
            if now < 0:
                out.append(_Partition(Span(file, 0, 0, 0, 0, 0, f"not a binary log: {file}")))
                continue
            with system.open_input_file(file) as f:
                header = ranges.file_header(f)
                total = ranges.places(f.size(), header)
            out += [_Partition(s) for s in ranges.spans(file, header.size, max(0, before), now, total, self.step)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return ranges.event_batches(self.path, partition.span, self.asked)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


class WinlogWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool) -> None:
        missing = {"record_id", "ticks", *encoder.SLOTS} - set(schema.names)
        if missing:
            raise ValueError(f"a log needs the columns {', '.join(sorted(missing))}")
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.most = int(_option(options, "maxChunksPerFile", "16384"))
        self.job = uuid.uuid4().hex

    def _staging(self) -> tuple:
        system, at = ranges.opened(self.path)
        return system, at, f"{at}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, _, staging = self._staging()
        system.create_dir(staging, recursive=True)
        done, task = _Written(), TaskContext.get()
        name, out, writer, chunks = None, None, encoder.ChunkWriter(), 0

        def end_chunk() -> None:
            nonlocal writer, chunks
            if writer.ids:
                out.write(writer.bytes())
                chunks += 1
            writer = encoder.ChunkWriter()

        def begin(wanted: str) -> None:
            nonlocal name, out, chunks
            if out is not None:
                end_chunk()
                out.close()
            name, chunks = wanted, 0
            done.files.append(f"{wanted.removesuffix('.evtx').replace('/', '_').replace(':', '_')}-{task.partitionId():05d}-{len(done.files):05d}-{task.taskAttemptId()}.evtx")
            out = system.open_output_stream(f"{staging}/{done.files[-1]}")
            out.write(encoder.file_header())

        try:
            for b in iterator:
                for row in b.to_pylist():
                    wanted = row.get("file") or "events"
                    if wanted != name:
                        begin(wanted)
                    texts = encoder.event_values({n: "" if row[n] is None else row[n] for n in encoder.SLOTS})
                    small = all(len(v) < ranges.CHUNK_SIZE for _, v in texts)
                    if small and writer.add(int(row["record_id"]), int(row["ticks"]), texts):
                        continue
                    end_chunk()
                    if chunks >= self.most:
                        begin(wanted)
                    if not small or not writer.add(int(row["record_id"]), int(row["ticks"]), texts):
                        raise ValueError("an event does not fit into a chunk")
            if out is not None:
                end_chunk()
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, at, staging = self._staging()
        system.create_dir(at, recursive=True)
        if self.overwrite:
            for _, info in ranges.listed(self.path):
                system.delete_file(info.path)
        for m in messages:
            for name in m.files if m else ():
                system.move(f"{staging}/{name}", f"{at}/{name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, _, staging = self._staging()
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


class WinlogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "winlog"

    def schema(self) -> str:
        return ddl(TYPES)

    def reader(self, schema: StructType) -> DataSourceReader:
        return WinlogReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return WinlogStreamReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WinlogWriter(schema, dict(self.options), overwrite)


class HeadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "winlog_chunks"

    def schema(self) -> str:
        return ddl(HEAD_TYPES)

    def reader(self, schema: StructType) -> DataSourceReader:
        return HeadReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Both formats; pushed conditions are turned on in the session, without which Spark refuses a source that takes them."""
    spark.dataSource.register(WinlogSource)
    spark.dataSource.register(HeadSource)
    spark.conf.set(PUSHDOWN, "true")


#: Columns of ``load`` that are derived from others.
_DERIVED = {"chunk_index": ("file", "span", "chunk_rank"), "level_text": ("level",), "ts": ("ticks",)}
COLUMNS = ("file", "chunk_index", "record_seq", "record_id", "timestamp", "xml", "event_id", "level", "level_text", *(n for n in ranges.NAMES if n not in ("event_id", "level")), "ticks", "ts")


def load(spark: SparkSession, path: str, columns: Iterable[str] = COLUMNS, *, step: int = STEP) -> DataFrame:
    """The columns of ``container.events`` that are asked, chunk indexes dense as there: a place without a chunk has none.

    Indexes need a first pass over the heads, which counts the holes before each range; where a log has none, Spark drops
    the join with the empty result.
    """
    register(spark)
    columns = list(columns)
    read = dict.fromkeys(x for c in columns for x in _DERIVED.get(c, (c,)))
    rows = spark.read.format("winlog").schema(ddl({n: TYPES[n] for n in read})).option("chunksPerPartition", step).load(path)
    if "chunk_index" in columns:
        heads = spark.read.format("winlog_chunks").schema("file string, span bigint, is_chunk boolean").option("chunksPerPartition", step).load(path)
        counted = heads.groupBy("file", "span").agg(F.count_if(~F.col("is_chunk")).alias("holes"))  # a row for each range
        before = F.sum("holes").over(Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
        shifts = counted.select("file", "span", before.alias("shift")).filter("shift > 0")
        rows = rows.join(shifts, ["file", "span"], "left").withColumn("chunk_index", (F.col("span") * step + F.col("chunk_rank") - F.coalesce("shift", F.lit(0))).cast("int"))
    made = {"level_text": lambda: level_text(F.col("level")), "ts": lambda: filetime_timestamp(F.col("ticks"))}
    return rows.select(*(made[c]().alias(c) if c in made else F.col(c) for c in columns))
