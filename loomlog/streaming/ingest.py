"""Incremental ingestion: new logs, and new chunks of logs that grow, each decoded once, with progress, durations and errors.

The stream reads ranges of chunks, so a restart repeats none and a growing log is never read again from its start. A batch
writes its events and its status rows to folders of its own number and overwrites them when it is repeated.

Status rows (``STATUS``) say for each batch and file how far the file has been read: ``progress``, ``done`` once all its chunks
are, or ``error`` with what was wrong; a file that cannot be read stops no other. ``QueryStatus`` listens to the query and tells the
duration of each batch and how the query ended.

``batches`` gives the rows of a log in groups that end at chunk borders, with the progress.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.text import level_text
from ..functions.time import filetime_timestamp
from ..sources import datasource

BATCH_ROWS = 500
STATUS = "file string, batch bigint, state string, rows bigint, chunks bigint, fraction double, milliseconds double, error string, at timestamp"
_GROUP = pa.schema([("file", pa.string()), ("batch", pa.int32()), ("first_chunk", pa.int32()), ("last_chunk", pa.int32()), ("n", pa.int64()), ("ends", pa.bool_())])
QUERY_STATUS = "run string, batch bigint, state string, rows bigint, milliseconds bigint, error string, at timestamp"


def stream_events(spark: SparkSession, path: str, *, chunks_per_batch: int = 0, chunks_per_partition: int = datasource.STEP) -> DataFrame:
    """A stream of the events of the logs under ``path``, with all columns of the source."""
    datasource.register(spark)
    return spark.readStream.format("winlog").option("maxChunksPerTrigger", chunks_per_batch).option("chunksPerPartition", chunks_per_partition).load(path)


def file_status(batch: DataFrame, number: int) -> DataFrame:
    """``STATUS`` rows of a batch of the source's rows."""
    read = F.max("chunk_place") + 1
    told = batch.groupBy("file").agg(
        F.count("record_seq").alias("rows"), F.count_distinct("chunk_place").alias("chunks"), (read / F.max("chunk_total")).alias("fraction"), F.sum("chunk_ms").alias("milliseconds"), F.max("error").alias("error")
    )
    state = F.when(F.col("error").isNotNull(), "error").when(F.col("fraction") >= 1, "done").otherwise("progress")
    return told.select("file", F.lit(number).cast("bigint").alias("batch"), state.alias("state"), "rows", "chunks", "fraction", F.coalesce("milliseconds", F.lit(0.0)).alias("milliseconds"), "error", F.current_timestamp().alias("at"))


class QueryStatus(StreamingQueryListener):
    """``QUERY_STATUS`` rows of the streaming queries with the id ``query``: each batch with its duration, then ``done`` or ``error``.

    They are appended as JSON under ``path``, one small file each, and are there once the listener bus has passed them on.
    """

    def __init__(self, spark: SparkSession, path: str, query: str | None = None) -> None:
        self.spark, self.path, self.query = spark, path, query

    def _tell(self, run: object, batch: int | None, state: str, rows: int | None = None, milliseconds: int | None = None, error: str | None = None) -> None:
        row = self.spark.createDataFrame([(str(run), batch, state, rows, milliseconds, error)], QUERY_STATUS.rsplit(", ", 1)[0])
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(self.path)

    def _mine(self, event: object) -> bool:
        return self.query is None or str(event.id) == self.query

    def onQueryStarted(self, event) -> None:
        if self._mine(event):
            self._tell(event.runId, None, "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self._mine(p):
            self._tell(p.runId, p.batchId, "progress", p.numInputRows, json.loads(p.json).get("durationMs", {}).get("triggerExecution"))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self._mine(event):
            self._tell(event.runId, None, "error" if event.exception else "done", error=event.exception)


def ingest(spark: SparkSession, path: str, table: str, checkpoint: str, *, status: str | None = None, on_batch: Callable[[int, int], None] | None = None, available_now: bool = True, chunks_per_batch: int = 0) -> StreamingQuery:
    """Append the events of new chunks to the Parquet folder ``table`` and, where ``status`` is given, ``STATUS`` rows to that folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()  # events and status come of one decoding
        try:
            events = batch.filter("error is null").select(*(c for c in datasource.COLUMNS if c in batch.columns), "chunk_place", level_text(F.col("level")).alias("level_text"), filetime_timestamp(F.col("ticks")).alias("ts"))
            events.write.mode("overwrite").parquet(f"{table}/batch={number}")
            if status:
                file_status(batch, number).write.mode("overwrite").parquet(f"{status}/part={number}")
            if on_batch:
                on_batch(number, batch.filter("error is null").count())
        finally:
            batch.unpersist()

    writer = stream_events(spark, path, chunks_per_batch=chunks_per_batch).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def latest_status(spark: SparkSession, status: str) -> DataFrame:
    """Of each file the last ``STATUS`` row, with rows, chunks and milliseconds of all its batches."""
    rows = spark.read.parquet(status)
    last = F.max_by(F.struct("state", "fraction", "error", "at"), "batch")
    return rows.groupBy("file").agg(F.max("batch").alias("batch"), F.sum("rows").alias("rows"), F.sum("chunks").alias("chunks"), F.sum("milliseconds").alias("milliseconds"), last.alias("last")).select("file", "batch", "last.state", "rows", "chunks", "last.fraction", "milliseconds", "last.error", "last.at")


def _fold(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(file, chunk_index, n) in order to (file, batch, first_chunk, last_chunk, n, ends), with one group as state."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, batch, first, last, n = None, 0, None, None, 0
        for b in found:
            out: list[tuple] = []
            for name, chunk, more in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name != file:
                    if first is not None:
                        out.append((file, batch, first, last, n, True))
                    file, batch, first, n = name, 0, None, 0
                elif first is not None and n >= rows:  # the group is full, and another chunk follows
                    out.append((file, batch, first, last, n, False))
                    batch, first, n = batch + 1, None, 0
                first, last, n = chunk if first is None else first, chunk, n + more
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(_GROUP.names, r, strict=True)) for r in out], schema=_GROUP)
        if first is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(_GROUP.names, (file, batch, first, last, n, True), strict=True))], schema=_GROUP)

    return run


def batches(decoded: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """(file, batch, first_chunk, last_chunk, n, progress): groups of at least ``rows`` rows, whole chunks each.

    A group ends with the chunk at which its rows reach the limit; the last may have fewer. The sizes of a file's chunks (a
    few bytes for each 64 KiB of log) pass through one task in order, which keeps a single group.
    """
    sizes = decoded.select("file", "chunk_index", F.size("events").cast("bigint").alias("n"))
    groups = sizes.repartition("file").sortWithinPartitions("file", "chunk_index").mapInArrow(_fold(rows), "file string, batch int, first_chunk int, last_chunk int, n bigint, ends boolean")
    totals = decoded.groupBy("file").agg(F.count(F.lit(1)).alias("total"))
    progress = F.when(F.col("ends"), 1.0).otherwise((F.col("last_chunk") + 1) / F.col("total"))
    return groups.filter("n > 0").join(totals, "file").select("file", "batch", "first_chunk", "last_chunk", "n", progress.alias("progress"))
