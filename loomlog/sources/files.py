"""Files and archives of mixed logs: members with their type and bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_type
from . import ranges, zips

VIEWABLE = ("evtx", "json", "txt", "xml")
#: Chunks, or as many bytes, of a piece (4 MiB).
PIECE_CHUNKS = 64


def read_zip(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(archive, name, type, size, compressed_size, content, problem) of the members of zip files.

    A member that cannot be extracted has no content and tells its problem.
    """
    return zips.read_members(spark, path).drop("place")


def read_single(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Single files as archives of one member; files of other types are left out."""
    found = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    told = found.select(F.col("path").alias("archive"), name.alias("name"), file_type(name).alias("type"), F.col("length").alias("size"), F.col("length").alias("compressed_size"), "content", F.lit(None).cast("string").alias("problem"))
    return told.filter(F.col("type").isin(*VIEWABLE))


def read_pieces(spark: SparkSession, path: str | list[str], chunks_each: int = PIECE_CHUNKS) -> DataFrame:
    """(archive, name, type, size, start, skip, content): single files like ``read_single``, in pieces of whole chunks, so that no row holds a large file.

    ``skip`` is where the first chunk of a piece begins; null where the file is no log. An empty file has an empty piece.
    """
    step = chunks_each * ranges.CHUNK_SIZE

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, size in zip(*(b.column(i).to_pylist() for i in (0, 1)), strict=True):
                system, at = ranges.opened(file)
                with system.open_input_file(at) as f:
                    header = ranges.file_header(f)
                first = header.size if header else 0
                starts = [0, *range(first + step, size, step)]
                skips = [first if header else None, *[0 if header else None] * (len(starts) - 1)]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(starts)), pa.array([size] * len(starts), pa.int64()), pa.array(starts, pa.int64()), pa.array([*starts[1:], size], pa.int64()), pa.array(skips, pa.int32())], names=["path", "size", "start", "stop", "skip"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, size, start, stop, skip in zip(*(c.to_pylist() for c in b.columns), strict=True):
                system, at = ranges.opened(file)
                with system.open_input_file(at) as f:
                    f.seek(start)
                    content = f.read(stop - start)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([size], pa.int64()), pa.array([start], pa.int64()), pa.array([skip], pa.int32()), pa.array([content], pa.binary())], names=["path", "size", "start", "skip", "content"])

    found = spark.read.format("binaryFile").load(path).select("path", "length")  # no content
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = found.mapInArrow(plan, "path string, size bigint, start bigint, stop bigint, skip int").repartition(n).mapInArrow(read, "path string, size bigint, start bigint, skip int, content binary")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return pieces.select(F.col("path").alias("archive"), name.alias("name"), file_type(name).alias("type"), "size", "start", "skip", "content").filter(F.col("type").isin(*VIEWABLE))


def check_viewable(members: DataFrame) -> DataFrame:
    """``members`` of the archives, failing where an archive is empty or has nothing to view."""
    counts = members.groupBy("archive").agg(F.count("name").alias("n"), F.count_if(F.col("type") != "unknown").alias("viewable"), F.array_join(F.slice(F.sort_array(F.collect_set("name")), 1, 20), ", ").alias("names")).collect()
    for c in counts:  # one row an archive
        if not c.n:
            raise ValueError(f"Zip file is empty: {c.archive}")
        if not c.viewable:
            raise ValueError(f"No viewable files found. Files in archive: {c.names}")
    return members


def text_files(members: DataFrame) -> DataFrame:
    """Text and XML members with their text."""
    return members.filter(F.col("type").isin("txt", "xml")).withColumn("text", F.decode(F.col("content"), "UTF-8"))


def json_files(members: DataFrame) -> DataFrame:
    """JSON members with their text and, where it is valid, its value as a VARIANT."""
    return members.filter("type = 'json'").withColumn("text", F.decode(F.col("content"), "UTF-8")).withColumn("value", F.try_parse_json("text"))


def log_files(members: DataFrame) -> DataFrame:
    """Containers among the members, as (file, content)."""
    return members.filter("type = 'evtx' and content is not null").select(F.concat_ws("::", "archive", "name").alias("file"), "content")


def file_list(stored: DataFrame) -> DataFrame:
    """What an archive's page lists: name, size, compressed_size (the size itself once stored), type."""
    return stored.select("name", "size", F.col("size").alias("compressed_size"), "type")
