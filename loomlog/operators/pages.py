"""Pages of logs by prefix sums: a table of how many rows come before each chunk, by which a page reads its own chunks only.

The natural order is that of files by path, chunks by place and records by sequence. The sums are built once, in one scan that decodes
no event: chunks of a range are summed within it, ranges within their file, files by their totals, so the longest run of any
task is a file's ranges or the files. A page of any depth then costs the lookup and its few chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import datasource
from .search import PAGE_SIZES

SUMS = "file string, chunk_place bigint, n bigint, start bigint"


def _before(value: str, by: list[str], order: str) -> object:
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0)).cast("bigint")


def row_sums(spark: SparkSession, path: str, *, step: int = datasource.STEP) -> DataFrame:
    """``SUMS``: of each chunk with rows how many it has, and how many come before it in all logs under ``path``."""
    datasource.register(spark)
    rows = spark.read.format("winlog").schema("file string, span bigint, chunk_place bigint, record_seq int").option("chunksPerPartition", step).load(path)
    chunks = rows.groupBy("file", "span", "chunk_place").agg(F.count(F.lit(1)).alias("n"))
    spans = chunks.groupBy("file", "span").agg(F.sum("n").alias("n"))
    files = spans.groupBy("file").agg(F.sum("n").alias("n")).select("file", _before("n", [], "file").alias("of_file"))
    spans = spans.select("file", "span", _before("n", ["file"], "span").alias("of_span")).join(files, "file")
    placed = chunks.withColumn("of_chunk", _before("n", ["file", "span"], "chunk_place")).join(spans, ["file", "span"])
    return placed.select("file", "chunk_place", "n", (F.col("of_file") + F.col("of_span") + F.col("of_chunk")).alias("start"))


class LogPages:
    """Pages of the logs under ``path``, with the sums kept in the Parquet folder ``table``, sorted, so that a lookup reads little of it."""

    def __init__(self, spark: SparkSession, path: str, table: str) -> None:
        self.spark, self.path, self.table = spark, path, table

    def build(self) -> LogPages:
        row_sums(self.spark, self.path).repartitionByRange("start").sortWithinPartitions("start").write.mode("overwrite").parquet(self.table)
        return self

    def sums(self) -> DataFrame:
        return self.spark.read.schema(SUMS).parquet(self.table)

    def total(self) -> int:
        return self.sums().agg(F.coalesce(F.max(F.col("start") + F.col("n")), F.lit(0))).first()[0]

    def chunks(self, first: int, end: int) -> list:
        """The chunks that hold the rows from ``first`` up to ``end``: at most as many as rows."""
        return self.sums().filter((F.col("start") < end) & (F.col("start") + F.col("n") > first)).orderBy("start").collect()

    def page(self, number: int, size: int = 100, columns: tuple[str, ...] = ("record_id", "timestamp", "level", "provider", "event_id", "computer", "channel", "event_data")) -> DataFrame:
        """One page in natural order; numbers beyond the last page mean the last page."""
        if size not in PAGE_SIZES:
            raise ValueError(f"page size {size} is not one of {PAGE_SIZES}")
        total = self.total()
        first = max(0, min(number, max(1, -(-total // size)) - 1)) * size
        held = self.chunks(first, first + size)
        place = [c for c in ("file", "chunk_place", "record_seq") if c not in columns]
        types = datasource.ddl({c: datasource.TYPES[c] for c in (*columns, *place)})
        rows = self.spark.read.format("winlog").schema(types).load(self.path)
        of = {}
        for c in held:
            of.setdefault(c.file, []).append(c.chunk_place)
        mine = F.lit(False)
        for file, places in of.items():
            mine |= (F.col("file") == file) & F.col("chunk_place").isin(places)
        # in conditions of their own, files and places reach the source; together they name the chunks
        rows = rows.filter(F.col("file").isin(list(of)) & F.col("chunk_place").isin(sorted({c.chunk_place for c in held})) & mine)
        return rows.orderBy("file", "chunk_place", "record_seq").offset(first - held[0].start if held else 0).limit(size).select(*columns)
