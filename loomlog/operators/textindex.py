"""Substring search over a stored table that reads only blocks that can hold the text.

Rows are stored in blocks of a fixed number. Of each block and searched column a Bloom filter with one hash says which groups of three
characters occur in lower case; it is kept by slots, not by blocks: rows (slot, block), sorted by slot, of a Parquet table. A search of
any text reads the rows of the text's own slots, which statistics of row groups and pages find, and the blocks that have all
of them are candidates. Their numbers reach the scan as ranges, so row groups and pages of other blocks stay unread. The
plain condition is checked on what is read: hits are those of ``search.search``.

Texts of under three characters, and columns that are not indexed, leave all blocks as candidates. Null texts have no groups and
match nothing; an empty table has no blocks. A part is staged and named last: one that breaks off on the way is never seen.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from . import search
from .search import SearchFilters

SLOTS = 1 << 16
BLOCK_ROWS = 4096
#: Slots of a text that are looked up: any number of them is a necessary condition, and more tell little.
LOOKED_UP = 24
#: Candidates that are sent to the scan as ranges; of more, a join keeps the rows.
LISTED = 2000
_KEY = ["part", "block"]


def grams(lowered: Column) -> Column:
    """The slots of the groups of three characters in a text."""
    chars = F.split(lowered, "")
    pairs = F.zip_with(chars, F.slice(chars, F.lit(2), F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b))
    threes = F.zip_with(pairs, F.slice(chars, F.lit(3), F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.transform(F.filter(threes, lambda x: F.length(x) == 3), lambda x: F.pmod(F.xxhash64(x), F.lit(SLOTS)).cast("int")))


def _shifted(slots: Column, by: int) -> Column:
    return F.transform(F.coalesce(slots, F.array().cast("array<int>")), lambda s: s + F.lit(by))


def _either(parts: list[Column]) -> Column:
    """Their disjunction as a balanced tree."""
    while len(parts) > 1:
        parts = [reduce(lambda a, b: a | b, parts[k : k + 2]) for k in range(0, len(parts), 2)]
    return parts[0] if parts else F.lit(False)


def _runs(numbers: list[int]) -> Iterator[tuple[int, int]]:
    first = last = None
    for n in sorted(numbers):
        if last is not None and n == last + 1:
            last = n
            continue
        if last is not None:
            yield first, last
        first = last = n
    if last is not None:
        yield first, last


class TextIndex:
    """Event rows under ``root`` with filters of their blocks for the text ``columns``."""

    def __init__(self, spark: SparkSession, root: str, columns: Sequence[str] = search.QUERY_COLUMNS, *, block_rows: int = BLOCK_ROWS, listed: int = LISTED) -> None:
        self.spark, self.root, self.columns, self.block_rows, self.listed = spark, root.rstrip("/"), tuple(columns), block_rows, listed

    def append(self, events: DataFrame) -> str:
        """Store ``events`` in the order in which they come, as one part; its name. Rows near each other in it share blocks."""
        part = f"p{uuid.uuid4().hex}"  # never read as a number
        staged = f"{self.root}/_staging/{part}"
        numbered = events.withColumn("block", F.expr(f"monotonically_increasing_id() div {self.block_rows}"))
        numbered.write.option("parquet.page.row.count.limit", str(self.block_rows)).parquet(staged)
        stored = self.spark.read.parquet(staged)
        each = [_shifted(grams(F.lower(F.col(c))), k * SLOTS) for k, c in enumerate(self.columns)]
        slots = stored.select("block", F.explode(F.concat(*each)).alias("slot")).distinct()
        slots = slots.repartitionByRange("slot", "block").sortWithinPartitions("slot", "block").select("slot", "block")
        slots.write.option("parquet.page.row.count.limit", str(BLOCK_ROWS)).parquet(f"{self.root}/slots/part={part}")
        shared.rename(self.spark, staged, f"{self.root}/events/part={part}")
        return part

    def parts(self) -> list[str]:
        return [n.removeprefix("part=") for n in shared.children(self.spark, f"{self.root}/events") if n.startswith("part=")]

    def _table(self, name: str) -> DataFrame | None:
        paths = [f"{self.root}/{name}/part={p}" for p in self.parts()]
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*paths) if paths else None

    def events(self) -> DataFrame:
        """All rows, with their part and block."""
        found = self._table("events")
        if found is None:
            raise FileNotFoundError(f"nothing is stored under {self.root}")
        return found

    def _wanted(self, needles: Sequence[str]) -> list[list[int]]:
        """The slots of each text, some of them where it is long; none where it is short."""
        texts = self.spark.createDataFrame([(k, n.lower()) for k, n in enumerate(needles)], "k int, text string")
        return [r.slots for r in texts.select("k", F.slice(grams(F.col("text")), 1, LOOKED_UP).alias("slots")).orderBy("k").collect()]

    def _holding(self, columns: Sequence[str], needles: Sequence[str]) -> DataFrame | None:
        """Blocks that can hold any of the texts in any of the columns; None where all can."""
        wanted = self._wanted(needles)
        if not all(wanted) or not set(columns) <= set(self.columns):
            return None
        found, slots = [], self._table("slots")
        for column in columns:
            base = self.columns.index(column) * SLOTS
            for keys in wanted:
                asked = _either([F.col("slot") == base + s for s in keys])  # single values reach the statistics, long lists only as a range
                found.append(slots.filter(asked).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(keys)).select(*_KEY))
        return reduce(DataFrame.union, found).distinct()

    def candidates(self, filters: SearchFilters) -> DataFrame | None:
        """(part, block) of the blocks that can hold hits; None where all can."""
        conditions = [(search.QUERY_COLUMNS, [filters.query] if filters.query else []), (("provider",), filters.providers), (("computer",), filters.computers)]
        held = [h for columns, needles in conditions if needles and (h := self._holding(columns, needles)) is not None]
        return reduce(lambda a, b: a.join(b, _KEY, "left_semi"), held) if held else None

    def narrowed(self, filters: SearchFilters) -> DataFrame:
        """The rows of the candidates."""
        events, found = self.events(), self.candidates(filters)
        if found is None:
            return events
        some = found.limit(self.listed + 1).collect()
        if len(some) > self.listed:
            return events.join(found, _KEY, "left_semi")
        of: dict[str, list[int]] = {}
        for r in some:
            of.setdefault(r.part, []).append(r.block)
        ranges = [(F.col("part") == p) & F.col("block").between(a, z) for p, blocks in sorted(of.items()) for a, z in _runs(blocks)]
        return events.filter(_either(ranges))

    def search(self, filters: SearchFilters = SearchFilters(), limit: int = search.DEFAULT_LIMIT) -> DataFrame:
        """The newest hits, as ``search.search`` over all rows has them."""
        return search.search(self.narrowed(filters), filters, limit).drop(*_KEY)
