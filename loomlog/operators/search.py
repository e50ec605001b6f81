"""Search and view-side filters over event rows.

A search is one filter and one top-n: predicates compile to a single column expression, and
``orderBy`` with ``limit`` becomes TakeOrderedAndProject, so no full sort runs. List predicates and the
date range reach the scan; substring predicates are checked behind it.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import iso_millis

DEFAULT_LIMIT = 1000
BOX_LIMIT = 100
PAGE_SIZES = (50, 100, 250, 500)
QUERY_COLUMNS = ("event_data", "provider", "event_id", "computer")
VIEWER_COLUMNS = (*QUERY_COLUMNS, "channel")
#: Rows that a top-n may hold to reach a page; deeper pages are narrowed down to so many first.
NEAR_ROWS = 10_000
_PIVOTS, _ROUNDS = 32, 20


@dataclass(frozen=True)
class SearchFilters:
    """Empty or absent filters do not restrict; all others must hold."""

    query: str = ""
    event_ids: Sequence[str] = field(default_factory=tuple)
    providers: Sequence[str] = field(default_factory=tuple)
    levels: Sequence[int] = field(default_factory=tuple)
    computers: Sequence[str] = field(default_factory=tuple)
    channels: Sequence[str] = field(default_factory=tuple)
    archive_ids: Sequence[str] = field(default_factory=tuple)
    file_ids: Sequence[str] = field(default_factory=tuple)
    start: datetime | None = None
    end: datetime | None = None


def contains_any(column: str, needles: Sequence[str]) -> Column:
    """Whether any of the needles is in the column, literally and whatever the case."""
    return reduce(lambda a, b: a | b, [F.lower(F.col(column)).contains(n.lower()) for n in needles])


def any_contains(columns: Sequence[str], needle: str) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(needle.lower()) for c in columns])


def predicate(f: SearchFilters) -> Column:
    parts = [F.col(c).isin(list(v)) for c, v in (("archive_id", f.archive_ids), ("file_id", f.file_ids), ("level", f.levels), ("event_id", f.event_ids), ("channel", f.channels)) if v]
    parts += [contains_any(c, v) for c, v in (("provider", f.providers), ("computer", f.computers)) if v]
    if f.query:
        parts.append(any_contains(QUERY_COLUMNS, f.query))
    millis = iso_millis(F.col("timestamp"))
    as_millis = lambda d: int(d.timestamp() * 1000)
    if f.start:
        parts.append(F.coalesce(millis >= as_millis(f.start), F.lit(False)))
    if f.end:
        parts.append(F.coalesce(millis <= as_millis(f.end), F.lit(False)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def search(events: DataFrame, filters: SearchFilters = SearchFilters(), limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The newest hits: by timestamp text, then by id, both descending."""
    return events.filter(predicate(filters)).orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def search_box(events: DataFrame, text: str) -> DataFrame:
    """What the search box shows; nothing for blank text."""
    return search(events, SearchFilters(query=text), BOX_LIMIT) if text.strip() else events.limit(0)


def hit_text(events: DataFrame) -> DataFrame:
    """(id, label, description) of search hits."""
    preview = F.when(F.length("event_data") > 100, F.concat(F.substring("event_data", 1, 100), F.lit("..."))).otherwise(F.col("event_data"))
    parts = [F.concat_ws(" • ", "provider", "computer"), F.date_format(F.timestamp_millis(iso_millis(F.col("timestamp"))), "MMM d, h:mm:ss a"), preview, F.concat_ws(" / ", "archive_name", "file_name")]
    return events.select("id", F.concat(F.lit("Event "), F.col("event_id"), F.lit(" - "), F.col("level_text")).alias("label"), F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " • ").alias("description"))


def viewer_filter(events: DataFrame, levels: Sequence[int] = (0, 1, 2, 3, 4, 5), text: str = "") -> DataFrame:
    """Rows of the chosen levels (none chosen: no rows) whose text columns, channel included, hold ``text``."""
    kept = events.filter(F.col("level").isin(list(levels)))
    return kept.filter(any_contains(VIEWER_COLUMNS, text)) if text.strip() else kept


def column_filters(events: DataFrame, chosen: dict[str, Sequence[str]] | None = None, typed: dict[str, str] | None = None, anywhere: str = "") -> DataFrame:
    """Filters of the table: chosen values, text in single columns, text in any column."""
    for column, values in (chosen or {}).items():
        if values:
            events = events.filter(F.col(column).isin(list(values)))
    for column, text in (typed or {}).items():
        if text:
            events = events.filter(F.lower(F.col(column).cast("string")).contains(text.lower()))
    if anywhere:
        events = events.filter(reduce(lambda a, b: a | b, [F.lower(F.col(c).cast("string")).contains(anywhere.lower()) for c in events.columns]))
    return events


def sort_table(events: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """By any column; the text of the level sorts by its number."""
    by = F.col("level" if column == "level_text" else column)
    return events.orderBy(by.desc() if descending else by.asc(), *natural())


def natural() -> list[Column]:
    return [F.col("file"), F.col("chunk_index"), F.col("record_seq")]


def point_lookup(events: DataFrame, record_id: int, order: Sequence[Column | str] = ("chunk_index", "record_seq")) -> DataFrame:
    """The first row with the id."""
    return events.filter(F.col("record_id") == record_id).orderBy(*order).limit(1)


@dataclass(frozen=True)
class Page:
    number: int
    size: int
    total: int

    def __post_init__(self) -> None:
        if self.size not in PAGE_SIZES:
            raise ValueError(f"page size {self.size} is not one of {PAGE_SIZES}")

    @property
    def pages(self) -> int:
        return max(1, -(-self.total // self.size))

    @property
    def index(self) -> int:
        return max(0, min(self.number, self.pages - 1))

    @property
    def start(self) -> int:
        return self.index * self.size

    @property
    def end(self) -> int:
        return min(self.start + self.size, self.total)

    @property
    def has_next(self) -> bool:
        return self.index < self.pages - 1

    @property
    def has_previous(self) -> bool:
        return self.index > 0

    @property
    def shown(self) -> bool:
        return self.total > self.size

    def resized(self, size: int) -> Page:
        return Page(0, size, self.total)

    def caption(self) -> str:
        return f"Page {self.index + 1} of {self.pages} ({self.start + 1}–{self.end} of {self.total})"


def _around(events: DataFrame, key: Column, p: Page) -> tuple[DataFrame, int]:
    """Rows of ``events`` around a page in the order of ``key``, all of it among them, and how many rows come before these.

    Rounds draw keys at random, count the rows between them by partial aggregates and go on with those between the keys
    around the page. The keys only say where to cut; counts are exact, and no rows are sorted or meet in one task.
    """
    kind, inside, before, held = events.select(key.alias("k")).schema["k"].dataType, events, 0, p.total
    for _ in range(_ROUNDS):
        if held <= NEAR_ROWS:
            break
        drawn = inside.select(key.alias("k")).orderBy(F.rand()).limit(_PIVOTS).distinct().orderBy("k").collect()
        pivots = [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r.k, kind, strict=True))) for r in drawn]
        part = reduce(lambda a, b: a + b, [(key > x).cast("int") for x in pivots], F.lit(0))  # part i ends with pivot i
        counts = {r.part: r["count"] for r in inside.groupBy(part.alias("part")).count().collect()}
        ends = list(itertools.accumulate(counts.get(i, 0) for i in range(len(pivots) + 1)))
        first, last = (next((i for i, end in enumerate(ends) if before + end > rank), len(pivots)) for rank in (p.start, p.end - 1))
        inside = inside.filter(key > pivots[first - 1]) if first else inside
        inside = inside.filter(key <= pivots[last]) if last < len(pivots) else inside
        skipped = ends[first - 1] if first else 0
        left = ends[last] - skipped
        before += skipped
        if left == held:
            break  # equal keys
        held = left
    return inside, before


def page(events: DataFrame, number: int, size: int = 100, order: Sequence[Column | str] | None = None, total: int | None = None) -> DataFrame:
    """One page in natural order, or by ``order``; numbers beyond the last page mean the last page.

    A page that is far from the beginning is found by counts, so only rows around it are sorted. Rows with equal keys
    at the page are sorted together, and all rows where ``order`` has columns with a direction (``desc()``).
    """
    p = Page(number, size, events.count() if total is None else total)
    order = order or natural()
    plain = not any(repr(c).endswith((" NULLS FIRST'>", " NULLS LAST'>")) for c in order)
    rows, before = _around(events, F.struct(*order), p) if plain and p.end > NEAR_ROWS else (events, 0)
    return rows.orderBy(*order).offset(p.start - before).limit(p.size)


def page_info(events: DataFrame, number: int, size: int = 100) -> DataFrame:
    """A row with the numbers of a page, without fetching it."""
    total = F.count(F.lit(1))
    pages = F.greatest(F.lit(1), F.ceil(total / size)).cast("bigint")
    at = F.greatest(F.lit(0), F.least(F.lit(number), pages - 1)).cast("bigint")
    told = events.agg(total.alias("total"), pages.alias("pages"), at.alias("page"))
    end = F.least((F.col("page") + 1) * size, F.col("total"))
    return told.select("total", "pages", "page", (F.col("page") * size).alias("start"), end.alias("end"), (F.col("page") > 0).alias("has_previous"), (F.col("page") < F.col("pages") - 1).alias("has_next"), F.format_string("Page %d of %d (%d–%d of %d)", F.col("page") + 1, "pages", F.col("page") * size + 1, end, "total").alias("caption"))


def deep_link(hits: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of ``events`` that hits (archive_id, file_name, record_id) lead to."""
    return events.join(hits.select("archive_id", "file_name", "record_id").distinct(), ["archive_id", "file_name", "record_id"], "left_semi")
