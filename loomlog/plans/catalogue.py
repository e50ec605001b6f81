"""Every query of the event log engine by name, with its SQL.

The driver's tables hold no binary logs, so event queries run on ``ev``, event rows derived from
``events``. Each callable takes (spark, sf_dir).
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions import decode
from ..functions import text as T
from ..functions import time as times
from ..operators import catalog, export, pages, profile, quality, search, textindex
from ..operators.search import SearchFilters
from ..sources import container, datasource, encoder, files, zips
from ..sources.binxml import CHUNK_SIZE
from ..streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_EV_SQL = """SELECT event_id AS record_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0Z' AS timestamp,
 CASE event_type WHEN 'error' THEN CASE WHEN value >= 400 THEN 1 ELSE 2 END WHEN 'purchase' THEN 3 WHEN 'click' THEN 4 WHEN 'view' THEN 5 ELSE 0 END AS level,
 CAST(4600 + user_id % 40 AS VARCHAR) AS event_id,
 'Sim-' || upper(substr(event_type, 1, 1)) || substr(event_type, 2) AS provider,
 'HOST' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') AS computer,
 CASE user_id % 3 WHEN 0 THEN 'Application' WHEN 1 THEN 'System' ELSE 'Security' END AS channel,
 'UserId: ' || user_id || chr(10) || 'Cents: ' || CAST(round(value * 100) AS BIGINT) || chr(10) || 'Props: ' || props AS event_data,
 'arch' || (user_id % 4) AS archive_id, 'arch' || (user_id % 4) || '::f' || (user_id % 8) || '.evtx' AS file_id,
 'f' || (user_id % 8) || '.evtx' AS file_name,
 'arch' || (user_id % 4) || '::f' || (user_id % 8) || '.evtx::' || event_id AS id FROM events"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Event rows derived from the driver's events, with ``more`` columns of those."""
    e = table(spark, sf_dir, "events")
    user, text = F.col("user_id"), lambda c: c.cast("string")
    level = F.when(F.col("event_type") == "error", F.when(F.col("value") >= 400, 1).otherwise(2)).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 4).when(F.col("event_type") == "view", 5).otherwise(0)
    cents = F.round(F.col("value") * 100).cast("bigint")
    archive, file_name = F.concat(F.lit("arch"), text(user % 4)), F.concat(F.lit("f"), text(user % 8), F.lit(".evtx"))
    return e.select(
        F.col("event_id").alias("record_id"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z")).alias("timestamp"),
        level.alias("level"),
        text(4600 + user % 40).alias("event_id"),
        F.concat(F.lit("Sim-"), F.upper(F.substring("event_type", 1, 1)), F.expr("substring(event_type, 2)")).alias("provider"),
        F.concat(F.lit("HOST"), F.lpad(text(user % 20), 2, "0")).alias("computer"),
        F.when(user % 3 == 0, "Application").when(user % 3 == 1, "System").otherwise("Security").alias("channel"),
        F.concat(F.lit("UserId: "), text(user), F.lit("\nCents: "), text(cents), F.lit("\nProps: "), F.col("props")).alias("event_data"),
        archive.alias("archive_id"),
        F.concat_ws("::", archive, file_name).alias("file_id"),
        file_name.alias("file_name"),
        F.concat_ws("::", archive, file_name, text(F.col("event_id"))).alias("id"),
        *more,
    )


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH ev AS ({_EV_SQL}) {sql}" if re.search(r"\bev\b", sql) else sql
        return f

    return add


_HIT = ("id", "record_id", "timestamp", "level", "event_id", "provider", "computer", "channel", "event_data")
_HITS = "SELECT " + ", ".join(_HIT) + " FROM ev"
_TOP = "ORDER BY timestamp DESC, id DESC LIMIT"


def _found(spark: SparkSession, sf_dir: str, filters: SearchFilters, limit: int = search.DEFAULT_LIMIT) -> DataFrame:
    return search.search(ev(spark, sf_dir), filters, limit).select(*_HIT)


@query(f"{_HITS} WHERE level IN (1, 2) {_TOP} 1000")
def search_levels(spark, sf_dir):
    return _found(spark, sf_dir, SearchFilters(levels=(1, 2)))


@query(f"{_HITS} WHERE event_id IN ('4607', '4624') {_TOP} 1000")
def search_event_ids(spark, sf_dir):
    return _found(spark, sf_dir, SearchFilters(event_ids=("4607", "4624")))


@query(f"{_HITS} WHERE channel IN ('Security') {_TOP} 1000")
def search_channels(spark, sf_dir):
    return _found(spark, sf_dir, SearchFilters(channels=("Security",)))


@query(f"{_HITS} WHERE archive_id IN ('arch1', 'arch2') AND file_id IN ('arch1::f1.evtx', 'arch2::f6.evtx') {_TOP} 1000")
def search_archives_files(spark, sf_dir):
    return _found(spark, sf_dir, SearchFilters(archive_ids=("arch1", "arch2"), file_ids=("arch1::f1.evtx", "arch2::f6.evtx")))


@query(f"{_HITS} WHERE contains(lower(provider), 'click') OR contains(lower(provider), 'sign') {_TOP} 1000")
def search_provider_substr(spark, sf_dir):
    return _found(spark, sf_dir, SearchFilters(providers=("CLICK", "sign")))


@query(f"{_HITS} WHERE contains(lower(computer), 'ost07') {_TOP} 1000")
def search_computer_substr(spark, sf_dir):
    return _found(spark, sf_dir, SearchFilters(computers=("ost07",)))


@query(f"{_HITS} WHERE contains(lower(event_data), 'userid: 14') OR contains(lower(provider), 'userid: 14') OR contains(lower(event_id), 'userid: 14') OR contains(lower(computer), 'userid: 14') {_TOP} 1000")
def search_query(spark, sf_dir):
    return _found(spark, sf_dir, SearchFilters(query="UserId: 14"))


@query(f"{_HITS} WHERE contains(lower(event_data), 'host0') OR contains(lower(provider), 'host0') OR contains(lower(event_id), 'host0') OR contains(lower(computer), 'host0') {_TOP} 100")
def search_box(spark, sf_dir):
    return search.search_box(ev(spark, sf_dir), "host0").select(*_HIT)


@query(f"SELECT {', '.join('e.' + c for c in _HIT)} FROM ev e JOIN events x ON x.event_id = e.record_id WHERE floor(epoch_us(x.ts) / 1000) BETWEEN epoch_ms(TIMESTAMP '2024-01-05 00:00:00') AND epoch_ms(TIMESTAMP '2024-01-09 12:30:00.5') ORDER BY e.timestamp DESC, e.id DESC LIMIT 1000")
def search_date_range(spark, sf_dir):
    return _found(spark, sf_dir, SearchFilters(start=datetime(2024, 1, 5, tzinfo=UTC), end=datetime(2024, 1, 9, 12, 30, 0, 500_000, tzinfo=UTC)))


@query(f"{_HITS} WHERE level IN (1, 2, 3) AND channel IN ('System', 'Security') AND contains(lower(computer), 'host1') AND contains(lower(provider), 'r') AND (contains(lower(event_data), 'k') OR contains(lower(provider), 'k')) {_TOP} 100")
def search_combined(spark, sf_dir):
    return _found(spark, sf_dir, SearchFilters(query="K", levels=(1, 2, 3), channels=("System", "Security"), computers=("host1",), providers=("R",)), 100)


@query(f"{_HITS} {_TOP} 1000")
def search_no_filters(spark, sf_dir):
    return _found(spark, sf_dir, SearchFilters())


@query("SELECT id, 'Event ' || event_id || ' - Level ' || level AS label, provider || ' • ' || computer || ' • ' || CASE WHEN length(event_data) > 100 THEN substr(event_data, 1, 100) || '...' ELSE event_data END || ' • ' || archive_id || ' / ' || file_name AS short FROM ev WHERE level = 0 " + f"{_TOP} 100")
def search_hit_text(spark, sf_dir):
    hits = search.search(ev(spark, sf_dir), SearchFilters(levels=(0,)), search.BOX_LIMIT)
    hits = search.hit_text(hits.withColumns({"level_text": T.level_text(F.col("level")), "archive_name": F.col("archive_id")}))
    return hits.select("id", "label", F.regexp_replace("description", r" • [A-Z][a-z]{2} \d+, [0-9:]+ [AP]M • ", " • ").alias("short"))


_VIEWED = "contains(lower(event_data), 'secur') OR contains(lower(provider), 'secur') OR contains(lower(event_id), 'secur') OR contains(lower(computer), 'secur') OR contains(lower(channel), 'secur')"


@query(f"{_HITS} WHERE level IN (2, 4) AND ({_VIEWED})")
def viewer_filter(spark, sf_dir):
    return search.viewer_filter(ev(spark, sf_dir), (2, 4), "Secur").select(*_HIT)


@query(f"{_HITS} WHERE 1 = 0")
def viewer_empty_levels(spark, sf_dir):
    return search.viewer_filter(ev(spark, sf_dir), ()).select(*_HIT)


@query(f"{_HITS} WHERE provider IN ('Sim-Click', 'Sim-View') AND computer IN ('HOST03') AND contains(lower(channel), 'app')")
def table_filters(spark, sf_dir):
    return search.column_filters(ev(spark, sf_dir), {"provider": ("Sim-Click", "Sim-View"), "computer": ("HOST03",)}, {"channel": "App"}).select(*_HIT)


@query(f"{_HITS} WHERE record_id = 777")
def point_lookup(spark, sf_dir):
    return search.point_lookup(ev(spark, sf_dir), 777, ("id",)).select(*_HIT)


@query("SELECT level, count(*) AS n FROM ev GROUP BY level")
def level_counts(spark, sf_dir):
    return profile.level_counts(ev(spark, sf_dir))


@query("SELECT level, count(*) AS n FROM ev WHERE archive_id = 'arch2' GROUP BY level")
def level_counts_by_archive(spark, sf_dir):
    return profile.level_counts(ev(spark, sf_dir), "arch2")


@query("SELECT count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM ev")
def time_range_summary(spark, sf_dir):
    return profile.time_range(ev(spark, sf_dir))


@query("SELECT DISTINCT * FROM (SELECT 'event_id' AS facet, event_id AS value FROM ev UNION ALL SELECT 'provider', provider FROM ev UNION ALL SELECT 'computer', computer FROM ev UNION ALL SELECT 'channel', channel FROM ev)")
def facet_options(spark, sf_dir):
    return profile.facets(ev(spark, sf_dir))


@query("SELECT count(*) FILTER (WHERE level IN (1, 2)) AS shown, count(*) AS total FROM ev")
def shown_of_total(spark, sf_dir):
    return profile.filtered_of(ev(spark, sf_dir), F.col("level").isin(1, 2))


def _page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_replace("url", r"[?#].*$", "")
    ending = F.when(F.col("page_id") % 5 == 0, ".evtx").when(F.col("page_id") % 5 == 1, ".JSON").when(F.col("page_id") % 5 == 2, ".log").when(F.col("page_id") % 5 == 3, ".xml").otherwise(".bin")
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(name, ending).alias("name"), F.octet_length("html").cast("bigint").alias("size"))
    return p.select("page_id", "name", "size", T.file_type(F.col("name")).alias("type"), F.concat(F.lit("arch"), (F.col("page_id") % 4).cast("string")).alias("archive_id"))


_PAGE_FILES = """WITH f AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 5 WHEN 0 THEN '.evtx' WHEN 1 THEN '.JSON' WHEN 2 THEN '.log' WHEN 3 THEN '.xml' ELSE '.bin' END AS name, strlen(html) AS size, 'arch' || (page_id % 4) AS archive_id FROM pages),
 t AS (SELECT *, CASE WHEN lower(name) LIKE '%.evtx' THEN 'evtx' WHEN lower(name) LIKE '%.json' THEN 'json' WHEN lower(name) LIKE '%.txt' OR lower(name) LIKE '%.log' THEN 'txt' WHEN lower(name) LIKE '%.xml' THEN 'xml' ELSE 'unknown' END AS type FROM f) """


@query(_PAGE_FILES + "SELECT page_id, name, type FROM t")
def file_type_dispatch(spark, sf_dir):
    return _page_files(spark, sf_dir).select("page_id", "name", "type")


@query(_PAGE_FILES + "SELECT archive_id, CAST(sum(size) AS BIGINT) AS total_size, count(*) AS file_count, count(*) FILTER (WHERE type <> 'unknown') AS viewable FROM t GROUP BY archive_id")
def archive_totals(spark, sf_dir):
    return profile.archive_totals(_page_files(spark, sf_dir))


@query(_PAGE_FILES + "SELECT archive_id, CASE type WHEN 'unknown' THEN 'other' ELSE type END AS \"group\", count(*) AS n FROM t GROUP BY ALL")
def file_summary(spark, sf_dir):
    return profile.type_counts(_page_files(spark, sf_dir))


@query("SELECT CAST(sum(strlen(html)) AS BIGINT) AS usage, CAST(1000000000 AS BIGINT) AS quota FROM pages")
def storage_use(spark, sf_dir):
    return profile.storage_use(_page_files(spark, sf_dir), 1_000_000_000).select("usage", "quota")


@query("SELECT file_id, record_id, previous FROM (SELECT file_id, record_id, lag(record_id) OVER (PARTITION BY file_id ORDER BY record_id) AS previous FROM ev) WHERE record_id <> previous + 1")
def id_gap_check(spark, sf_dir):
    kept = ev(spark, sf_dir).select("file_id", "record_id")
    return quality.sequence_gaps(kept, ["file_id"], "record_id", "record_id").select("file_id", "record_id", "previous")


@query("SELECT file_id, max(record_id) - min(record_id) + 1 AS expected, count(*) AS found FROM ev GROUP BY file_id HAVING max(record_id) - min(record_id) + 1 <> count(*)")
def chunk_count_check(spark, sf_dir):
    groups = ev(spark, sf_dir).groupBy("file_id").agg(F.min("record_id").alias("first"), F.max("record_id").alias("last"), F.count(F.lit(1)).alias("n"))
    return quality.count_mismatch(groups, ["file_id"], "first", "last", "n")


@query(f"{_HITS} ORDER BY record_id LIMIT 250 OFFSET 500")
def page_natural(spark, sf_dir):
    return search.page(ev(spark, sf_dir), 2, 250, ("record_id",)).select(*_HIT)


@query(f"{_HITS} ORDER BY record_id LIMIT 500 OFFSET (SELECT CAST(floor((count(*) - 1) / 500) * 500 AS BIGINT) FROM ev)")
def page_clamped(spark, sf_dir):
    return search.page(ev(spark, sf_dir), 10**6, 500, ("record_id",)).select(*_HIT)


@query("SELECT total, pages, page, page * 100 AS start, least((page + 1) * 100, total) AS \"end\", page > 0 AS has_previous, page < pages - 1 AS has_next, 'Page ' || (page + 1) || ' of ' || pages || ' (' || (page * 100 + 1) || '–' || least((page + 1) * 100, total) || ' of ' || total || ')' AS caption FROM (SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 100.0) AS BIGINT)) AS pages, least(7, greatest(1, CAST(ceil(count(*) / 100.0) AS BIGINT)) - 1) AS page FROM ev)")
def page_info(spark, sf_dir):
    return search.page_info(ev(spark, sf_dir), 7, 100)


@query("SELECT record_id, CASE level WHEN 1 THEN 'Critical' WHEN 2 THEN 'Error' WHEN 3 THEN 'Warning' WHEN 4 THEN 'Information' WHEN 5 THEN 'Verbose' ELSE 'Level ' || level END AS level_text FROM ev")
def level_text_parser(spark, sf_dir):
    return ev(spark, sf_dir).select("record_id", T.level_text(F.col("level")).alias("level_text"))


@query("SELECT record_id, CASE level WHEN 0 THEN 'LogAlways' WHEN 1 THEN 'Critical' WHEN 2 THEN 'Error' WHEN 3 THEN 'Warning' WHEN 4 THEN 'Information' WHEN 5 THEN 'Verbose' ELSE 'Level ' || level END AS level_text FROM ev")
def level_text_ui(spark, sf_dir):
    return ev(spark, sf_dir).select("record_id", T.level_text(F.col("level"), T.UI_LEVELS).alias("level_text"))


def _tick_column() -> Column:
    return (F.unix_micros(F.col("ts").cast("timestamp")) * 10 + times.EPOCH_TICKS + F.col("event_id") % 10).alias("ticks")


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", _tick_column())


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || (event_id % 10) || 'Z' AS iso FROM events")
def filetime_iso(spark, sf_dir):
    return _ticks(spark, sf_dir).select("event_id", times.filetime_iso(F.col("ticks")).alias("iso"))


@query("SELECT event_id, printf('0x%08x', event_id * 7919) AS hex FROM events")
def hex32_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.hex32(F.col("event_id") * 7919).alias("hex"))


@query("SELECT DISTINCT n_chars, CASE WHEN n_chars = 0 THEN '0 B' WHEN n_chars >= 1048576 THEN printf('%.2f', floor(n_chars * 100 / 1048576.0 + 0.5) / 100) || ' MB' WHEN n_chars < 1024 THEN printf('%.2f', n_chars * 1.0) || ' B' ELSE printf('%.2f', floor(n_chars * 100 / 1024.0 + 0.5) / 100) || ' KB' END AS shown FROM documents")
def bytes_format(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("n_chars", T.format_bytes(F.col("n_chars")).alias("shown")).distinct()


_ESCAPE_SQL = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_DECODE_SQL = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')"


@query(f"SELECT page_id, md5({_ESCAPE_SQL.format('html')}) AS digest FROM pages")
def xml_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.xml_escape(F.col("html"))).alias("digest"))


@query(f"SELECT page_id, md5({_DECODE_SQL.format('html')}) AS digest FROM pages")
def entity_decode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.entity_decode(F.col("html"))).alias("digest"))


@query("SELECT page_id, coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages")
def tag_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.tag_text(F.col("html"), "title").alias("title"))


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def attr_value(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.attribute_value(F.col("html"), "html", "lang").alias("lang"))


def _xml_of_event(payload) -> object:
    """Event XML built from the columns of ``ev``."""
    e, c = T.xml_escape, F.col
    element = lambda name, v: F.concat(F.lit(f"<{name}>"), v, F.lit(f"</{name}>"))
    return F.concat(F.lit('<Event><System><Provider Name="'), e(c("provider")), F.lit('"/>'), element("EventID", c("event_id")), element("Level", c("level").cast("string")), element("Channel", c("channel")), element("Computer", c("computer")), F.lit("</System>"), payload, F.lit("</Event>"))


@query("SELECT event_id, 'user: ' || user_id || chr(10) || 'props: ' || props || chr(10) || event_type AS lines FROM events")
def data_pairs(spark, sf_dir):
    c = F.col
    section = F.concat(F.lit('<Data Name="user">'), c("user_id").cast("string"), F.lit('</Data><Data Name="none"></Data><Data Name="gone"/><Data Name="props">'), T.xml_escape(c("props")), F.lit("</Data><Data>"), c("event_type"), F.lit("</Data>"))
    return table(spark, sf_dir, "events").select("event_id", T.data_pairs(section).alias("lines"))


@query("SELECT event_id, 'user: ' || user_id || chr(10) || 'props: ' || props || chr(10) || 'kind: ' || event_type AS lines FROM events")
def leaf_pairs(spark, sf_dir):
    c = F.col
    section = F.concat(F.lit("<N><user> "), c("user_id").cast("string"), F.lit(" </user><gone/><inner x='1'><props>"), T.xml_escape(c("props")), F.lit("</props><kind>"), c("event_type"), F.lit("</kind></inner><blank> </blank></N>"))
    return table(spark, sf_dir, "events").select("event_id", T.leaf_pairs(section).alias("lines"))


@query("SELECT record_id, provider, event_id, level, channel, computer, event_data FROM ev")
def event_xml_roundtrip(spark, sf_dir):
    """XML from the rows, and the rows from it by the exact extractor, in Arrow batches."""
    from ..functions import eventxml

    kinds = pa.schema([("record_id", pa.int64()), ("provider", pa.string()), ("event_id", pa.string()), ("level", pa.int32()), ("channel", pa.string()), ("computer", pa.string()), ("event_data", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [eventxml.event_fields(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[n] for r in rows], kinds.field(n).type) for n in kinds.names[1:])], schema=kinds)

    payload = F.concat(F.lit("<EventData><Data>"), T.xml_escape(F.col("event_data")), F.lit("</Data></EventData>"))
    return ev(spark, sf_dir).select("record_id", _xml_of_event(payload).alias("xml")).mapInArrow(run, "record_id bigint, provider string, event_id string, level int, channel string, computer string, event_data string")


@query("SELECT event_id, v.label AS label, v.value AS value FROM (SELECT event_id, unnest([{'label': 'UserId', 'value': CAST(user_id AS VARCHAR)}, {'label': 'Cents', 'value': CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)}, {'label': 'Props', 'value': props}]) AS v FROM events)")
def kv_explode(spark, sf_dir):
    return ev(spark, sf_dir).select(F.col("record_id").alias("event_id"), F.inline(T.key_values(F.col("event_data")))).select("event_id", "label", "value")


@query("SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')")
def text_search_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(search.any_contains(("text", "source"), "License")).select("doc_id", "lang", "source")


@query("SELECT doc_id, len(string_split(text, chr(10))) AS line_count FROM documents")
def text_line_counts(spark, sf_dir):
    return export.text_with_lines(table(spark, sf_dir, "documents")).select("doc_id", F.col("line_count").cast("bigint").alias("line_count"))


@query("SELECT id FROM ev WHERE archive_id <> 'arch3'")
def cascade_delete(spark, sf_dir):
    return catalog.without_archive(ev(spark, sf_dir), "arch3").select("id")


@query("SELECT e.id, c.c_name AS archive_name, n.n_name AS file_name FROM ev e JOIN customer c ON c.c_custkey = e.record_id % 150 + 1 JOIN nation n ON n.n_nationkey = c.c_nationkey")
def denormalised_events(spark, sf_dir):
    """Names joined to events; the small sides are broadcast by their measured size."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    named = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", F.col("c_name").alias("archive_name"), F.col("n_name").alias("file_name"))
    return ev(spark, sf_dir).select("id", (F.col("record_id") % 150 + 1).alias("c_custkey")).join(named, "c_custkey").select("id", "archive_name", "file_name")


@query("SELECT DISTINCT id FROM ev WHERE archive_id <> 'arch0'")
def index_dedup(spark, sf_dir):
    e = ev(spark, sf_dir).select("id", "archive_id")
    return catalog.not_indexed(e.unionAll(e), e.filter("archive_id = 'arch0'")).select("id")


@query("SELECT h.id FROM ev h WHERE h.level = 2 AND contains(lower(h.event_data), 'userid: 1')")
def deep_link(spark, sf_dir):
    e = ev(spark, sf_dir)
    return search.deep_link(e.filter(search.any_contains(("event_data",), "userid: 1") & (F.col("level") == 2)), e).select("id")


def _with_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).withColumn("xml", F.concat(F.lit("<Event>"), F.col("record_id").cast("string"), F.lit("</Event>")))


#: Record ids of a file that go to one chunk or one part of a dump.
_BLOCK = 512


@query(f"SELECT file_id, part, md5(CASE WHEN part = min(part) OVER f THEN '<?xml version=\"1.0\" encoding=\"utf-8\"?>' || chr(10) || '<Events>' || chr(10) ELSE '' END || body || CASE WHEN part = max(part) OVER f THEN '</Events>' ELSE '' END) AS digest FROM (SELECT file_id, record_id // {_BLOCK} AS part, string_agg('<Event>' || record_id || '</Event>' || chr(10) || chr(10), '' ORDER BY record_id) AS body FROM ev GROUP BY ALL) WINDOW f AS (PARTITION BY file_id)")
def xml_dump(spark, sf_dir):
    e = _with_xml(spark, sf_dir).withColumn("part", F.expr(f"record_id div {_BLOCK}"))
    return export.xml_dump(e, "file_id", "part", ("record_id",)).select("file_id", "part", F.md5("text").alias("digest"))


@query("SELECT record_id, CASE level WHEN 1 THEN 'Critical' WHEN 2 THEN 'Error' WHEN 3 THEN 'Warning' WHEN 4 THEN 'Information' WHEN 5 THEN 'Verbose' ELSE 'Level ' || level END AS level, event_id, event_data, '<Event>' || record_id || '</Event>' AS xml FROM ev")
def record_json(spark, sf_dir):
    j = export.record_json(_with_xml(spark, sf_dir).withColumn("level_text", T.level_text(F.col("level"))))
    of = lambda n: F.get_json_object("json", f"$.{n}")
    return j.select(of("recordId").cast("bigint").alias("record_id"), of("level").alias("level"), of("eventId").alias("event_id"), of("eventData").alias("event_data"), of("xml").alias("xml"))


@query("SELECT record_id, section, label, value FROM (SELECT record_id, unnest([{'section': '', 'label': 'Event ID', 'value': event_id}, {'section': '', 'label': 'Time Created', 'value': timestamp}, {'section': '', 'label': 'Source', 'value': provider}, {'section': '', 'label': 'Computer', 'value': computer}, {'section': '', 'label': 'Channel', 'value': channel}, {'section': 'Additional Info', 'label': 'Record ID', 'value': CAST(record_id AS VARCHAR)}], recursive := true) FROM ev)")
def detail_sections(spark, sf_dir):
    blank = {c: F.lit("") for c in ("level_text", "process_id", "thread_id", "task", "opcode", "keywords", "version", "security_user_id", "activity_id", "related_activity_id")}
    return export.detail_rows(ev(spark, sf_dir).withColumns(blank)).drop("position")


@query("SELECT event_type, avg(value) AS avg, min(value) AS min, max(value) AS max, list_sort(list(value))[1 + len(list(value)) // 2] AS median FROM events GROUP BY event_type")
def sample_statistics(spark, sf_dir):
    found = profile.sample_statistics(table(spark, sf_dir, "events"), "event_type", "value")
    return found.withColumn("avg", F.round("avg", 6))


ORACLES["sample_statistics"] = ORACLES["sample_statistics"].replace("avg(value) AS avg", "round(avg(value), 6) AS avg")


def _chunks(spark: SparkSession, sf_dir: str, make: Callable[[pa.Table], Iterable[bytes]] | None = None) -> DataFrame:
    """(file, chunk_index, chunk_start, chunk): the rows of ``ev`` as chunks of the file of their file id.

    A block of ``_BLOCK`` record ids makes a chunk, or a few where its events do not fit into one, so no task holds
    more than a block, and blocks are dealt already when chunks are decoded; the index of a chunk is its block's number with room for those. ``make`` gives the chunks of a
    block's rows; without it the encoder does.
    """
    make = make or (lambda rows: itertools.islice(encoder.encode(rows.to_pylist()), 1, None))

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        made = list(make(rows.sort_by("record_id")))
        first = key[1].as_py() * _BLOCK
        index = range(first, first + len(made))
        return pa.table({"file": pa.array([key[0].as_py()] * len(made)), "chunk_index": pa.array(index, pa.int32()), "chunk_start": pa.array([4096 + CHUNK_SIZE * i for i in index], pa.int64()), "chunk": pa.array(made, pa.binary())})

    block = F.expr(f"record_id div {_BLOCK}").alias("block")
    return ev(spark, sf_dir, _tick_column()).select("file_id", block, "record_id", "ticks", *encoder.SLOTS).groupBy("file_id", "block").applyInArrow(write, "file string, chunk_index int, chunk_start bigint, chunk binary")


def _decoded(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    return container.decode(_chunks(spark, sf_dir), parts=parts, spread=False)


@query("SELECT e.record_id, strftime(x.ts, '%Y-%m-%dT%H:%M:%S.%f') || (x.event_id % 10) || 'Z' AS timestamp, e.provider, e.event_id, e.level, e.channel, e.computer, e.event_data FROM ev e JOIN events x ON x.event_id = e.record_id")
def binary_roundtrip(spark, sf_dir):
    """Rows to binary chunks, and back by record walk and template decoding."""
    found = container.events(_decoded(spark, sf_dir, "events"))
    return found.select("record_id", "timestamp", "provider", "event_id", "level", "channel", "computer", "event_data")


@query("SELECT file_id AS file, count(*) AS total_records, CAST(1 AS BIGINT) AS definition_count, count(*) AS reference_count, CAST(0 AS BIGINT) AS missing_count, CAST(0 AS BIGINT) AS parse_error_count FROM ev GROUP BY file_id")
def template_stats(spark, sf_dir):
    return container.file_summary(_decoded(spark, sf_dir, "record_count", "template_defs", "reference_count", "missing_refs", "parse_errors")).drop("num_chunks")


def _flipped(rows: pa.Table) -> Iterator[bytes]:
    """Chunks of which the first has a wrong byte among its records where the block's number is a multiple of three."""
    for k, chunk in enumerate(itertools.islice(encoder.encode(rows.to_pylist()), 1, None)):
        damaged = bytearray(chunk)
        if k == 0 and rows["record_id"][0].as_py() // _BLOCK % 3 == 0:
            damaged[600] ^= 0xFF
        yield bytes(damaged)


@query(f"SELECT file_id, count(DISTINCT record_id // {_BLOCK}) AS warnings FROM ev WHERE record_id // {_BLOCK} % 3 = 0 GROUP BY file_id")
def integrity_checksums(spark, sf_dir):
    """Chunks whose checksums do not hold: those that were damaged by rule."""
    bad = quality.checksums(_chunks(spark, sf_dir, _flipped)).filter("not records_ok and header_ok")
    return bad.groupBy(F.col("file").alias("file_id")).agg(F.count(F.lit(1)).alias("warnings"))


def _damaged(rows: pa.Table) -> Iterator[bytes]:
    """Chunks with faults by record id: a wrong copy of the size, payloads that are empty, short or begin wrongly, no time."""
    writer = encoder.ChunkWriter()
    for e in rows.to_pylist():
        payload, ticks, copy = b"\x0f\x01\x01\x00\x00", e["ticks"], None
        match e["record_id"] % 50:
            case 3:
                copy = 40
            case 7:
                payload = b""
            case 11:
                payload = b"\x0f\x01"
            case 13:
                ticks = 0
            case 17:
                payload = b"\xee" + payload
            case 19:
                payload, copy = b"\xab", 9
        raw = encoder.record(e["record_id"], ticks, payload, size_copy=copy)
        if not writer.put(e["record_id"], raw):
            yield writer.bytes()
            writer = encoder.ChunkWriter()
            writer.put(e["record_id"], raw)
    yield writer.bytes(flags=int(rows["record_id"][0].as_py() // _BLOCK % 2))


_FAULTS = {3: ("D4", "size mismatch — header says 33, trailing copy says 40"), 7: ("D6", "empty BinXml payload (0 bytes)"), 11: ("D7", "BinXml payload suspiciously small (2 bytes)"), 13: ("D8", "missing or zero timestamp"), 17: ("D5", "BinXml starts with 0xEE instead of 0x0F (FragmentHeader)")}
_FAULT_ROWS = [(19, "D4", "size mismatch — header says 29, trailing copy says 9"), (19, "D5", "BinXml starts with 0xAB instead of 0x0F (FragmentHeader)"), (19, "D7", "BinXml payload suspiciously small (1 bytes)"), *((k, *v) for k, v in _FAULTS.items())]
_FAULT_SQL = ", ".join(f"({k}, '{check}', '{text}')" for k, check, text in _FAULT_ROWS)


@query(f"SELECT file_id AS file, check_id, 'Record ' || record_id || ': ' || fault AS message FROM ev JOIN (VALUES {_FAULT_SQL}) f(k, check_id, fault) ON record_id % 50 = k")
def record_warnings(spark, sf_dir):
    """Findings about single records, in chunks with faults by rule."""
    found = quality.warnings(container.decode(_chunks(spark, sf_dir, _damaged), parts=["header", "records"], spread=False))
    return found.filter("phase = 3").select("file", "check_id", "message")


@query(f"SELECT file, check_id, sum(n)::BIGINT AS n FROM (SELECT file_id AS file, record_id // {_BLOCK} AS block, 'D3' AS check_id, count(*) FILTER (WHERE record_id <> previous + 1) AS n FROM (SELECT *, lag(record_id) OVER (PARTITION BY file_id, record_id // {_BLOCK} ORDER BY record_id) AS previous FROM ev) GROUP BY ALL UNION ALL SELECT file_id, record_id // {_BLOCK}, 'D2', CASE WHEN max(record_id) - min(record_id) + 1 <> count(*) THEN 1 ELSE 0 END FROM ev GROUP BY ALL UNION ALL SELECT DISTINCT file_id, record_id // {_BLOCK}, 'D1', record_id // {_BLOCK} % 2 FROM ev) GROUP BY file, check_id HAVING sum(n) > 0")
def chunk_warnings(spark, sf_dir):
    """How many chunks are flagged or have the wrong count, and records out of sequence."""
    found = quality.warnings(container.decode(_chunks(spark, sf_dir, _damaged), parts=["header", "records"], spread=False))
    return found.filter("phase < 3").groupBy("file", "check_id").agg(F.count(F.lit(1)).alias("n"))


_WRITTEN: dict[tuple[str, str], str] = {}


def _logs(spark: SparkSession, sf_dir: str) -> str:
    """A folder of binary logs with the rows of ``ev``, written by the sink once for each session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        datasource.register(spark)
        path = shared.new_folder(spark, "logs")
        e = ev(spark, sf_dir, _tick_column().cast("decimal(20,0)").alias("ticks")).select(F.col("file_id").alias("file"), "record_id", "ticks", *encoder.SLOTS)
        e.repartitionByRange("file", "record_id").sortWithinPartitions("file", "record_id").write.format("winlog").mode("overwrite").save(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def _file_id() -> Column:
    """The file id that a log of ``_logs`` is named by."""
    return F.concat(F.regexp_replace(F.regexp_extract("file", r"(arch\d__f\d)-[^/]*$", 1), "__", "::"), F.lit(".evtx"))


_ROUNDTRIP = ("record_id", "timestamp", "provider", "event_id", "level", "channel", "computer", "event_data")
_ROUNDTRIP_SQL = "SELECT e.record_id, strftime(x.ts, '%Y-%m-%dT%H:%M:%S.%f') || (x.event_id % 10) || 'Z' AS timestamp, e.provider, e.event_id, e.level, e.channel, e.computer, e.event_data FROM ev e JOIN events x ON x.event_id = e.record_id"


@query(_ROUNDTRIP_SQL)
def winlog_roundtrip(spark, sf_dir):
    """Rows to log files by the sink, and back by the source."""
    return datasource.load(spark, _logs(spark, sf_dir), _ROUNDTRIP)


@query(f"{_ROUNDTRIP_SQL} WHERE e.record_id BETWEEN 700 AND 1099 AND e.level <> 4")
def winlog_lookup(spark, sf_dir):
    """A range of ids: the other chunks stay unread."""
    return datasource.load(spark, _logs(spark, sf_dir), _ROUNDTRIP).filter("record_id between 700 and 1099 and level <> 4")


@query("SELECT e.file_id, count(*) AS n, min(strftime(x.ts, '%Y-%m-%dT%H:%M:%S.%f') || (x.event_id % 10) || 'Z') AS first, sum(e.record_id)::BIGINT AS ids FROM ev e JOIN events x ON x.event_id = e.record_id WHERE x.ts >= TIMESTAMP '2024-01-08 00:00:00' GROUP BY e.file_id")
def winlog_times(spark, sf_dir):
    """Only ids and times are asked, so no event is decoded; the condition is met in the source."""
    found = datasource.load(spark, _logs(spark, sf_dir), ("file", "record_id", "timestamp")).filter("timestamp >= '2024-01-08'")
    return found.groupBy(_file_id().alias("file_id")).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.sum("record_id").alias("ids"))


@query("SELECT file_id, min(record_id) AS first, max(record_id) AS last, true AS sound FROM ev GROUP BY file_id")
def chunk_heads(spark, sf_dir):
    """The zone maps: ids by the heads of chunks."""
    path = _logs(spark, sf_dir)  # registers the format
    heads = spark.read.format("winlog_chunks").schema("file string, is_chunk boolean, first_record_id bigint, last_record_id bigint, header_ok boolean").load(path)
    return heads.groupBy(_file_id().alias("file_id")).agg(F.min("first_record_id").alias("first"), F.max("last_record_id").alias("last"), F.every(F.col("is_chunk") & F.col("header_ok")).alias("sound"))


@query("SELECT file_id, count(*) AS records, min(record_id) AS first, max(record_id) AS last, true AS dense FROM ev GROUP BY file_id")
def chunk_discovery(spark, sf_dir):
    """Whole files, their chunks found by magic and numbered, their headers and records."""
    decoded = container.decode(container.chunks(container.read_files(spark, _logs(spark, sf_dir))), parts=["header", "records"])
    of_file = decoded.groupBy("file").agg(F.sum(F.size("records")).alias("records"), F.min("header.first_event_record_id").alias("first"), F.max("header.last_event_record_id").alias("last"), (F.max("chunk_index") + 1 == F.count(F.lit(1))).alias("dense"))
    return of_file.groupBy(_file_id().alias("file_id")).agg(F.sum("records").alias("records"), F.min("first").cast("bigint").alias("first"), F.max("last").cast("bigint").alias("last"), F.every("dense").alias("dense"))


@query("SELECT DISTINCT file_id, true AS is_log, 4096 AS header_block_size, false AS is_dirty, false AS is_full FROM ev")
def log_file_headers(spark, sf_dir):
    found = container.file_headers(container.read_files(spark, _logs(spark, sf_dir)))
    return found.select(_file_id().alias("file_id"), "is_log", "header_block_size", "is_dirty", "is_full").distinct()


@query(_ROUNDTRIP_SQL)
def decode_binxml(spark, sf_dir):
    """The decoder as a table function in SQL."""
    decode.register(spark)
    return spark.sql(f"SELECT {', '.join('e.' + c for c in _ROUNDTRIP)} FROM {{chunks}}, LATERAL decode_binxml(chunk) AS e", chunks=_chunks(spark, sf_dir))


def _ingested(spark: SparkSession, sf_dir: str) -> str:
    """A new folder with the events and the status of a stream over all logs."""
    path = shared.new_folder(spark, "ingest")
    ingest.ingest(spark, _logs(spark, sf_dir), f"{path}/events", f"{path}/checkpoint", status=f"{path}/status").awaitTermination()
    return path


@query(_ROUNDTRIP_SQL)
def stream_ingest(spark, sf_dir):
    return spark.read.parquet(f"{_ingested(spark, sf_dir)}/events").select(*_ROUNDTRIP)


@query("SELECT file_id, count(*) AS records, 'done' AS state, true AS timed FROM ev GROUP BY file_id")
def ingest_status(spark, sf_dir):
    """What the stream says of its files: how far, and whether their times are known."""
    told = ingest.latest_status(spark, f"{_ingested(spark, sf_dir)}/status")
    return told.groupBy(_file_id().alias("file_id")).agg(F.sum("rows").alias("records"), F.max("state").alias("state"), F.every((F.col("fraction") == 1) & (F.col("milliseconds") > 0)).alias("timed"))


@query(f"SELECT record_id, provider, event_id, level, event_data FROM ev ORDER BY file_id, record_id LIMIT 250 OFFSET (SELECT CAST(floor((count(*) - 1) / 250) * 250 AS BIGINT) FROM ev)")
def page_of_logs(spark, sf_dir):
    """The last page of all logs: only its chunks are read."""
    found = pages.LogPages(spark, _logs(spark, sf_dir), shared.new_folder(spark, "sums")).build()
    return found.page(10**6, 250, ("record_id", "provider", "event_id", "level", "event_data"))


def _indexed(spark: SparkSession, sf_dir: str, *names: str) -> catalog.Catalog:
    """A new catalog that holds the logs of ``ev`` as an archive of each name, indexed."""
    held = catalog.Catalog(spark, shared.new_folder(spark, "catalog"))
    members = files.read_pieces(spark, [_logs(spark, sf_dir)])
    for k, name in enumerate(names):
        held.store(members, name, datetime(2024, 1, 1 + k, tzinfo=UTC))
    held.index()
    return held


@query(f"SELECT record_id, timestamp, provider, event_id, level, channel, computer, event_data, 'logs' AS archive_name, 'logs_1704067200000::' || file_id AS file FROM ({_ROUNDTRIP_SQL.replace('SELECT e.record_id', 'SELECT e.file_id, e.record_id')})")
def catalog_index(spark, sf_dir):
    """Logs stored as files of an archive, decoded and indexed by one commit."""
    events = _indexed(spark, sf_dir, "logs").events().withColumnRenamed("file_name", "file")
    return events.select(*_ROUNDTRIP, "archive_name", F.concat(F.lit("logs_1704067200000::"), _file_id()).alias("file"))


@query("SELECT 'b' AS archive_name, count(*) AS n, true AS named, 0 AS waiting FROM ev")
def catalog_delete(spark, sf_dir):
    """Of two archives the first is deleted, with its events and marks."""
    held = _indexed(spark, sf_dir, "a", "b")
    held.delete_archive(catalog.archive_key("a", datetime(2024, 1, 1, tzinfo=UTC)))
    left = held.events().groupBy("archive_name").agg(F.count(F.lit(1)).alias("n"), F.every(F.col("file_id").startswith("b_") & F.col("id").startswith("b_")).alias("named"))
    return left.withColumn("waiting", F.lit(held.unindexed().count()))


@query("SELECT file_id AS file, count(*) AS events, sum(record_id)::BIGINT AS ids, 1 AS heads, 1 AS tails FROM ev GROUP BY file_id")
def xml_documents(spark, sf_dir):
    """A document for each file by the sink, and its lines read back."""
    path = shared.new_folder(spark, "documents")
    export.write_documents(_with_xml(spark, sf_dir).withColumnRenamed("file_id", "file"), path, order=("record_id",))
    lines = spark.read.text(f"{path}/*").select(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -2), "(arch[0-9])_", "$1::").alias("file"), "value")
    record = F.regexp_extract("value", "^<Event>([0-9]+)</Event>$", 1)
    number = F.when(record != "", record.cast("bigint"))
    ends = lambda text: F.count_if(F.col("value") == text).cast("int")
    return lines.groupBy("file").agg(F.count(number).alias("events"), F.sum(number).alias("ids"), ends("<Events>").alias("heads"), ends("</Events>").alias("tails"))


def _zips(spark: SparkSession, sf_dir: str) -> str:
    """A folder of zip files, one for each archive of ``ev``, with its logs."""
    path = shared.new_folder(spark, "zips")
    logs = container.read_files(spark, _logs(spark, sf_dir))
    members = logs.select(F.split(_file_id(), "::")[0].alias("archive"), F.regexp_extract("file", "[^/]*$", 0).alias("name"), "content")
    zips.write_archives(members, path).write.format("noop").mode("overwrite").save()
    return path


@query(_ROUNDTRIP_SQL)
def zip_logs(spark, sf_dir):
    """Logs inside zip files, unpacked as streams of chunks."""
    found = zips.log_chunks(spark, f"{_zips(spark, sf_dir)}/*.zip")
    sound = found.withColumn("chunk", F.coalesce("chunk", F.raise_error(F.concat("file", F.lit(": "), "problem")).cast("binary")))
    return container.events(container.decode(sound.drop("problem"), parts=["events"])).select(*_ROUNDTRIP)


@query("SELECT archive_id AS archive, count(DISTINCT file_id) AS logs, true AS whole FROM ev GROUP BY archive_id")
def zip_directory(spark, sf_dir):
    """What the directories of zip files say, without their members."""
    found = zips.directory(spark, f"{_zips(spark, sf_dir)}/*.zip").withColumn("file", F.concat_ws("::", "archive", "name"))
    whole = (F.col("type") == "evtx") & F.col("problem").isNull() & (F.col("size") % CHUNK_SIZE == 4096)
    return found.groupBy(F.regexp_extract("archive", r"([^/]*)\.zip$", 1).alias("archive")).agg(F.count_distinct(_file_id()).alias("logs"), F.every(whole).alias("whole"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents")
def zip_texts(spark, sf_dir):
    """Documents as members of zip files of 500 ids each, unpacked and read as texts."""
    path = shared.new_folder(spark, "zips")
    members = table(spark, sf_dir, "documents").select(F.concat(F.lit("texts-"), F.expr("doc_id div 500")).alias("archive"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    zips.write_archives(members, path).write.format("noop").mode("overwrite").save()
    texts = files.text_files(files.read_zip(spark, f"{path}/*.zip"))
    return texts.select(F.split("name", "[.]")[0].cast("bigint").alias("doc_id"), F.md5("text").alias("digest"))


_INDEXED_TEXTS: dict[tuple[str, str], textindex.TextIndex] = {}


def _text_index(spark: SparkSession, sf_dir: str) -> textindex.TextIndex:
    """``ev`` with filters of its blocks, in two parts, written once for each session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXED_TEXTS:
        held = textindex.TextIndex(spark, shared.new_folder(spark, "texts"), block_rows=256)
        rows = ev(spark, sf_dir)
        for half in (F.col("level") > 3, F.col("level") <= 3):
            held.append(rows.filter(half).orderBy("timestamp"))
        _INDEXED_TEXTS[key] = held
    return _INDEXED_TEXTS[key]


_HOLDS = " OR ".join(f"contains(lower({c}), 'cents: 123')" for c in search.QUERY_COLUMNS)


@query(f"{_HITS} WHERE {_HOLDS} {_TOP} 1000")
def search_indexed(spark, sf_dir):
    """A text that few blocks hold: the others stay unread."""
    return _text_index(spark, sf_dir).search(SearchFilters(query="Cents: 123")).select(*_HIT)


@query(f"{_HITS} WHERE level IN (1, 2, 5) AND (contains(lower(provider), 'view') OR contains(lower(provider), 'err')) AND contains(lower(computer), 'ost1') AND ({_HOLDS.replace('cents: 123', 'ts: 4')}) {_TOP} 100")
def search_indexed_combined(spark, sf_dir):
    """Texts in several columns and a list beside them."""
    return _text_index(spark, sf_dir).search(SearchFilters(query="TS: 4", levels=(1, 2, 5), providers=("View", "ERR"), computers=("ost1",)), 100).select(*_HIT)
