import glob
import os
import random
import zipfile
from datetime import UTC, datetime

import pytest

from pyspark.sql import functions as F

import __spark_entry__
from loomlog.functions import text as T
from loomlog.operators import catalog, export, profile, search
from loomlog.operators.search import Page, SearchFilters
from loomlog.plans import catalogue
from loomlog.sources import container, datasource, encoder, files
from loomlog.streaming import ingest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    return repr(round(v, 6)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cursor = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(row[names.index(c)]) for c in cols) for row in cursor.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == list(catalogue._HIT)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_top_n_is_no_full_sort_and_filters_reach_the_scan(spark):
    plan = catalogue.QUERIES["search_levels"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def naive(rows, f, limit):
    low = str.lower
    ok = lambda r: (
        (not f.levels or r.level in f.levels) and (not f.channels or r.channel in f.channels) and (not f.event_ids or r.event_id in f.event_ids)
        and (not f.providers or any(low(p) in low(r.provider) for p in f.providers)) and (not f.computers or any(low(c) in low(r.computer) for c in f.computers))
        and (not f.query or any(low(f.query) in low(x) for x in (r.event_data, r.provider, r.event_id, r.computer)))
    )
    return [r.id for r in sorted(filter(ok, rows), key=lambda r: (r.timestamp, r.id), reverse=True)[:limit]]


def test_random_searches_equal_a_naive_filter(spark):
    events = catalogue.ev(spark, DATA).cache()
    rows = events.collect()
    rng = random.Random(5)
    pick = lambda xs, k: tuple(rng.sample(xs, rng.randint(0, k)))
    for _ in range(12):
        f = SearchFilters(query=rng.choice(["", "k", "USER", "%", "host1", "_"]), levels=pick([0, 1, 2, 3, 4, 5], 4), channels=pick(["System", "system", "Security"], 2), providers=pick(["sim", "CLICK", "x"], 2), computers=pick(["host0", "T1"], 1), event_ids=pick(["4600", "4611"], 1))
        assert [r.id for r in search.search(events, f, 50).collect()] == naive(rows, f, 50), f


def test_dates_drop_rows_without_timestamp(spark):
    rows = [("2024-01-01T00:00:00.0009999Z", "a"), ("", "b"), ("2024-01-01T00:00:00.0010000Z", "c")]
    df = spark.createDataFrame(rows, "timestamp string, id string")
    at = datetime(2024, 1, 1, 0, 0, 0, 1000, tzinfo=UTC)
    assert [r.id for r in search.search(df, SearchFilters(start=at)).collect()] == ["c"]
    assert [r.id for r in search.search(df, SearchFilters(end=datetime(2024, 1, 1, tzinfo=UTC))).collect()] == ["a"]


def test_pages():
    p = Page(9, 100, 250)
    assert (p.index, p.start, p.end, p.has_next, p.has_previous, p.caption()) == (2, 200, 250, False, True, "Page 3 of 3 (201–250 of 250)")
    assert Page(0, 50, 0).pages == 1 and not Page(0, 50, 0).shown and p.resized(50).index == 0
    with pytest.raises(ValueError):
        Page(0, 70, 1)


def test_text_functions(spark):
    c = F.col
    row = spark.sql("SELECT 0L z, 1536L k, 3221225472L g, 'A.EVTX' n, X'0AFF' b").select(T.format_bytes(c("z")), T.format_bytes(c("k")), T.format_bytes(c("g")), T.base_name(c("n")), T.file_type(c("n")), T.hex_dump(c("b")), T.level_text(F.lit(7))).first()
    assert tuple(row) == ("0 B", "1.50 KB", "3.00 GB", "A", "evtx", "0A FF", "Level 7")
    line = spark.sql("SELECT 1").select(T.stats_line(*map(F.lit, (3, 1, 2048, 12, 1, 3, 1, 0)))).first()[0]
    assert line == "3 records · 1 chunks · 2.0 KB · 12ms · 1 templates · 3 refs · 1 missing!"


def log(path, ids):
    rows = [{"record_id": i, "ticks": 133500000000000000 + i * 10**7, "provider": "P", "event_id": "1", "level": i % 3, "channel": "System", "computer": "C", "event_data": f"k: {i}"} for i in ids]
    path.write_bytes(b"".join(encoder.encode(rows)))


def test_catalog(spark, tmp_path):
    log(tmp_path / "a.evtx", range(1, 6))
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.write(tmp_path / "a.evtx", "logs/a.evtx")
        z.writestr("dir/", "")
        z.writestr("n.json", '{"a": 1}')
        z.writestr("n.log", "one\ntwo")
        z.writestr("n.bin", b"\0")
    c = catalog.Catalog(spark, str(tmp_path / "w"))
    assert c.archives().count() == 0
    first = c.ingest(str(tmp_path / "x.zip"), datetime(2024, 1, 1, tzinfo=UTC))
    second = c.ingest(str(tmp_path / "a.evtx"), datetime(2024, 1, 2, tzinfo=UTC))
    assert [r.archive_id for r in c.archives().collect()] == [second, first] == ["a.evtx_1704153600000", "x.zip_1704067200000"]
    assert c.archive(first).first().file_count == 4 and len(c.archive(first).first().files) == 4
    assert {r.group: r.n for r in profile.type_counts(c.files(first)).collect()} == {"evtx": 1, "json": 1, "txt": 1, "other": 1}
    assert c.index() == 2 and c.index() == 0
    e = c.events()
    assert e.count() == 10 and e.filter(F.col("archive_id") == first).first().file_name == "logs/a.evtx"
    assert [r.record_id for r in search.search(e, SearchFilters(archive_ids=(second,)), 2).collect()] == [5, 4]
    assert files.json_files(files.read_zip(spark, str(tmp_path / "x.zip"))).select(F.expr("variant_get(value, '$.a', 'int')")).first()[0] == 1
    assert len(bytes(c.blob(f"{second}::a.evtx").first().blob)) == (tmp_path / "a.evtx").stat().st_size
    c.delete_archive(first)
    c.delete_archive("none")
    assert c.events().count() == 5 and c.files().count() == 1 and c.archives().count() == 1
    c.clear()
    assert c.events().count() == 0
    cache = catalog.ParseCache(1)
    cache.get("a", lambda: e)
    cache.get("b", lambda: e.limit(1))
    assert cache.stats() == {"logs": 1, "others": 0}
    cache.clear()


def test_archives_without_anything_to_view_are_refused(spark, tmp_path):
    for name, members in (("e.zip", {}), ("n.zip", {"a.bin": b"1"})):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for n, b in members.items():
                z.writestr(n, b)
    with pytest.raises(ValueError, match="No viewable files found. Files in archive: a.bin"):
        files.check_viewable(files.read_zip(spark, str(tmp_path / "n.zip")))
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    assert files.read_zip(spark, str(tmp_path / "bad.zip")).first().problem


def test_repeated_record_ids_keep_the_first(spark):
    parsed = spark.createDataFrame([("a::f", 1, 0, 0, "x"), ("a::f", 1, 0, 1, "y")], "file_id string, record_id bigint, chunk_index int, record_seq int, event_data string")
    blank = {c: F.lit("") for c in ("event_id", "provider", "level_text", "computer", "channel", "timestamp", "task", "opcode", "keywords", "xml")}
    stored = spark.createDataFrame([("a::f", "f", "a")], "id string, name string, archive_id string")
    rows = catalog.index_projection(parsed.withColumns(blank | {"level": F.lit(0)}), stored, spark.createDataFrame([("a", "A")], "archive_id string, name string")).collect()
    assert [(r.id, r.event_data, r.archive_name) for r in rows] == [("a::f::1", "x", "A")]


def test_data_source(spark, tmp_path):
    log(tmp_path / "a.evtx", range(1, 800))
    datasource.register(spark)
    df = spark.read.format("winlog").option("chunksPerPartition", "1").load(str(tmp_path / "a.evtx"))
    assert df.rdd.getNumPartitions() > 1
    assert df.agg(F.count("*"), F.min("record_id"), F.max("record_id")).first() == (799, 1, 799)
    native = container.read_events(spark, str(tmp_path / "a.evtx"))
    both = ["record_id", "timestamp", "xml", "event_data"]
    assert df.select(*both).withColumn("record_id", F.col("record_id").cast("long")).exceptAll(native.select(*both)).count() == 0


def test_streaming_takes_each_file_once(spark, tmp_path):
    source, table, marks = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    source.mkdir()
    log(source / "a.evtx", range(1, 11))
    seen = []
    ingest.ingest(spark, str(source), table, marks, on_batch=lambda k, n: seen.append(n)).awaitTermination(60)
    log(source / "b.evtx", range(20, 25))
    ingest.ingest(spark, str(source), table, marks).awaitTermination(60)
    ingest.ingest(spark, str(source), table, marks).awaitTermination(60)
    assert seen == [10] and spark.read.parquet(table).count() == 15


def test_batches_end_at_chunks(spark):
    rows = [("f", i, [{"x": 1}] * n) for i, n in enumerate([300, 300, 100, 600, 5])]
    decoded = spark.createDataFrame(rows, "file string, chunk_index int, events array<struct<x:int>>")
    got = [tuple(r)[1:] for r in ingest.batches(decoded).orderBy("batch").collect()]
    assert got == [(0, 0, 1, 600, 0.4), (1, 2, 3, 700, 0.8), (2, 4, 4, 5, 1.0)]


def test_exports(spark, tmp_path):
    log(tmp_path / "a.evtx", range(1, 4))
    e = container.read_events(spark, str(tmp_path / "a.evtx")).cache()
    export.write_xml(e, str(tmp_path / "x"))
    parts = sorted(glob.glob(str(tmp_path / "x" / "part-*")))
    text = "".join(open(p).read() for p in parts)
    assert text.startswith(export.XML_HEAD) and text.rstrip().endswith(export.XML_TAIL) and text.count("</Event>\n\n") == 3
    assert export.detail_rows(e).filter("record_id = 1 and label = 'Record ID'").first().value == "1"
    assert "\n" in export.record_json(e).first().json
    assert export.result_json(e).count() == 3
    assert e.select(export.pretty_xml(F.col("xml")).alias("p")).first().p.splitlines()[1] == "  <System>"
    assert e.select(*export.FULL_VIEW).columns[0] == "record_id" and e.select(*export.DEFAULT_VIEW).count() == 3
    assert search.page(e, 0, 50).count() == 3 and search.sort_table(e, "level_text").first().level == 0


def test_documents_of_files(spark, tmp_path):
    import xml.etree.ElementTree as ET

    for name, ids in (("a", range(1, 400)), ("b", range(5, 8))):
        log(tmp_path / f"{name}.evtx", ids)
    e = container.read_events(spark, str(tmp_path)).withColumn("file", F.regexp_extract("file", "([^/]*)$", 1))
    target = tmp_path / "out"
    export.write_documents(e, str(target))
    assert sorted(p.name for p in target.iterdir()) == ["a.evtx", "b.evtx"]
    for name, ids in (("a", range(1, 400)), ("b", range(5, 8))):
        text = "".join(p.read_text() for p in sorted((target / f"{name}.evtx").iterdir()))
        assert text == export.XML_HEAD + "".join(f"{r.xml}\n\n" for r in e.filter(F.col("file") == f"{name}.evtx").orderBy("record_id").collect()) + export.XML_TAIL
        assert len(ET.fromstring(text.encode())) == len(ids)
    with pytest.raises(Exception, match="FileExistsError"):
        export.write_documents(e, str(target))
    export.write_documents(e.filter("record_id < 3"), str(target), overwrite=True)
    assert len(list(target.iterdir())) == 2 and len(ET.fromstring("".join(p.read_text() for p in sorted((target / "a.evtx").iterdir())).encode())) == 2


def test_sql_functions(spark):
    from loomlog.functions import register, values

    assert "event_data_kv" in register.register(spark)
    row = spark.sql("SELECT guid_text(X'AABBCCDD112233445566778899AABBCC') g, sid_text(X'010100000000000512000000') s, sid_text(X'0105000000000005') e, filetime_ticks(X'879696ED8A49DA01') t, filetime_iso(133500000001234567) i, hex32(60000) h, xml_escape('a<b') x").first()
    assert tuple(row) == ("{ddccbbaa-2211-4433-5566-778899AABBCC}", "S-1-5-18", "S-1-5", int.from_bytes(bytes.fromhex("879696ED8A49DA01"), "little"), values.filetime_text(133500000001234567), "0x0000ea60", "a&lt;b")
    lines = spark.sql("SELECT k.label, k.value FROM VALUES ('A b:  1\\nplain\\nC: x') AS t(s), LATERAL event_data_kv(s) AS k").collect()
    assert [tuple(r) for r in lines] == [("A b", "1"), ("C", "x")]


def test_command_line(spark, tmp_path, capsys):
    from loomlog.__main__ import main

    log(tmp_path / "a.evtx", range(1, 4))
    main(["dump", str(tmp_path), "-o", "xml"])
    assert capsys.readouterr().out.count("</Event>") == 3
    main(["dump", str(tmp_path)])
    assert len(capsys.readouterr().out.strip().splitlines()) == 3


def test_traces_and_storage(spark):
    trace = spark.createDataFrame([("FunctionCall", 70_000), ("Paint", 60_000), ("EvaluateScript", 1_000)], "name string, dur bigint")
    assert [r.name for r in profile.long_tasks(trace).collect()] == ["FunctionCall", "Paint"]
    assert profile.scripting_time(trace).first().ms == 71.0
    stored = spark.createDataFrame([("a", "evtx", 10, "x")], "name string, type string, size bigint, archive_id string")
    assert tuple(files.file_list(stored).first()) == ("a", 10, 10, "evtx")
    assert profile.storage_use(stored, 40).first().usage_percent == 25.0
