"""The log source: asked columns, pushed conditions, dense numbers, streams of growing logs and the sink."""

import random

import pytest
from pyspark.sql import datasource as api
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomlog.sources import container, datasource, encoder, ranges
from tests.test_container import chunk, event

CHUNK = 65536


def write_log(path, *chunks, flags=0):
    path.write_bytes(encoder.file_header(flags=flags) + b"".join(chunks))


@pytest.fixture()
def logs(tmp_path):
    """Two logs of 9 and 4 chunks of 3 records, the first with holes before, in and behind ranges of two."""
    chunks = [chunk(*range(10 * k + 1, 10 * k + 4)) for k in range(9)]
    folder = tmp_path / "logs"
    folder.mkdir()
    hole = bytes(CHUNK)
    write_log(folder / "a.evtx", hole, *chunks[:3], hole, hole, hole, *chunks[3:], hole)
    write_log(folder / "b.evtx", *(chunk(*range(1000 + 10 * k, 1003 + 10 * k)) for k in range(4)))
    return folder


def reader(folder, *filters, asked="record_id bigint", **options):
    r = datasource.WinlogReader(StructType.fromDDL(asked), {"path": str(folder), "chunksPerPartition": "2"} | options)
    left = list(r.pushFilters(list(filters)))
    rows = [x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]
    return rows, r.count.get("opened", 0), left


def test_equals_the_native_reader(spark, logs):
    native = container.read_events(spark, str(logs)).withColumn("file", F.regexp_replace("file", "^file:(//)?", ""))
    for step in (1, 2, 512):
        mine = datasource.load(spark, str(logs), step=step)
        assert mine.columns == [c for c in native.columns]
        assert sorted(map(str, mine.collect())) == sorted(map(str, native.select(*mine.columns).collect()))


def test_only_asked_columns(spark, logs, monkeypatch):
    rows, _, _ = reader(logs, asked="record_seq int, record_id bigint")
    assert len(rows) == 39 and set(rows[0]) == {"record_seq", "record_id"}
    monkeypatch.setattr(ranges, "ChunkXml", None)  # not needed without texts
    assert len(reader(logs, asked="timestamp string")[0]) == 39
    with pytest.raises(ValueError, match="no column record_id string"):
        reader(logs, asked="record_id string")
    df = spark.read.format("winlog").schema("level int, record_id bigint").load(str(logs))
    assert df.columns == ["level", "record_id"] and df.filter("level = 4").count() == 39
    assert spark.read.format("winlog").load(str(logs)).count() == 39


def test_chunks_that_cannot_hold_the_ids_stay_unread(logs):
    rows, opened, left = reader(logs, api.GreaterThanOrEqual(("record_id",), 1010), api.LessThan(("record_id",), 1021))
    assert [r["record_id"] for r in rows] == [1010, 1011, 1012, 1020] and opened == 2 and not left
    rows, opened, _ = reader(logs, api.In(("record_id",), (12, 1032, 5000)))
    assert [r["record_id"] for r in rows] == [12, 1032] and opened == 2
    rows, opened, _ = reader(logs, api.EqualTo(("record_id",), 777))
    assert rows == [] and opened == 0
    rows, opened, left = reader(logs, api.EqualTo(("level",), 4), api.IsNotNull(("record_id",)))
    assert len(rows) == 39 and len(left) == 1


def test_headers_that_do_not_hold_are_no_zone_maps(tmp_path):
    broken = bytearray(chunk(1, 2))
    broken[24:32] = (900).to_bytes(8, "little")  # the checksum does not hold any more
    write_log(tmp_path / "a.evtx", bytes(broken), chunk(3, 4, flags=1, first=800, last=900), chunk(5, 6))
    rows, opened, _ = reader(tmp_path, api.LessThanOrEqual(("record_id",), 3))
    assert [r["record_id"] for r in rows] == [1, 2, 3] and opened == 2


def test_files_and_times_are_pushed(logs):
    rows, opened, left = reader(logs, api.EqualTo(("file",), f"{logs}/b.evtx"), api.GreaterThan(("timestamp",), ""), asked="file string, record_id bigint, xml string")
    assert len(rows) == 12 and opened == 4 and not left
    stamps = sorted(r["timestamp"] for r in reader(logs, asked="timestamp string")[0])
    rows, _, _ = reader(logs, api.GreaterThan(("timestamp",), stamps[30]), asked="timestamp string")
    assert len(rows) == sum(s > stamps[30] for s in stamps)


def test_conditions_in_the_plan(spark, logs):
    found = datasource.load(spark, str(logs), ("record_id", "xml")).filter("record_id between 1010 and 1020 and xml like '%Event%'")
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [IsNotNull(record_id), GreaterThanOrEqual(record_id,1010), LessThanOrEqual(record_id,1020)]" in plan and "ReadSchema: struct<record_id:bigint,xml:string>" in plan
    assert sorted(r.record_id for r in found.collect()) == [1010, 1011, 1012, 1020]


def test_random_conditions_equal_a_naive_filter(spark, logs):
    rng = random.Random(5)
    every = datasource.load(spark, str(logs), ("record_id", "event_id", "chunk_index")).collect()
    for _ in range(6):
        a, b = sorted(rng.sample([r.record_id for r in every], 2))
        got = datasource.load(spark, str(logs), ("record_id", "event_id", "chunk_index"), step=2).filter((F.col("record_id") > a) & (F.col("record_id") <= b)).collect()
        assert sorted(got) == sorted(r for r in every if a < r.record_id <= b)


def test_ids_beyond_63_bits_are_null(spark, tmp_path):
    write_log(tmp_path / "a.evtx", chunk(5, 2**63 + 1))
    assert [r.record_id for r in datasource.load(spark, str(tmp_path), ("record_id",)).collect()] == [5, None]
    assert datasource.load(spark, str(tmp_path), ("record_id", "xml")).filter("record_id is not null").count() == 1


def test_other_files(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "x.evtx").write_bytes(b"PK" * 100)
    write_log(tmp_path / "a.evtx", chunk(1))
    with pytest.raises(Exception, match="not a binary log"):
        spark.read.format("winlog").load(str(tmp_path)).count()
    rows = spark.read.format("winlog").option("badFiles", "row").load(str(tmp_path)).orderBy("file").collect()
    assert [(r.record_id, bool(r.error)) for r in rows] == [(1, False), (None, True)]


def test_heads(spark, logs):
    datasource.register(spark)
    heads = spark.read.format("winlog_chunks").load(str(logs)).filter("file like '%a.evtx'").orderBy("chunk_place").collect()
    assert [r.is_chunk for r in heads] == [False, True, True, True, False, False, False, *[True] * 6, False]
    assert all(r.header_ok and r.last_record_id == r.first_record_id + 2 for r in heads if r.is_chunk)


def test_sink(spark, tmp_path):
    datasource.register(spark)
    n = 3000
    rows = spark.range(1, n + 1, numPartitions=3).select(F.col("id").alias("record_id"), (F.lit(133500000000000000) + F.col("id")).cast("decimal(20,0)").alias("ticks"), F.lit("P & Q").alias("provider"), F.lit("7").alias("event_id"), (F.col("id") % 5).cast("int").alias("level"), F.when(F.col("id") % 2 == 0, "System").alias("channel"), F.lit("C").alias("computer"), F.concat(F.lit("k: "), F.col("id")).alias("event_data"), F.concat(F.lit("a::f"), F.col("id") % 2).alias("file"))
    path = str(tmp_path / "out")
    for _ in range(2):
        rows.repartition(3, "file").sortWithinPartitions("file", "record_id").write.format("winlog").mode("overwrite").option("maxChunksPerFile", "2").save(path)
    found = container.read_events(spark, path)
    assert found.count() == n and found.filter("level <> record_id % 5 or provider <> 'P & Q' or event_data <> concat('k: ', record_id)").count() == 0
    assert found.filter("channel = ''").count() == n // 2
    assert spark.read.format("winlog_chunks").load(path).groupBy("file").count().agg(F.max("count")).first()[0] == 2
    assert all(p.name.endswith(".evtx") for p in (tmp_path / "out").iterdir())
    rows.write.format("winlog").mode("append").save(path)
    assert container.read_events(spark, path).count() == 2 * n
    with pytest.raises(Exception, match="a log needs the columns"):
        rows.drop("ticks").write.format("winlog").mode("append").save(path)
    big = rows.limit(1).withColumn("event_data", F.lit("x" * 70_000))
    with pytest.raises(Exception, match="does not fit"):
        big.write.format("winlog").mode("append").save(path)
    assert container.read_events(spark, path).count() == 2 * n and all(p.name.endswith(".evtx") for p in (tmp_path / "out").iterdir())


def stream(spark, source, target, **options):
    datasource.register(spark)
    found = spark.readStream.format("winlog").schema("file string, chunk_place bigint, record_id bigint, error string").options(**options).load(str(source))
    q = found.writeStream.format("parquet").option("path", f"{target}/t").option("checkpointLocation", f"{target}/c").trigger(availableNow=True).start()
    q.awaitTermination(90)
    return sorted((r.record_id or -1, bool(r.error)) for r in spark.read.parquet(f"{target}/t").collect())


def test_growing_logs_give_new_chunks_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    chunks = [chunk(10 * k + 1, 10 * k + 2) for k in range(4)]
    ids = lambda n: [(10 * k + i, False) for k in range(n) for i in (1, 2)]
    write_log(source / "a.evtx", *chunks[:2], bytes(CHUNK), flags=1)
    assert stream(spark, source, tmp_path) == ids(1)  # the second chunk may still grow
    assert stream(spark, source, tmp_path) == ids(1)
    write_log(source / "a.evtx", *chunks[:3], flags=1)
    assert stream(spark, source, tmp_path) == ids(2)
    write_log(source / "a.evtx", *chunks)
    assert stream(spark, source, tmp_path) == ids(4)
    (source / "bad.evtx").write_bytes(b"PK" * 200)
    assert stream(spark, source, tmp_path) == [(-1, True), *ids(4)]
    write_log(source / "bad.evtx", chunk(100))
    assert stream(spark, source, tmp_path) == [(-1, True), *ids(4), (100, False)]


def test_bounded_triggers():
    import tempfile
    from pathlib import Path

    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    write_log(folder / "a.evtx", *(chunk(k) for k in range(1, 6)))
    write_log(folder / "b.evtx", *(chunk(k) for k in range(6, 9)))
    r = datasource.WinlogStreamReader(StructType.fromDDL("record_id bigint"), {"path": str(folder), "maxChunksPerTrigger": "3"})
    at, found = r.initialOffset(), []
    for _ in range(4):
        end = r.latestOffset()
        parts = r.partitions(at, end)
        assert sum(p.span.count for p in parts) <= 3
        found += [x["record_id"] for p in parts for b in r.read(p) for x in b.to_pylist()]
        at = end
    assert found == list(range(1, 9))


def test_large_event_counts(spark, tmp_path):
    rows = [event(i) for i in range(1, 2000)]
    (tmp_path / "a.evtx").write_bytes(b"".join(encoder.encode(rows)))
    assert datasource.load(spark, str(tmp_path / "a.evtx"), step=1).agg(F.count("*"), F.count_distinct("chunk_index", "record_seq"), F.max("record_id")).first() == (1999, 1999, 1999)
