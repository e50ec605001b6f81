"""Streams of growing logs, their status, and the decoder in SQL."""

import time

import pytest
from pyspark.sql import functions as F

from loomlog.functions import decode
from loomlog.sources import container, encoder
from loomlog.streaming import ingest
from tests.test_container import chunk, opened, raw_chunk


def write_log(path, *chunks, flags=0):
    path.write_bytes(encoder.file_header(flags=flags) + b"".join(chunks))


def run(spark, tmp_path, **options):
    q = ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"), status=str(tmp_path / "s"), **options)
    q.awaitTermination(120)
    return q


def test_status_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_log(tmp_path / "in" / "a.evtx", chunk(1, 2), chunk(3), chunk(4), flags=1)
    write_log(tmp_path / "in" / "b.evtx", chunk(9))
    (tmp_path / "in" / "bad.evtx").write_bytes(b"nothing of a log" * 20)
    run(spark, tmp_path)
    rows = {r.file.rsplit("/", 1)[1]: r for r in ingest.latest_status(spark, str(tmp_path / "s")).collect()}
    assert {k: (r.state, r.rows, r.chunks) for k, r in rows.items()} == {"a.evtx": ("progress", 3, 2), "b.evtx": ("done", 1, 1), "bad.evtx": ("error", 0, 0)}
    assert rows["a.evtx"].fraction == pytest.approx(2 / 3) and rows["a.evtx"].milliseconds > 0 and "not a binary log" in rows["bad.evtx"].error
    write_log(tmp_path / "in" / "a.evtx", chunk(1, 2), chunk(3), chunk(4, 5))
    run(spark, tmp_path)
    rows = {r.file.rsplit("/", 1)[1]: r for r in ingest.latest_status(spark, str(tmp_path / "s")).collect()}
    assert (rows["a.evtx"].state, rows["a.evtx"].rows, rows["a.evtx"].chunks, rows["a.evtx"].fraction) == ("done", 5, 3, 1.0)
    assert rows["bad.evtx"].batch == 0
    events = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(r.record_id for r in events.collect()) == [1, 2, 3, 4, 5, 9]
    assert {"timestamp", "xml", "level_text", "ts", "chunk_place"} <= set(events.columns)


def test_bounded_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_log(tmp_path / "in" / "a.evtx", *(chunk(k) for k in range(1, 8)))
    seen = []
    run(spark, tmp_path, chunks_per_batch=7, on_batch=lambda k, n: seen.append(n))
    assert sum(seen) == 7 and spark.read.parquet(str(tmp_path / "s")).count() == len(seen)


def test_a_repeated_batch_writes_its_rows_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_log(tmp_path / "in" / "a.evtx", chunk(1, 2))

    def fail(number, n):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(spark, tmp_path, on_batch=fail)
    run(spark, tmp_path)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2 and spark.read.parquet(str(tmp_path / "s")).count() == 1


def waited(spark, path, wanted):
    for _ in range(60):
        try:
            rows = spark.read.schema(ingest.QUERY_STATUS).json(path).orderBy("at").collect()
        except Exception:  # noqa: BLE001 - nothing is there yet
            rows = []
        if {r.state for r in rows} >= wanted:
            return rows
        time.sleep(0.5)
    raise AssertionError(rows)


def test_durations_and_ends_of_queries(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_log(tmp_path / "in" / "a.evtx", chunk(1, 2))
    listener = ingest.QueryStatus(spark, str(tmp_path / "q"))
    spark.streams.addListener(listener)
    try:
        run(spark, tmp_path)
        rows = waited(spark, str(tmp_path / "q"), {"progress", "done"})
        told = [r for r in rows if r.state == "progress"]
        assert told and all(r.milliseconds > 0 for r in told) and sum(r.rows for r in told) == 2
        write_log(tmp_path / "in" / "b.evtx", chunk(3))
        with pytest.raises(Exception, match="gone"):
            run(spark, tmp_path, on_batch=lambda *_: (_ for _ in ()).throw(RuntimeError("gone")))
        assert any("gone" in (r.error or "") for r in waited(spark, str(tmp_path / "q"), {"error"}))
    finally:
        spark.streams.removeListener(listener)


def test_batches_are_folded_in_order(spark):
    rows = [("f", i, [{"x": 1}] * (i % 7)) for i in range(300)] + [("e", 0, [])] + [("g", i, [{"x": 1}] * 500) for i in range(3)]
    got = ingest.batches(spark.createDataFrame(rows, "file string, chunk_index int, events array<struct<x:int>>").repartition(3)).orderBy("file", "batch").collect()
    held, want, first = 0, [], 0
    for i in range(300):
        held += i % 7
        if held >= 500 or i == 299:
            want.append((first, i, held))
            held, first = 0, i + 1
    assert [(r.first_chunk, r.last_chunk, r.n) for r in got if r.file == "f"] == want
    assert [(r.first_chunk, r.n, round(r.progress, 3)) for r in got if r.file == "g"] == [(0, 500, 0.333), (1, 500, 0.667), (2, 500, 1.0)]
    assert not [r for r in got if r.file == "e"]


def test_decoder_in_sql(spark):
    assert decode.register(spark) == ["decode_binxml", "chunk_findings", "decode_chunks"]
    files, decoded = opened(spark, chunk(1, 2, 3), chunk(7, 2**63 + 5))
    cut = container.chunks(files).select("file", "chunk_index", "chunk").unionAll(spark.createDataFrame([("n", 0, None), ("x", 1, bytearray(b"ElfChnk\0"))], "file string, chunk_index int, chunk binary"))
    cut.createOrReplaceTempView("chunks_of_test")
    names = "record_seq, ticks, timestamp, xml, event_id, level, provider, computer, channel, event_data"
    want = container.events(decoded.filter("chunk_index = 0")).unionByName(container.events(decoded.filter("chunk_index = 1")).filter("record_seq = 0"))
    want = sorted(map(tuple, want.selectExpr("file", "chunk_index", "record_id", *names.split(", ")).collect()))
    lateral = spark.sql(f"SELECT file, chunk_index, record_id, {names} FROM chunks_of_test, LATERAL decode_binxml(chunk) AS e")
    whole = spark.sql(f"SELECT file, chunk_index, record_id, {names} FROM decode_chunks(TABLE(SELECT file, chunk_index, chunk FROM chunks_of_test))")
    for found in (lateral, whole):
        assert sorted(map(tuple, found.filter("record_id is not null").collect())) == want
        assert found.filter("record_id is null").count() == 1


def test_findings_in_sql(spark):
    decode.register(spark)
    broken = raw_chunk((b"\x0f\x01\x01\x00\x0c\x01" + bytes(4) + (60000).to_bytes(4, "little") + bytes(4) + b"\0", 1, None))
    spark.createDataFrame([("f", bytearray(broken))], "file string, chunk binary").createOrReplaceTempView("broken_of_test")
    found = spark.sql("SELECT file, e.* FROM broken_of_test, LATERAL chunk_findings(chunk) AS e").collect()
    assert [(r.file, r.kind, int(r.record_id)) for r in found] == [("f", "missing template", 1)]
