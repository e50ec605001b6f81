"""The index as atomic commits, and parses that are kept with files."""

from datetime import UTC, datetime

import pytest

from loomlog.operators import catalog
from loomlog.sources import container, encoder
from tests.test_container import chunk


@pytest.fixture()
def held(spark, tmp_path):
    """A catalog with an archive of a log with a repeated id, and one of another log."""
    (tmp_path / "a.evtx").write_bytes(encoder.file_header() + chunk(1, 2, 2) + chunk(2, 3))
    (tmp_path / "b.evtx").write_bytes(encoder.file_header() + chunk(7, 8))
    c = catalog.Catalog(spark, str(tmp_path / "w"))
    return c, [c.ingest(str(tmp_path / f"{n}.evtx"), datetime(2024, 1, k, tzinfo=UTC)) for k, n in ((1, "a"), (2, "b"))]


def ids(c):
    return sorted((r.archive_name, r.record_id) for r in c.events().collect())


ALL = [("a.evtx", 1), ("a.evtx", 2), ("a.evtx", 3), ("b.evtx", 7), ("b.evtx", 8)]


@pytest.mark.parametrize("step", ["_write_events", "_rename"])
def test_a_crash_leaves_nothing_half_indexed(held, monkeypatch, step):
    c, _ = held
    whole = getattr(c, step)

    def crash(*args):
        if step == "_write_events":
            whole(*args)
        elif "marks" not in args[0]:
            return whole(*args)
        raise OSError("lost")

    monkeypatch.setattr(c, step, crash)
    with pytest.raises(OSError, match="lost"):
        c.index()
    assert ids(c) == [] and c.unindexed().count() == 2 and c.commits() == []
    monkeypatch.undo()
    assert c.index() == 2 and ids(c) == ALL and c.index() == 0
    assert len(c._children(c._path("events"))) == 2
    c.vacuum()
    assert len(c._children(c._path("events"))) == 1 and ids(c) == ALL


def test_indexing_reads_no_events_that_are_held(held, monkeypatch):
    c, (first, second) = held
    assert c.index(first) == 1 and ids(c) == ALL[:3]
    table = c.table
    monkeypatch.setattr(c, "table", lambda name: pytest.fail("events are read") if name == "events" else table(name))
    assert c.index() == 1
    monkeypatch.undo()
    assert ids(c) == ALL and len(c.commits()) == 2
    c.delete_archive(second)
    assert ids(c) == ALL[:3] and c.files().count() == 1 and c.unindexed().count() == 0


def test_a_file_that_comes_during_a_commit_waits(held, monkeypatch, tmp_path):
    c, _ = held
    write = c._write_events

    def late(*args):
        write(*args)
        (tmp_path / "late.evtx").write_bytes(encoder.file_header() + chunk(50))
        c.ingest(str(tmp_path / "late.evtx"), datetime(2024, 1, 3, tzinfo=UTC))

    monkeypatch.setattr(c, "_write_events", late)
    assert c.index() == 2 and ids(c) == ALL
    monkeypatch.undo()
    assert c.index() == 1 and ids(c)[-1] == ("late.evtx", 50)


def test_two_commits_do_not_take_one_file(held, monkeypatch):
    c, _ = held
    write = c._write_events

    def other(*args):
        write(*args)
        monkeypatch.undo()
        assert c.index() == 2

    monkeypatch.setattr(c, "_write_events", other)
    with pytest.raises(RuntimeError, match="another commit"):
        c.index()
    assert ids(c) == ALL


def test_parses_are_replaced_as_a_whole(spark, held, tmp_path, monkeypatch):
    c, (first, second) = held
    key = f"{first}::a.evtx"
    assert c.parsed(key) is None
    parsed = container.read_events(spark, str(tmp_path / "a.evtx"))
    c.update_parsed(key, parsed)
    assert c.parsed(key).count() == 5
    c.update_parsed(key, parsed.filter("record_id = 1"))
    assert c.parsed(key).count() == 1 and len(c._children(c._parsed_path(key))) == 1
    monkeypatch.setattr(c, "_rename", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        c.update_parsed(key, parsed)
    assert c.parsed(key).count() == 1
    c.delete_archive(second)
    assert c.parsed(key).count() == 1
    c.delete_archive(first)
    assert c.parsed(key) is None


def test_cached_parses_are_updated(spark):
    cache = catalog.ParseCache(1)
    cache.get("a", lambda: spark.range(3))
    assert cache.update("a", spark.range(5)).count() == 5 == cache.get("a", lambda: spark.range(1)).count()
    assert cache.stats() == {"logs": 1, "others": 0}
    cache.clear()


def test_files_of_equal_content_are_decoded_once(spark, tmp_path, monkeypatch):
    rows = lambda n: [{"record_id": i, "ticks": 133500000000000000 + i, "provider": "P", "event_id": "1", "level": 4, "channel": "C", "computer": "H", "event_data": f"d{i}"} for i in range(1, n)]
    same, other = (bytearray(b"".join(encoder.encode(rows(n)))) for n in (20, 30))
    members = spark.createDataFrame([("x.evtx", same), ("y.evtx", other)], "name string, content binary").selectExpr("name", "'evtx' as type", "length(content) + 0L as size", "content")
    held, cuts, decode = catalog.Catalog(spark, str(tmp_path / "c")), [], catalog.container.decode
    for name in ("a", "b"):
        held.store(members, name, datetime(2024, 1, 1, tzinfo=UTC))
    monkeypatch.setattr(catalog.container, "decode", lambda cut, **more: (cuts.append(cut.count()), decode(cut, **more))[1])
    assert held.index() == 4 and cuts == [2]  # 4 before
    found = {r.file_id: r["count"] for r in held.events().groupBy("file_id").count().collect()}
    assert found == {f"{k}_1704067200000::{f}": n for k in "ab" for f, n in (("x.evtx", 19), ("y.evtx", 29))}
    assert held.events().select("id").distinct().count() == 96 and held.unindexed().count() == 0


def test_no_row_holds_a_large_log(spark, tmp_path, monkeypatch):
    rows = lambda n: [{"record_id": i, "ticks": 133500000000000000 + i, "provider": "P", "event_id": "1", "level": 4, "channel": "C", "computer": "H", "event_data": f"d{i}" * 40} for i in range(n)]
    whole = {n: b"".join(encoder.encode(rows(k))) for n, k in (("x.evtx", 2000), ("y.evtx", 2000), ("z.evtx", 10))}
    whole["n.txt"] = b"t" * 200_000
    (tmp_path / "in").mkdir()
    for name, content in whole.items():
        (tmp_path / "in" / name).write_bytes(content)
    monkeypatch.setattr(catalog.files.read_pieces, "__defaults__", (1,))
    c = catalog.Catalog(spark, str(tmp_path / "c"))
    key = c.ingest(str(tmp_path / "in"), datetime(2024, 1, 1, tzinfo=UTC))
    size = {r.name: (r.size, r.blob) for r in c.files().collect()}
    assert size == {n: (len(x), None) for n, x in whole.items()}  # blobs of whole files before
    assert c.table("pieces").selectExpr("max(length(content)) as n").first().n == 4096 + 65536
    assert all(b"".join(bytes(r.blob) for r in c.blob(f"{key}::{n}").collect()) == x for n, x in whole.items())
    cuts, decode = [], catalog.container.decode
    monkeypatch.setattr(catalog.container, "decode", lambda cut, **more: (cuts.append(cut.count()), decode(cut, **more))[1])
    assert c.index() == 3 and cuts == [(len(whole["x.evtx"]) + len(whole["z.evtx"]) - 8192) // 65536]
    assert {(r.file_name, r.n, r.s) for r in c.events().groupBy("file_name").agg({"record_id": "sum", "*": "count"}).toDF("file_name", "s", "n").collect()} == {("x.evtx", 2000, 1999000), ("y.evtx", 2000, 1999000), ("z.evtx", 10, 45)}
    (tmp_path / "bad.evtx").write_bytes(b"no log" * 20_000)
    c.ingest(str(tmp_path / "bad.evtx"))
    with pytest.raises(Exception, match="not a binary log"):
        c.index()
    c.delete_archive(key)
    assert c.table("pieces").select("name").distinct().count() == 1
