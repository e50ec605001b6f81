import zipfile

import pytest

from loomlog.sources import container, encoder, files, zips

CHUNKS = 40


def log(n=CHUNKS):
    rows = ({"record_id": k, "ticks": 133_500_000_000_000_000 + k} | {c: f"{c} {k} " + "x" * 900 for c in encoder.SLOTS} | {"level": 4, "event_id": str(k)} for k in range(1, n * 20))
    return b"".join(encoder.encode(rows))


@pytest.fixture(scope="module")
def body():
    return log()


def test_members_and_their_faults(spark, tmp_path, body):
    path = tmp_path / "a b.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("dir/", "")
        z.writestr("same.txt", "one")
        z.writestr("same.txt", "two")
        z.writestr("empty.json", "")
        z.writestr("zeros.bin", bytes(5_000_000))
        z.writestr("stored.txt", "as it is", zipfile.ZIP_STORED)
        z.writestr("b.txt", "bzip " * 1_000_000, zipfile.ZIP_BZIP2)
        z.writestr("l.txt", "lzma", zipfile.ZIP_LZMA)
        z.writestr("broken.txt", bytes(range(256)) * 10)
        z.writestr("wrong.txt", "x" * 50, zipfile.ZIP_STORED)
        z.writestr("big.txt", "y" * (len(body) + 6_000_000))
        z.writestr("log.evtx", body)
    raw = bytearray(path.read_bytes())
    with zipfile.ZipFile(path) as z:
        at = {m.filename: m.header_offset + 30 + len(m.filename) for m in z.infolist()}
    raw[at["broken.txt"] : at["broken.txt"] + 4] = b"\xff" * 4
    raw[at["wrong.txt"]] = ord("z")
    path.write_bytes(raw)
    (tmp_path / "bad.zip").write_bytes(b"no zip at all")
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    rows = zips.read_members(spark, str(tmp_path / "*.zip"), most=len(body) + 5_500_000).collect()
    told = {(r.archive.rsplit("/", 1)[-1], r.place): r for r in rows}
    assert len(told) == len(rows) == 12
    assert told["bad.zip", None].problem and told["bad.zip", None].content is None
    mine = [told["a b.zip", k] for k in range(11)]
    assert [r.name for r in mine] == ["same.txt", "same.txt", "empty.json", "zeros.bin", "stored.txt", "b.txt", "l.txt", "broken.txt", "wrong.txt", "big.txt", "log.evtx"]
    assert [bytes(r.content) for r in mine if r.problem is None] == [b"one", b"two", b"", bytes(5_000_000), b"as it is", b"bzip " * 1_000_000, body]
    problems = {r.name: r.problem for r in mine if r.problem}
    assert set(problems) == {"l.txt", "broken.txt", "wrong.txt", "big.txt"} and "checksum" in problems["wrong.txt"] and "method 14" in problems["l.txt"]
    listed = zips.directory(spark, str(tmp_path / "*.zip")).collect()
    assert {(r.name, r.size) for r in listed if r.name} == {(r.name, r.size) for r in mine}
    assert files.read_zip(spark, str(tmp_path / "a b.zip")).columns == ["archive", "name", "type", "size", "compressed_size", "content", "problem"]


def test_an_archive_of_more_than_two_gib(spark, tmp_path, body):
    path = tmp_path / "large.zip"
    with open(path, "wb") as f:
        f.truncate((1 << 31) + 12_345)  # a hole; the directory counts from the end
    with zipfile.ZipFile(path, "a", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.evtx", body)
        z.writestr("n.txt", "n")
    assert path.stat().st_size > 1 << 31
    chunks = zips.log_chunks(spark, str(path)).orderBy("chunk_index").collect()
    whole = container.chunks(spark.createDataFrame([("x", bytearray(body))], "file string, content binary")).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.chunk_start, r.chunk) for r in chunks] == [(r.chunk_index, r.chunk_start, r.chunk) for r in whole] and len(whole) > 16
    assert {r.name: bytes(r.content) for r in zips.read_members(spark, str(path)).collect()} == {"a.evtx": body, "n.txt": b"n"}


def test_members_are_spread_over_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        for k in range(64):
            z.writestr(f"{k}.txt", str(k))
    from pyspark.sql import functions as F

    tasks = zips.read_members(spark, str(tmp_path / "m.zip")).select(F.spark_partition_id()).distinct().count()
    assert tasks > 1


def test_logs_with_holes_and_faults(spark, tmp_path, body):
    holed = bytearray(body)
    holed[4096 + 65536 * 3 : 4096 + 65536 * 3 + 8] = bytes(8)
    with zipfile.ZipFile(tmp_path / "h.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("holed.evtx", bytes(holed))
        z.writestr("no.evtx", b"not a log" * 100)
        z.writestr("short.evtx", b"")
        z.writestr("cut.evtx", body)
        z.writestr("other.txt", "left out")
    raw = bytearray((tmp_path / "h.zip").read_bytes())
    with zipfile.ZipFile(tmp_path / "h.zip") as z:
        at = z.getinfo("cut.evtx").header_offset
    raw[at + 30 + 8 + 4096 + 65536 * 20 + 700] ^= 1  # a stored byte: the checksum tells
    (tmp_path / "h.zip").write_bytes(raw)
    rows = zips.log_chunks(spark, str(tmp_path / "h.zip")).collect()
    of = lambda name: sorted((r for r in rows if r.file.endswith(f"::{name}")), key=lambda r: (r.chunk_index is None, r.chunk_index))
    whole = container.chunks(spark.createDataFrame([("x", holed)], "file string, content binary")).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.chunk_start, r.chunk) for r in of("holed.evtx")] == [(r.chunk_index, r.chunk_start, r.chunk) for r in whole]
    assert [r.problem for r in of("no.evtx")] == ["not a binary log"] == [r.problem for r in of("short.evtx")]
    assert of("cut.evtx")[-1].problem and of("cut.evtx")[-1].chunk is None and len(of("cut.evtx")) > 16
    assert not of("other.txt")


def test_archives_are_written_and_read_back(spark, tmp_path):
    rows = [("a", "2.txt", bytearray(b"two")), ("a", "1.txt", bytearray(b"one")), ("a", "1.txt", bytearray(b"one")), ("b/c", "n.txt", None), ("b/c", None, bytearray(b"-")), (None, "x", bytearray(b"-"))]
    made = zips.write_archives(spark.createDataFrame(rows, "archive string, name string, content binary"), str(tmp_path / "out")).collect()
    assert {(r.archive, r.members) for r in made} == {("a", 3), ("b/c", 1)}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.zip", "b_c.zip"]
    back = zips.read_members(spark, str(tmp_path / "out" / "*.zip")).collect()
    assert sorted((r.name, bytes(r.content)) for r in back) == [("1.txt", b"one"), ("1.txt", b"one"), ("2.txt", b"two"), ("n.txt", b"")]
    nothing = spark.createDataFrame([], "archive string, name string, content binary")
    assert zips.write_archives(nothing, str(tmp_path / "none")).count() == 0
