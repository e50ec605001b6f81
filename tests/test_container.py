import struct
import uuid

import pytest
from pyspark.sql import functions as F

from loomlog.operators import export, profile, quality
from loomlog.sources import container, encoder
from loomlog.sources.encoder import Body, ChunkWriter, event_values, file_header, record, template_use

TICKS = 133500000000000000
GUID = uuid.UUID(int=7)


def event(i, **more):
    return {"record_id": i, "ticks": TICKS + i, "provider": "P", "event_id": str(i), "level": 4, "channel": "System", "computer": "C&1", "event_data": f"k: {i}"} | more


def chunk(*ids, flags=0, **limits):
    w = ChunkWriter()
    for i in ids:
        assert w.add(i, TICKS + i, event_values(event(i)))
    return w.bytes(flags=flags, **limits)


def raw_chunk(*records, **more):
    w = ChunkWriter()
    for i, (payload, ticks, copy) in enumerate(records, 1):
        assert w.put(i, record(i, ticks, payload, size_copy=copy))
    return w.bytes(**more)


def opened(spark, *chunks, head=None, name="f"):
    files = spark.createDataFrame([(name, bytearray((head or file_header()) + b"".join(chunks)))], "file string, content binary")
    return files, container.decode(container.chunks(files), parallelism=2).cache()


def kinds(decoded):
    return [(r.check_id, r.record_seq) for r in quality.warnings(decoded).collect()]


def test_one_record(spark):
    _, d = opened(spark, chunk(1))
    e = container.events(d).first()
    assert (e.record_id, e.timestamp, e.provider, e.event_id, e.level, e.level_text, e.channel, e.computer, e.event_data) == (1, "2024-01-17T21:20:00.0000001Z", "P", "1", 4, "Information", "System", "C&1", "k: 1")
    assert e.xml.startswith('<Event><System><Provider Name="P"/><EventID>1</EventID>') and "C&amp;1" in e.xml
    assert kinds(d) == []


def test_two_chunks_share_a_template_by_its_guid(spark):
    _, d = opened(spark, chunk(1, 2), chunk(3))
    s = container.file_summary(d).first()
    assert (s.num_chunks, s.total_records, s.definition_count, s.reference_count, s.missing_count, s.parse_error_count) == (2, 3, 1, 3, 0, 0)
    assert container.first_seen(d).first().first_seen_record == 1
    assert [r.chunk_index for r in container.events(d).orderBy("record_id").collect()] == [0, 0, 1]


def test_holes_and_tails_are_skipped(spark):
    _, d = opened(spark, chunk(1), bytes(65536), chunk(2), b"ElfChnk\0" + bytes(100))
    assert [(r.chunk_index, r.chunk_start) for r in container.chunk_headers(d).orderBy("chunk_index").collect()] == [(0, 4096), (1, 4096 + 2 * 65536)]


def test_empty_file_has_no_chunks(spark):
    _, d = opened(spark)
    assert d.count() == 0


def test_other_files_fail(spark):
    files = spark.createDataFrame([("x", bytearray(b"PK" + bytes(70000)))], "file string, content binary")
    with pytest.raises(Exception, match="not a binary log"):
        container.chunks(files).count()
    assert container.file_headers(files).first().is_log is False


def test_file_flags(spark):
    files, _ = opened(spark, chunk(1), head=file_header(flags=3))
    h = container.file_headers(files).first()
    assert (h.header_block_size, h.flags, h.is_dirty, h.is_full) == (4096, 3, True, True)


def test_chunk_findings(spark):
    _, d = opened(spark, chunk(1, 2, 5, flags=1, last=9))
    got = quality.warnings(d).collect()
    assert [(r.check_id, r.phase) for r in got] == [("D1", 0), ("D2", 1), ("D3", 2)]
    assert got[1].message == "Chunk 0: expected 9 records (IDs 1..9), found 3"
    assert got[2].message == "Chunk 0, record 5: non-sequential ID (previous was 2)"


def test_record_findings(spark):
    good = b"\x0f\x01\x01\x00\x00"
    _, d = opened(spark, raw_chunk((good, TICKS, 1), (b"\x01abcd", TICKS, None), (b"", TICKS, None), (b"\x0f", TICKS, None), (good, 0, None)))
    assert kinds(d) == [("D4", 0), ("D5", 1), ("D6", 2), ("D7", 3), ("D8", 4)]
    messages = [r.message for r in quality.warnings(d).collect()]
    assert messages[1] == "Record 2: BinXml starts with 0x01 instead of 0x0F (FragmentHeader)"
    assert messages[4] == "Record 5: missing or zero timestamp"
    assert container.records(d).filter("record_seq = 2").first().binxml_first_byte is None


def test_invalid_record_ends_the_chunk(spark):
    w = ChunkWriter()
    for i in (1, 2, 3):
        assert w.add(i, TICKS, event_values(event(i)))
    data = bytearray(w.bytes())
    second = 512 + struct.unpack_from("<I", data, 516)[0]
    data[second] = 0
    _, d = opened(spark, bytes(data))
    assert [r.record_id for r in container.events(d).collect()] == [1]


def test_missing_template(spark):
    payload, _ = template_use(512 + 24, 60000, [], guid=GUID)
    outside, _ = template_use(512 + 24, 65530, [], guid=GUID)
    _, d = opened(spark, raw_chunk((payload, TICKS, None), (outside, TICKS, None)))
    assert [e.xml for e in container.events(d).orderBy("record_seq").collect()] == ["<!-- missing template def at 0x0000ea60 -->", "<!-- missing template def at 0x0000fffa -->"]
    s = container.file_summary(d).first()
    assert (s.missing_count, s.reference_count) == (2, 2)
    assert [r.guid for r in d.select(F.inline("missing_refs")).collect()][1] == "(unknown)"


def test_reading_outside_the_chunk_fails_the_record_only(spark):
    far = b"\x0f\x01\x01\x00\x01" + struct.pack("<HII", 0, 0, 0xFFFFFF)
    _, d = opened(spark, raw_chunk((far, TICKS, None), (b"\x0f\x01\x01\x00\x04", TICKS, None)))
    first, second = container.events(d).orderBy("record_seq").collect()
    assert first.xml == "<!-- BinXml parse error: Offset is outside the bounds of the DataView -->\n"
    assert first.event_id == "" and first.level == 0 and first.level_text == "Level 0"
    assert second.xml == "<!-- UNEXPECTED post-fragment 0x04 at 4 --><!-- UNEXPECTED doc token 0x04 (EndElement) at 4 -->"
    assert container.file_summary(d).first().parse_error_count == 1


def place_template(body, *, pointers=True, next_offset=0, at=2000):
    """A chunk whose table points to a definition at ``at``."""
    data = bytearray(chunk(1, pointers={3: at} if pointers else None))
    content = bytes(body(at + 24))
    data[at : at + 24 + len(content)] = struct.pack("<I", next_offset) + GUID.bytes_le + struct.pack("<I", len(content)) + content
    return data


def test_preloaded_chain_and_cycle(spark):
    data = place_template(encoder.event_template, next_offset=4000)
    data[4000:4024] = struct.pack("<I", 2000) + uuid.UUID(int=9).bytes_le + struct.pack("<I", 0)
    _, d = opened(spark, bytes(data))
    defs = container.template_defs(d).collect()
    assert sorted((r.def_data_offset, int(r.first_seen_record)) for r in defs) == [(550, 1), (2000, 0), (4000, 0)]
    assert container.file_summary(d).first().definition_count == 3
    assert {r.first_seen_record for r in container.first_seen(d).collect()} == {0, 1}


def fragment(spark, build, *values, kind=None):
    """Text of a record with a template whose content ``build`` writes."""
    given = [(k, v) for k, v in values]
    payload, _ = template_use(512 + 24, None, given, guid=GUID, body=lambda at: bytes(build(Body(at).raw(b"\x0f\x01\x01\x00")).out) + b"\0")
    _, d = opened(spark, raw_chunk((payload, TICKS, None)))
    return container.events(d).first().xml, d


def test_tokens(spark):
    text = "a<b".encode("utf-16-le")

    def build(b):
        b.open("E", (("x", "1&"), ("y", 0))).start()
        b.raw(b"\x08" + struct.pack("<H", 65)).raw(b"\x07" + struct.pack("<H", 3) + text)
        b.slot(0).slot(7).slot(1, optional=True)
        b.open("Empty").empty()
        return b.raw(b"\x0a").end()

    xml, _ = fragment(spark, build, (1, "v<".encode("utf-16-le")), (0, b""))
    at = xml[xml.index(" at ") + 4 : xml.rindex(" -->")]
    assert xml == f'<E x="1&amp;" y="v&lt;">&#65;<![CDATA[a<b]]>v&lt;<Empty/><!-- UNEXPECTED token 0x0A (PITarget) at {at} --></E>'


def test_bad_close(spark):
    xml, _ = fragment(spark, lambda b: b.open("E").raw(b"\x05\x01\x01\x00x\x00"))
    assert xml == "<E><!-- BAD close 0x05 --></E>x"


def test_nested_document_counts_only_when_used(spark):
    inner = b"\x0f\x01\x01\x00\x01\xff\xff" + bytes(4)

    def nested(at):
        return inner + struct.pack("<I", at + len(inner) + 4) + struct.pack("<IHH", 0, 0, 1) + "N".encode("utf-16-le") + b"\0\0" + b"\x03\0"

    build = lambda b: b.open("E").start().slot(0).end()
    probe, _ = template_use(512 + 24, None, [(0x21, nested(0))], guid=GUID, body=lambda at: bytes(build(Body(at).raw(b"\x0f\x01\x01\x00")).out) + b"\0")
    at = 512 + 24 + len(probe) - 1 - len(nested(0))
    xml, d = fragment(spark, build, (0x21, nested(at)))
    assert xml == "<E><N/></E>" and d.first().reference_count == 1


def test_cyclic_nesting_ends(spark):
    """A template that uses itself."""
    at = 512 + 24 + 10 + 4

    def build(b):
        return b.raw(b"\x0c\x01" + bytes(4) + struct.pack("<I", 512 + 24 + 14 - 0) + struct.pack("<I", 0))

    xml, d = fragment(spark, build)
    assert at and xml == "<!-- BinXml parse error: Maximum call stack size exceeded -->\n"


def test_comments_and_verdict(spark):
    _, d = opened(spark, chunk(1))
    text = export.chunk_comments(container.chunk_headers(d)).first().comment
    assert text.splitlines()[:3] == ["<!-- ═══ Chunk 0 ═══", "  fileOffset:    0x00001000", "  records:       1 .. 1"] and text.endswith("  commonStrings: (none)\n  templatePtrs: (none)\n-->")
    assert "  sizeCopy:      " in export.record_comments(container.records(d)).first().comment
    with_pointers = export.chunk_comments(container.chunk_headers(opened(spark, chunk(1, pointers={i: 60000 + i for i in range(5)}))[1])).first().comment
    assert "  templatePtrs (5 used):\n    [0]=0x0000ea60  [1]=0x0000ea61  [2]=0x0000ea62  [3]=0x0000ea63\n    [4]=0x0000ea64" in with_pointers
    assert profile.parse_verdict(container.file_summary(d), quality.warnings(d)).first().verdict == "success"
    _, d = opened(spark, chunk(1, 3))
    v = profile.parse_verdict(container.file_summary(d), quality.warnings(d)).first()
    assert (v.verdict, v.note) == ("info", "2 notes")


def test_checksums(spark):
    files, _ = opened(spark, chunk(1, 2))
    assert tuple(quality.checksums(container.chunks(files)).first())[2:] == (True, True)
    data = bytearray(chunk(1, 2))
    data[600] ^= 1
    files, _ = opened(spark, bytes(data))
    assert tuple(quality.checksums(container.chunks(files)).first())[2:] == (False, True)


def test_roundtrip_of_many(spark):
    content = b"".join(encoder.encode(event(i, event_data="x" * (i % 50)) for i in range(1, 1500)))
    files = spark.createDataFrame([("f", bytearray(content))], "file string, content binary")
    rows = container.events(container.decode(container.chunks(files))).orderBy("chunk_index", "record_seq").collect()
    assert [r.record_id for r in rows] == list(range(1, 1500)) and rows[-1].chunk_index > 0


def test_outlined_fields_equal_those_of_the_text():
    """Fields by template and by text agree, whatever the values hold."""
    from loomlog.functions import eventxml
    from loomlog.sources.binxml import ChunkXml

    odd = ["", "plain", "a & b", "</System><Level>9</Level>", 'x="y" Name="z"', "0", " 7", "\0end\0", "<System>", "é\U0001f600", "&lt;"]
    w = ChunkWriter()
    for i, text in enumerate(odd, 1):
        assert w.add(i, TICKS, event_values(event(i, provider=text, event_id=text, level=text, channel=text, computer=text, event_data=text)))
    number = (0x08, (3).to_bytes(4, "little"))
    for i, values in enumerate(([number] * 6, [(0x21, b"\x00" * 4)] * 6, [(0x77, b"<")] * 6, [(0x81, "a\0<b>\0".encode("utf-16-le"))] * 6, [number] * 2), 50):
        assert w.add(i, TICKS, values)
    data = w.bytes()
    xml, seen = ChunkXml(data), 0
    for at, size, rid, _, _ in container.walk(data):
        text, error = xml.event(rid, at + 24, at + size - 4)
        assert error is None and xml.fields(text) == eventxml.event_values(text)
        seen += 1
    assert seen == len(odd) + 5


def test_only_asked_parts_are_decoded(spark):
    files = spark.createDataFrame([("f", bytearray(file_header() + chunk(1, 2)))], "file string, content binary")
    d = container.decode(container.chunks(files), parts=["events"])
    assert d.columns == ["file", "chunk_index", "chunk_start", "events"]
    assert [r.record_id for r in container.events(d).orderBy("record_id").collect()] == [1, 2]


def test_dump_parts_join_to_the_document(spark):
    _, d = opened(spark, chunk(1, 2), chunk(3))
    e = container.events(d)
    text = "".join(r.text for r in export.xml_dump(e).orderBy("chunk_index").collect())
    body = "".join(f"{r.xml}\n\n" for r in e.orderBy("record_id").collect())
    assert text == f"{export.XML_HEAD}{body}{export.XML_TAIL}"


def test_upper_middle_of_samples(spark):
    rows = [("a", 3.0), ("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", None), (None, 5.0)]
    got = {r.k: (r.min, r.max, r.median) for r in profile.sample_statistics(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert got == {"a": (1.0, 3.0, 2.0), "b": (None, None, None), None: (5.0, 5.0, 5.0)}


def test_summary_decodes_once_and_no_events(spark):
    from loomlog.plans import catalogue

    found = catalogue.template_stats(spark, "/root/testdata/sf0.001")
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted").split("(1)")[0]
    assert plan.count("MapInArrow") == 1 and "events" not in container.decode(catalogue._chunks(spark, "/root/testdata/sf0.001"), parts=["record_count"]).columns
    assert sum(r.total_records for r in found.collect()) == 1000
