"""Gaps across ranges, middles by counts, and pages by prefix sums, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from loomlog.operators import profile, quality, search


@pytest.mark.parametrize("seed", range(3))
def test_gaps_equal_a_lag(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), i, None if rng.random() < 0.05 else i + rng.choice([0, 0, 0, 1])) for i in range(400)]
    want = []
    for key in ("a", "b", None):
        before = "none"
        for k, _, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            if before not in ("none", None) and v is not None and v != before + 1:
                want.append((k, v, before))
            before = v
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "file string, at bigint, value bigint").repartition(3)
    got = quality.sequence_gaps(df, ["file"], "at", "value")
    assert sorted(((r.file, r.value, r.previous) for r in got.collect()), key=str) == sorted(want, key=str)
    assert got.columns == ["file", "at", "value", "previous"]


def test_gaps_of_one_large_key_are_spread(spark):
    df = spark.range(100_000).filter("id % 1000 <> 7").select(F.lit("f").alias("file"), "id")
    got = quality.sequence_gaps(df, ["file"], "id", "id")
    assert sorted((r.id, r.previous) for r in got.collect()) == [(k + 8, k + 6) for k in range(0, 100_000, 1000)]
    assert quality.sequence_gaps(df.limit(0), ["file"], "id", "id").count() == 0


def middles(rows):
    by = {}
    for k, v in rows:
        by.setdefault(k, [])
        if v is not None:
            by[k].append(v)
    return {k: sorted(v, key=lambda x: (x != x, x))[len(v) // 2] if v else None for k, v in by.items()}


@pytest.mark.parametrize("kind, draw", [("bigint", lambda r: r.choice([r.randrange(10), r.randrange(-(10**15), 10**15), 5])), ("double", lambda r: r.choice([r.random(), 10.0 ** r.uniform(-200, 200), -1.5, float("inf"), float("-inf")]))])
def test_middles_equal_sorting(spark, kind, draw):
    rng = random.Random(kind)
    rows = [(rng.choice(["a", "b", "c", None]), draw(rng)) for _ in range(600)] + [("one", draw(rng)), ("none", None), ("same", draw(rng))] + [("two", draw(rng)) for _ in range(2)]
    rows += [("same", rows[-3][1])] * 9
    got = profile.sample_statistics(spark.createDataFrame(rows, f"k string, v {kind}").repartition(4), "k", "v")
    assert {r.k: r.median for r in got.collect()} == middles(rows)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_pages_read_their_chunks(spark, tmp_path):
    from pyspark.sql.types import StructType

    from loomlog.operators import pages
    from loomlog.sources import datasource, encoder
    from tests.test_container import chunk

    folder = tmp_path / "logs"
    folder.mkdir()
    n = 0
    want = []
    for name, sizes in (("a", [30, 0, 1, 49]), ("b", [20] * 7), ("c", [])):
        chunks = []
        for size in sizes:
            ids = range(n, n + size)
            n += size
            want += ids
            chunks.append(chunk(*ids) if size else bytes(65536))
        (folder / f"{name}.evtx").write_bytes(encoder.file_header() + b"".join(chunks))
    p = pages.LogPages(spark, str(folder), str(tmp_path / "sums")).build()
    assert p.total() == len(want) == 220
    for number, size in ((0, 50), (1, 50), (3, 50), (4, 50), (10**6, 50), (1, 100), (0, 500)):
        first = min(number, -(-220 // size) - 1) * size
        got = p.page(number, size, ("record_id", "event_data"))
        assert [r.record_id for r in got.collect()] == want[first : first + size]
    assert len(p.chunks(200, 220)) == 1 and [c.chunk_place for c in p.chunks(30, 31)] == [2]
    plan = spark._jvm.PythonSQLUtils.explainString(p.page(4, 50)._jdf.queryExecution(), "formatted")
    assert "EqualTo(file" in plan.split("PushedFilters")[1] or "In(file" in plan.split("PushedFilters")[1]
    r = datasource.WinlogReader(StructType.fromDDL("record_id bigint"), {"path": str(folder)})
    import pyspark.sql.datasource as api

    assert not list(r.pushFilters([api.In(("chunk_place",), (2,)), api.EqualTo(("file",), f"{folder}/b.evtx")]))
    assert sum(b.num_rows for q in r.partitions() for b in r.read(q)) == 20 and r.count["opened"] == 1
    with pytest.raises(ValueError, match="page size"):
        p.page(0, 7)


def test_pages_of_no_logs(spark, tmp_path):
    from loomlog.operators import pages
    from loomlog.sources import encoder

    (tmp_path / "a.evtx").write_bytes(encoder.file_header())
    p = pages.LogPages(spark, str(tmp_path), str(tmp_path / "sums")).build()
    assert p.total() == 0 and p.page(3, 50).count() == 0


def test_deep_pages_sort_few_rows(spark, monkeypatch):
    monkeypatch.setattr(search, "NEAR_ROWS", 300)
    rows = [(i % 7 or None, f"t{i * 7919 % 5003:04d}", float("nan") if i % 11 == 0 else i / 3) for i in range(5003)]
    df = spark.createDataFrame(rows, "a int, b string, c double").repartition(5)
    wanted = [r.b for r in df.orderBy("a", "c", "b").collect()]
    for number, size in [(0, 50), (7, 100), (23, 100), (10**6, 500), (99, 50)]:
        found = search.page(df, number, size, ("a", "c", "b"))
        at = min(number, -(-5003 // size) - 1) * size
        assert [r.b for r in found.collect()] == wanted[at : at + size]
    inside, before = search._around(df, F.struct("a", "c", "b"), search.Page(10**6, 500, 5003))
    assert inside.count() <= 500 and before + inside.count() == 5003  # all rows went to one task before
    assert search.page(df.withColumn("a", F.lit(1)), 30, 100, ("a",)).count() == 100  # equal keys
    assert search.page(df, 60, 50, (F.desc("b"),)).first().b == "t2002"
    assert search.page(df.limit(0), 3, 50, ("b",)).count() == 0
