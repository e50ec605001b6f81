import random

import pytest

from pyspark.sql import functions as F

from loomlog import shared
from loomlog.operators import search, textindex
from loomlog.operators.search import SearchFilters
from loomlog.operators.textindex import TextIndex

TYPES = "id string, timestamp string, level int, event_id string, provider string, computer string, channel string, event_data string, archive_id string, file_id string"
WORDS = ["Zürich", "İstanbul", "😀😀a", "straße", "alpha", "beta", "naïve", "ÀÉ", "x", "", "aaa", "aaaa"]


def rows(n, seed):
    pick = random.Random(seed)
    text = lambda k: None if pick.random() < 0.1 else " ".join(pick.choices(WORDS, k=k))
    return [(f"{seed}-{k:05d}", f"2024-01-01T00:{k // 60 % 60:02d}:{k % 60:02d}Z", k % 6, str(4600 + k % 9), text(2), text(1), "c", f"{text(6)} row {k:05d}", "a", "f") for k in range(n)]


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    index = TextIndex(spark, str(tmp_path_factory.mktemp("texts") / "t"), block_rows=64)
    for seed in (1, 2):
        index.append(spark.createDataFrame(rows(3000, seed), TYPES).coalesce(2))
    return index


def scanned(df):
    """Rows that the scan of the events gives, by its own count."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    total = 0
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.metrics().contains("numOutputRows"):
            total += leaf.metrics().apply("numOutputRows").value()
    return total


FILTERS = [SearchFilters(query=q) for q in ("ROW 00017", "zürich", "İSTANBUL", "😀😀A", "straße", "aaaa", "aa", "x", "nowhere", "alpha beta", "%", "46")] + [
    SearchFilters(providers=("ALPHA", "none"), query="row 0001"),
    SearchFilters(computers=("beta",), providers=("é", "naï"), levels=(1, 2)),
    SearchFilters(query="row 00", event_ids=("4603",)),
    SearchFilters(),
]


@pytest.mark.parametrize("filters", FILTERS, ids=str)
def test_hits_are_those_of_the_plain_search(held, filters):
    plain = search.search(held.events().drop("part", "block"), filters, 200).collect()
    assert held.search(filters, 200).collect() == plain


def test_blocks_are_skipped(held):
    found = held.narrowed(SearchFilters(query="row 00017"))
    assert 2 <= held.candidates(SearchFilters(query="row 00017")).count() <= 12
    assert 0 < scanned(found) < 1500
    assert held.narrowed(SearchFilters(query="certainly not there")).count() == 0
    assert held.candidates(SearchFilters(query="ro")) is None


def test_many_candidates_are_joined(spark, held):
    few = TextIndex(spark, held.root, block_rows=64, listed=3)
    for q in ("alpha", "row 00017"):
        assert few.search(SearchFilters(query=q), 50).collect() == held.search(SearchFilters(query=q), 50).collect()


def test_columns_that_are_not_indexed_are_read(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "t"), columns=("event_data",))
    index.append(spark.createDataFrame(rows(50, 3), TYPES))
    assert index.candidates(SearchFilters(query="alpha")) is None
    assert index.search(SearchFilters(query="alpha")).count() == search.search(index.events(), SearchFilters(query="alpha")).count() > 0


def test_a_part_that_breaks_off_is_not_seen(spark, tmp_path, monkeypatch):
    index = TextIndex(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        index.search(SearchFilters(query="row"))
    index.append(spark.createDataFrame(rows(20, 4), TYPES))

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(shared, "rename", fail)
        with pytest.raises(OSError, match="lost"):
            index.append(spark.createDataFrame(rows(20, 5), TYPES))
    assert len(index.parts()) == 1 and index.search(SearchFilters(query="row")).count() == 20
    index.append(spark.createDataFrame([], TYPES))
    assert len(index.parts()) == 2 and index.search(SearchFilters(query="row 00003")).count() == 1


def test_grams_are_of_characters(spark):
    told = spark.createDataFrame([("😀bç",), ("ab",), ("",), (None,), ("abcabc",)], "t string").select(textindex.grams(F.col("t")).alias("g")).collect()
    assert [None if r.g is None else len(r.g) for r in told] == [1, 0, 0, None, 3]
