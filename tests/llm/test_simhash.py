"""Fingerprints and components against brute force."""

import itertools
import re

import numpy as np
import pytest
import xxhash

from loomlog.llm import simhash
from tests.conftest import DATA


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), 1 << 62), 1 << 62 if d is None else d)
    return [None if least[find(i)] == 1 << 62 else least[find(i)] for i in range(len(ids))]


def expected(rows, k=3):
    fps = [brute_fingerprint(t, k) for _, t in rows]
    found = components([d for d, _ in rows], fps)
    return sorted(((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, found, strict=True)), key=str)


def got(df, **options):
    return sorted((tuple(r) for r in simhash.group_documents(df, **options).collect()), key=str)


def near_copies():
    rng = np.random.default_rng(8)
    base = [" ".join(f"w{i}" for i in rng.integers(900, size=200)) for _ in range(4)]
    rows = []
    for i in range(160):
        words = base[i % 4].split()
        for at in rng.integers(len(words), size=i % 5):
            words[at] = f"x{i}"
        rows.append((1000 - i, " ".join(words)))
    return rows


def test_odd_rows(spark, docs_of, odd_rows):
    assert got(docs_of(odd_rows).repartition(3)) == expected(odd_rows)


@pytest.mark.parametrize("bucket", [64, 1])
def test_near_copies(docs_of, bucket):
    rows = near_copies()
    assert got(docs_of(rows), bucket=bucket) == expected(rows)
    assert len({c for _, _, c in expected(rows)}) < len(rows)


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert got(spark.read.parquet(f"{DATA}/documents.parquet")) == expected(rows)


def test_every_pair_within_the_radius_shares_a_table():
    masks = [simhash.mask(k) & (1 << 64) - 1 for k in simhash.KEPT]
    flips = [1 << i for i in range(64)]
    for a, b in itertools.combinations_with_replacement(flips, 2):
        assert any(not (a | b) & m for m in masks)


@pytest.mark.parametrize("bucket", [2, 64])
def test_links_of_crowded_buckets(spark, bucket):
    """Fingerprints in a ball, some of them exactly two bits apart: all in few buckets."""
    rng = np.random.default_rng(2)
    fps = sorted({int(sum(1 << int(b) for b in set(rng.integers(64, size=rng.integers(1, 7))))) for _ in range(300)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp bigint, place bigint")
    links = {tuple(sorted((r.u.place, r.v.place))) for r in simhash.links(df, bucket).collect()}
    assert all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in links)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(i) for i in range(len(fps))] == components(range(len(fps)), fps)


def test_long_texts_are_hashed_in_stretches(docs_of, monkeypatch):
    monkeypatch.setattr(simhash, "_STRETCH", 7)
    words = [f"w{i % 23}é" for i in range(100)]
    for n in (1, 2, 3, 9, 10, 100):
        text = " \t".join(words[:n])
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        ws, we, _ = simhash.common.word_bounds(data, np.array([0, len(data)]))
        assert simhash.fingerprint(data, ws, we) == brute_fingerprint(text)


def test_empty_table_and_clashing_columns(spark, docs_of):
    schema = "doc_id bigint, text string"
    assert got(docs_of([], schema)) == []
    rows = [(1, "a b c"), (2, "A  b c"), (3, None)]
    wide = spark.createDataFrame([(*r, 5, 6, "x") for r in rows], schema + ", fp int, place int, component_id string")
    assert got(wide) == expected(rows)
