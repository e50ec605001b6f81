"""Different words, windows and sets stay different, also those that any polynomial hash modulo a power of two makes equal."""

import random

import numpy as np

from loomlog.llm import common, decontamination, jaccard_join, substring_dedup, suffix_array_dedup
from tests.llm.test_dedup import expected_bytes, expected_words, got


def thue_morse(n, a="a", b="b"):
    bits = [i.bit_count() % 2 for i in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


X, Y = thue_morse(512)


def test_prime_arithmetic():
    p, rng = common._P, np.random.default_rng(1)
    a, b = (rng.integers(0, p, 5000, dtype=np.uint64) for _ in range(2))
    a[:3], b[:3] = [0, p - 1, 1], [p - 1, p - 1, 0]
    assert common._times(a, b).tolist() == [int(x) * int(y) % p for x, y in zip(a, b, strict=True)]
    values = rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)
    values[-9000:] = (1 << 64) - 1
    base, want, power = common._BASE % p, [0], 1
    for v in values.tolist():
        want.append((want[-1] + v * power) % p)
        power = power * base % p
    assert common.Rolling(values).sums.tolist() == want


def test_equal_stretches_have_equal_hashes():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 64, 30_000, dtype=np.uint64)
    twice = np.concatenate((values[70:170], values, values[70:170]))
    found = common.Rolling(twice).spans(np.array([0, 170, 30_100]), np.array([100, 270, 30_200]))
    assert len(set(found.tolist())) == 1
    assert (common.shingle_hashes(twice, 5)[:96] == common.shingle_hashes(values[70:170], 5)).all()


def test_words_of_any_length():
    for n in (2, 64, 256, 512, 8192):
        data = np.frombuffer(" ".join(thue_morse(n)).encode(), dtype=np.uint8)
        ws, we, _ = common.word_bounds(data, np.array([0, len(data)]))
        assert len(set(common.word_hashes(data, ws, we).tolist())) == 2
    rng = random.Random(4)
    words = [w for n in (1, 3, 5000) for w in {"".join(rng.choice("abc") for _ in range(n)) for _ in range(50)}]
    data = np.frombuffer(" ".join(words * 2).encode(), dtype=np.uint8)
    ws, we, _ = common.word_bounds(data, np.array([0, len(data)]))
    h = common.word_hashes(data, ws, we).tolist()
    assert h[: len(words)] == h[len(words) :] and len(set(h)) == len(words)


def test_word_windows(docs_of):
    shared = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{shared} {X}"), (2, f"{shared} {Y}"), (3, f"{shared} {X}")]
    found = got(substring_dedup.dedup_words(docs_of(rows)), "n_words", "n_removed", "kept_sha256")
    assert found == expected_words(rows, 20) and [n for _, _, n, _ in found] == [0, 0, 20]


def test_byte_windows(docs_of):
    rows = [(1, X), (2, Y), (3, f"q{Y}"), (4, "z" * 90 + X[:200]), (5, "z" * 90 + Y[:200])]
    assert got(suffix_array_dedup.dedup_bytes(docs_of(rows)), "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected_bytes(rows, 100)
    spans = [common.Rolling(common.BYTE_VALUES[np.frombuffer(t.encode(), dtype=np.uint8)]).spans(np.array([0]), np.array([512]))[0] for t in (X, Y)]
    assert spans[0] != spans[1]


def test_components(docs_of):
    rows = [(1, X), (2, Y), (3, X), (4, f"{X} {Y}"), (5, f"{Y} {X}")]
    found = {r.doc_id: r.component_id for r in jaccard_join.join_documents(docs_of(rows)).collect()}
    assert found == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_leaks(spark, docs_of):
    common_words = " ".join(f"k{i}" for i in range(12))
    docs = docs_of([(1, f"a {common_words} {X} b"), (2, f"a {common_words} {Y} b")])
    items = spark.createDataFrame([(7, f"{common_words} {X}")], "item_id bigint, text string")
    found = {r.doc_id: r.n_equal for r in decontamination.find_leaks(docs, items).collect()}
    assert found == {1: 13, 2: 12}
