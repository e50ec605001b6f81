"""Vector codes and whitening against brute force in plain Python integers and eigh, and their cases."""

import hashlib
import math

import numpy as np
import pytest

from loomlog.llm import vector_codes, vectors, whitening
from tests.conftest import DATA

SCHEMA = "vec_id bigint, embedding array<float>, label int"
BAD = [None, [], [1.0, None, 2.0, 3.0, 0.0, 0.0, 0.0, 0.0], [math.nan] * 8, [math.inf] + [0.0] * 7]


def good_rows(rows):
    return [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]


def brute_codes(rows, parts, entries, rounds):
    rows = sorted(good_rows(rows), key=lambda r: (r[0] is None, r[0]))
    xs = [[math.floor(1024 * float(np.float32(c))) for c in r[1]] for r in rows]
    w = len(xs[0]) // parts
    cut = [[x[p * w : (p + 1) * w] for p in range(parts)] for x in xs]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda part, book: min(range(len(book)), key=lambda e: (far(part, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            mine = [(near(c[p], books[p]), c[p]) for c in cut]
            new = list(books[p])
            for e in range(len(new)):
                of = [x for k, x in mine if k == e]
                if of:
                    new[e] = [sum(col) // len(of) for col in zip(*of, strict=True)]
            books[p] = new
    told = []
    for r, c in zip(rows, cut, strict=True):
        k = [near(c[p], books[p]) for p in range(parts)]
        told.append((r[0], bytes(k).hex(), sum(far(c[p], books[p][k[p]]) for p in range(parts)), r[2]))
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return told, digest


def some_rows(n, dims, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=dims)], int(rng.integers(3)) if i % 7 else None) for i in range(n)]
    rows += [rows[5], (n, rows[6][1], 1), (None, rows[7][1], None)]
    return rows + [(n + 1 + i, v, 0) for i, v in enumerate(BAD)]


def test_codes_equal_brute_force(spark):
    rows = some_rows(90, 8)
    extra = [(*r, "x", 1) for r in rows]
    df = spark.createDataFrame(extra, SCHEMA + ", code string, x int").repartition(5)
    coded, books = vector_codes.compress(df, entries=16)
    told, digest = brute_codes(rows, 4, 16, vector_codes.ROUNDS)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.vec_id, r.code, r.error, r.label) for r in coded.collect()), key=key) == sorted(told, key=key)
    assert books.digest() == digest


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").limit(400).collect()]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA))
    told, digest = brute_codes(rows, 4, 256, vector_codes.ROUNDS)
    assert sorted((r.vec_id, r.code, r.error, r.label) for r in coded.collect()) == sorted(told)
    assert books.digest() == digest


def test_label_errors_and_decoding(spark, tmp_path):
    rows = some_rows(60, 8)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op11_vector_codes(spark, str(tmp_path)).collect()
    by = {}
    coded, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA))
    for r in coded.collect():
        by[r.label] = by.get(r.label, 0) + r.error
    told = {r.vec_id: r.label for r in coded.collect()}
    assert len(got) == len(good_rows(rows)) and all(r.label_error == by[told[r.vec_id]] for r in got)
    for r in vector_codes.decode(coded, books).collect():
        entries = [books.entries[p][b] for p, b in enumerate(bytes.fromhex(r.code))]
        assert r.vector == [v / 1024 for e in entries for v in e.tolist()]


def test_ties_take_the_first_entry():
    books = vector_codes.Codebooks(np.array([[[0], [2], [2]]] * 2, dtype=np.int64))
    found, least = books.nearest(np.array([[1, 2], [3, -5]]))
    assert found.tolist() == [[0, 1], [1, 0]] and least.tolist() == [[1, 0], [1, 25]]


def test_large_components_stay_exact(spark):
    rows = [(i, [float(v)] * 4, 0) for i, v in enumerate((0, 100_000, 100_001, -100_000))]
    coded, _ = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), entries=2, rounds=1)
    told, _ = brute_codes(rows, 4, 2, 1)
    assert sorted((r.vec_id, r.code, r.error, r.label) for r in coded.collect()) == told
    with pytest.raises(ValueError, match="64 bits"):
        vector_codes.compress(spark.createDataFrame([(1, [3e9] * 4, 0)], SCHEMA))
    with pytest.raises(Exception, match="no exact integer"):
        vector_codes.compress(spark.createDataFrame([(1, [3e38] * 4, 0)], SCHEMA))


@pytest.mark.parametrize("query, n", [(vector_codes.op11_vector_codes, 5), (whitening.op13_whitening, 7)])
def test_empty_tables(spark, tmp_path, query, n):
    spark.createDataFrame([(9, v, 1) for v in BAD], SCHEMA).write.parquet(f"{tmp_path}/bad/embeddings.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    for folder in ("bad", "none"):
        got = query(spark, f"{tmp_path}/{folder}")
        assert got.count() == 0 and len(got.columns) == n
    spark.createDataFrame([(9, [0.5] * 64, 1)], SCHEMA).write.parquet(f"{tmp_path}/one/embeddings.parquet")
    one = query(spark, f"{tmp_path}/one")
    assert one.dtypes == got.dtypes and one.count() == (n == 5)


def test_other_lengths_are_dropped(spark):
    rows = [(i, [float(i), 1.0, 2.0, float(i * i % 5)], 0) for i in range(6)] + [(6, [1.0] * 8, 0)]
    coded, _ = vector_codes.compress(spark.createDataFrame(rows, SCHEMA))
    assert {r.vec_id for r in coded.collect()} == set(range(6))
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 6, 0)], SCHEMA))


def brute_whitening(rows):
    rows = good_rows(rows)
    xs = [tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in r[1]) for r in rows]
    fit = sorted(set(xs))
    n, dims = len(fit), len(fit[0])
    s = [sum(x[d] for x in fit) for d in range(dims)]
    z = np.array([[n * x[d] - s[d] for d in range(dims)] for x in fit], dtype=np.float64) / n
    e, v = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-e)
    deviation = [sum((n * x[d] - s[d]) ** 2 for d in range(dims)) for x in xs]
    centred = np.array([[n * x[d] - s[d] for d in range(dims)] for x in xs], dtype=np.float64) / n
    return n, deviation, centred @ v[:, order] / np.sqrt(e[order]), e[order] / e.sum(), [r[0] for r in rows]


@pytest.mark.parametrize("dims, n", [(24, 300), (3, 40)])
def test_whitening_equals_eigenvectors(spark, dims, n, monkeypatch):
    monkeypatch.setattr(vectors, "FAN", 2)
    rng = np.random.default_rng(5)
    stretch = np.linspace(3, 0.4, dims)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=dims) * stretch], 0) for i in range(n)]
    rows += [rows[3], (n, rows[4][1], 0)] * 40 + [(n + 1 + i, v, 0) for i, v in enumerate(BAD)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], SCHEMA + ", component double").repartition(7)
    got, w = whitening.whiten(df)
    got = got.collect()
    count, deviation, white, explained, ids = brute_whitening(rows)
    k = min(16, dims)
    assert len(got) == k * len(ids) and w.fit.n == count == n
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for i, vec in enumerate(ids):
        for c in range(1, k + 1):
            r = by[vec, c][0]
            assert r.n == n and r.deviation == deviation[i] and abs(r.explained / explained[c - 1] - 1) < 1e-9 and r.identity_error < 1e-9
            sign = signs.setdefault(c, 1 if r.whitened * white[i, c - 1] > 0 else -1)
            assert abs(r.whitened - sign * white[i, c - 1]) < 1e-8
    assert all(len({r.whitened for r in same}) == 1 for same in by.values())


def test_small_deviations_are_accurate():
    rng = np.random.default_rng(1)
    u, _ = np.linalg.qr(rng.normal(size=(200, 6)))
    v, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    values = 10.0 ** -np.arange(6)
    found, vectors_ = whitening.jacobi(np.linalg.qr(u * values @ v.T, mode="r"))
    assert np.allclose(found / values, 1, rtol=1e-10) and np.allclose(np.abs((vectors_ @ v).diagonal()), 1, atol=1e-10)


def test_no_variance_no_rows(spark):
    rows = [(i, [1.0, float(i % 3), 2.0, 0.0], 0) for i in range(9)]
    got, w = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    assert {r.component for r in got.collect()} == {1} and w.fit.n == 3
    got, w = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, SCHEMA))
    assert got.count() == 0 and w.fit.n == 1


def test_wide_integers_are_exact(spark):
    rows = [(i, [float(i * 2**40), float(i % 2)], 0) for i in range(5)]
    got, _ = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    xs = [(i * 2**46, i % 2 * 64) for i in range(5)]
    s = [sum(x[d] for x in xs) for d in range(2)]
    want = {i: sum((5 * x[d] - s[d]) ** 2 for d in range(2)) for i, x in enumerate(xs)}
    assert all(int(r.deviation) == want[r.vec_id] for r in got.collect())
