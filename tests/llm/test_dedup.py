import hashlib
import random
import re

import numpy as np
import pytest

from loomlog.llm import repeats, substring_dedup, suffix_array_dedup

NULL_ID = (1 << 63) - 1


def brute(rows, units, length):
    """Kept mask of each row: windows that also start at a smaller (doc_id, start) go."""
    first = {}
    cut = [(NULL_ID if i is None else i, units(t or "")) for i, t in rows]
    for i, u in cut:
        for p in range(len(u) - length + 1):
            w = tuple(u[p : p + length])
            first[w] = min(first.get(w, (i, p)), (i, p))
    out = []
    for i, u in cut:
        keep = [True] * len(u)
        for p in range(len(u) - length + 1):
            if first[tuple(u[p : p + length])] < (i, p):
                keep[p : p + length] = [False] * length
        out.append((u, keep))
    return out


words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
sha = lambda b: hashlib.sha256(b).hexdigest()


def expected_words(rows, window):
    return sorted((str(i), len(u), keep.count(False), sha(" ".join(w for w, k in zip(u, keep, strict=True) if k).encode())) for (i, _), (u, keep) in zip(rows, brute(rows, words, window), strict=True))


def expected_bytes(rows, window):
    out = []
    for (i, _), (u, keep) in zip(rows, brute(rows, lambda t: t.encode(), window), strict=True):
        spans = sum(1 for p, k in enumerate(keep) if not k and (p == 0 or keep[p - 1]))
        out.append((str(i), len(u), keep.count(False), spans, sha(bytes(w for w, k in zip(u, keep, strict=True) if k))))
    return sorted(out)


def got(df, *names):
    return sorted((str(r.doc_id), *(r[n] for n in names)) for r in df.collect())


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passages = [text(rng.randint(15, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [text(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), text(rng.randint(0, 30))]
        if rows and rng.random() < 0.25:
            base = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = "edit"
            parts = [" ".join(base)]
        rows.append((i, " ".join(parts)))
    rng.shuffle(rows)
    return rows


@pytest.fixture(params=[{}, {"budget": 1}, {"piece": 300}], ids=["whole groups", "split groups", "documents in pieces"])
def budget(request, monkeypatch):
    for name, value in request.param.items():
        monkeypatch.setitem(repeats.repeated_spans.__kwdefaults__, name, value)


def test_words_equal_brute_force(spark, docs_of, budget):
    rows = corpus(1)
    assert got(substring_dedup.dedup_words(docs_of(rows).repartition(5)), "n_words", "n_removed", "kept_sha256") == expected_words(rows, 20)


def test_bytes_equal_brute_force(spark, docs_of, budget):
    rows = corpus(2, 90)
    assert got(suffix_array_dedup.dedup_bytes(docs_of(rows).repartition(5)), "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected_bytes(rows, 100)


def test_odd_rows(spark, docs_of, odd_rows, budget):
    assert got(substring_dedup.dedup_words(docs_of(odd_rows)), "n_words", "n_removed", "kept_sha256") == expected_words(odd_rows, 20)
    short = [r for r in odd_rows if r[0] != 11] + [(11, "x" * 3000)]
    assert got(suffix_array_dedup.dedup_bytes(docs_of(short)), "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected_bytes(short, 100)


def test_small_windows(spark, docs_of):
    rows = corpus(3, 40)
    assert got(substring_dedup.dedup_words(docs_of(rows), window=5, anchor=2), "n_words", "n_removed", "kept_sha256") == expected_words(rows, 5)
    assert got(suffix_array_dedup.dedup_bytes(docs_of(rows), window=24, anchor=8), "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected_bytes(rows, 24)


@pytest.mark.parametrize("piece", [150, 700])
def test_long_documents_are_read_in_pieces(piece):
    rng = random.Random(piece)
    vocabulary = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(30)]
    data = np.frombuffer(" ".join(rng.choice(vocabulary) for _ in range(900)).encode() + b" " + b"z" * 2000 + b" end", dtype=np.uint8)
    offsets = np.array([0, len(data)])
    for reader, length, k in ((repeats.word_units, 20, 8), (repeats.byte_units, 100, 32)):
        whole = reader(data, offsets)
        covered, before = np.zeros(len(whole.values), dtype=int), 0
        for units, base in repeats.stretches(reader, data, offsets, length, piece):
            assert np.array_equal(units.values, whole.values[base : base + len(units.values)])
            _, _, first, windows, _ = repeats.contexts(units, length, k)
            for s, n in zip(first + base, windows, strict=True):
                covered[s : s + n] += 1
                assert before < s + n + length - 1 <= base + len(units.values)
            before = base + len(units.values)
        assert before == len(whole.values) and covered[: len(covered) - length + 1].tolist() == [1] * (len(covered) - length + 1)


def test_kept_texts_and_clashing_columns(spark):
    text = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(1, text, "p", 1, b"b"), (2, f"{text} end", "p", 2, b"c")], "doc_id bigint, text string, place string, check int, body binary")
    assert {r.doc_id: r.kept_text for r in substring_dedup.dedup_words(df).collect()} == {1: text, 2: "end"}
    kept = {r.doc_id: bytes(r.kept) for r in suffix_array_dedup.dedup_bytes(df, window=50, anchor=16).collect()}
    assert kept == {1: text.encode(), 2: b" end"}


def test_empty_tables(spark, docs_of):
    assert substring_dedup.dedup_words(docs_of([])).count() == 0
    assert suffix_array_dedup.dedup_bytes(docs_of([])).count() == 0


def test_suffix_tree():
    units = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3, 9], dtype=np.uint64)
    tree = substring_dedup.SuffixTree(units, np.array([0, 3, 6]), 3)
    assert tree.order.tolist() in ([0, 6, 3], [0, 2, 1]) and tree.common.tolist() == [0, 3, 2]
    node = tree.deep_nodes(3)
    assert node[0] == node[2] != node[1] and len(set(tree.deep_nodes(2))) == 1


@pytest.mark.parametrize("seed", range(60))
def test_run_length_index(seed):
    r = np.random.default_rng(seed)
    parts = []
    for _ in range(r.integers(1, 8)):
        parts += [np.tile(r.integers(97, 97 + r.integers(1, 4), r.integers(1, 12)), r.integers(1, 6)).astype(np.uint8), np.array([255], np.uint8)]
    t = np.concatenate(parts)
    order = sorted(range(len(t)), key=lambda i: t[i:].tobytes() + b"\xff" * len(t))
    assert suffix_array_dedup.suffix_order(t).tolist() == order
    length, there = suffix_array_dedup.RunLengthIndex(t).matching_statistics()
    for a, b in zip(order[1:], order, strict=False):
        x = 0
        while max(a, b) + x < len(t) and t[a + x] == t[b + x]:
            x += 1
        assert length[a] == x and (not x or there[a] == b)
    index = suffix_array_dedup.RunLengthIndex(t)
    assert int(index.lengths.sum()) == len(t) and len(index.symbols) == len(index.first) == len(index.last)


def test_crowded_anchors_meet_by_context(spark, docs_of, monkeypatch):
    """A phrase of a third of all documents, among other words in each, and many rows without an id or with one text."""
    rng = random.Random(8)
    rare = lambda i, k: " ".join(f"v{i}x{rng.randrange(10**6)}" for _ in range(k))
    phrase = " ".join(f"common{j}" for j in range(12))
    rows = [(None if i % 5 == 0 else i, f"{rare(i, 25)} {phrase} {rare(i, 25)}") for i in range(60)]
    rows += [(100, rows[1][1])] * 30 + [(101 + i, f"{rows[2][1]} {rare(i, 3)}") for i in range(30)]
    docs = docs_of(rows).repartition(3).cache()
    for reader, unit, k in ((repeats.word_units, 20, 8), (repeats.byte_units, 100, 32)):
        found = repeats.crowded(docs.select("text"), reader, length=unit, k=k, budget=20, piece=repeats.PIECE_BYTES)
        assert 0 < len(found) < 50 and np.array_equal(found, np.unique(found))
    monkeypatch.setitem(repeats.repeated_spans.__kwdefaults__, "budget", 20)
    assert got(substring_dedup.dedup_words(docs), "n_words", "n_removed", "kept_sha256") == expected_words(rows, 20)
    assert got(suffix_array_dedup.dedup_bytes(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected_bytes(rows, 100)


def test_repeated_rows_travel_once():
    rows = np.zeros(5, dtype=repeats.PLACED)
    rows["anchor"], rows["context"], rows["doc"], rows["check"] = 1, [7, 7, 7, 7, 8], [3, 3, 3, 4, 3], [1, 1, 2, 1, 1]
    left, opens, first = repeats.earliest(rows, ("anchor", "context"))
    assert left[["context", "doc", "check"]].tolist() == [(7, 3, 1), (7, 3, 2), (7, 4, 1), (8, 3, 1)]
    assert opens.tolist() == [True, False, False, True] and first.tolist() == [True, True, False, True]
