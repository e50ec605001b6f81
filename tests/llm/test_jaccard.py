import re
from collections import defaultdict

import numpy as np
import pytest
from test_dedup import corpus

from loomlog.llm import jaccard_join as J

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def expected(rows):
    """(shown id, set size, component) of each row by comparing all pairs."""
    keys = [(1 << 63) - 1 if i is None else i for i, _ in rows]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    same = defaultdict(list)
    for k, row in enumerate(rows):
        same[row].append(k)
    for group in same.values():  # repeated rows stand for one document
        for k in group[1:]:
            root[find(k)] = find(group[0])
    for a in range(len(rows)):
        for b in range(a):
            x = len(sets[a] & sets[b])
            if x and 100 * x >= 85 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 64)
    for k in range(len(rows)):
        least[find(k)] = min(least[find(k)], keys[k])
    return sorted((str(rows[k][0]), len(sets[k]), str(None if least[find(k)] == (1 << 63) - 1 else least[find(k)])) for k in range(len(rows)))


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"small_tile": 2}, {"small_tile": 2, "block": 3}])
def test_equals_all_pairs(spark, docs_of, options):
    rows = corpus(11, 150)
    assert got(J.join_documents(docs_of(rows).repartition(4), **options)) == expected(rows)


@pytest.mark.parametrize("options", [{}, {"small_tile": 2, "block": 2}])
def test_odd_rows(spark, docs_of, odd_rows, options):
    assert got(J.join_documents(docs_of(odd_rows), **options)) == expected(odd_rows)


def test_threshold_is_met_exactly(spark, docs_of):
    base = [f"w{i}" for i in range(103)]  # 100 shingles
    cut = lambda k: " ".join(base[: 103 - k])
    rows = [(1, cut(0)), (2, cut(15)), (3, cut(0)[:-4] + " end"), (4, cut(16)), (5, " ".join(f"z{i}" for i in range(50)))]
    ids = {r.doc_id: r.component_id for r in J.join_documents(docs_of(rows)).collect()}
    assert ids == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    ids = {r.doc_id: r.component_id for r in J.join_documents(docs_of([(1, cut(0)), (4, cut(16))])).collect()}
    assert ids == {1: 1, 4: 4}


def test_one_of_each_component_stays(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(3, text, "a", 1), (1, text + " x", "b", 2), (1, text + " x", "b", 2), (2, "", "c", 3), (None, None, "d", 4), (9, "short one", "e", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, place string, n_chars int")
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.place) for r in kept.collect()) == [("1", "b"), ("2", "c"), ("9", "e"), ("None", "d")]


def test_empty(spark, docs_of):
    assert J.join_documents(docs_of([])).count() == 0 and J.keep_one(docs_of([])).count() == 0


def test_bit_counts_bound_the_overlap():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 250))) for _ in range(2))
        x, y = J.bitmap(a), J.bitmap(b)
        words = min(len(x), len(y))
        differ = int(np.bitwise_count(J.folded(x, words) ^ J.folded(y, words)).sum())
        assert J.overlap(a, b) == len(np.intersect1d(a, b)) <= (len(a) + len(b) - differ) // 2


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u int, v int")
    roots = {r.node: r.root for r in J.components(edges).collect()}
    assert roots == {i: 0 for i in range(1, 201)} | {501: 500} | ({0: 0} if 0 in roots else {}) | ({500: 500} if 500 in roots else {})


@pytest.mark.parametrize("hub", [1, 5, 1000])
def test_components_around_hubs(spark, hub):
    """Stars around least, middle and greatest nodes, some of them linked; ``hub`` decides what is broadcast."""
    rng = np.random.default_rng(hub)
    pairs = [(c, int(x)) for c in (0, 150, 399) for x in rng.choice(400, 60, replace=False)]
    pairs += [tuple(map(int, rng.choice(range(400, 700), 2))) for _ in range(120)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got_ = {r.node: r.root for r in J.components(spark.createDataFrame(pairs, "u int, v int"), hub).collect()}
    assert all(got_.get(x, x) == find(x) for x in root)
    assert J.components(spark.createDataFrame([], "u int, v int"), hub).count() == 0


@pytest.mark.parametrize("block", [4, 9, 40])
def test_crowded_shingles_equal_all_pairs(spark, docs_of, block):
    """Clusters of near copies in many sizes, with parts that only some members link, and documents of common passages only."""
    rng = np.random.default_rng(block)
    rows, passages = [], [[f"p{i}x{j}" for j in range(14)] for i in range(5)]
    for c in range(3):
        base = [f"c{c}w{i}" for i in range(70)]
        for k in range(45):
            words = base[: 70 - int(rng.integers(0, 14))]
            for _ in range(int(rng.integers(0, 3))):
                words[int(rng.integers(len(words)))] = f"e{c}x{k}"
            rows.append((len(rows), " ".join(words)))
    for _ in range(60):
        rows.append((len(rows), " ".join(w for i in rng.permutation(5)[: int(rng.integers(2, 6))] for w in passages[i])))
    rows += [rows[7], (500, rows[3][1]), (None, rows[9][1] + " end")]
    calls = []
    monkey = pytest.MonkeyPatch()
    monkey.setattr(J._Crowd, "rest", lambda *a, f=J._Crowd.rest: calls.append(f(*a)) or calls[-1])
    try:
        assert got(J.join_documents(docs_of(rows).repartition(2), block=block, small_tile=2)) == expected(rows)
    finally:
        monkey.undo()
    assert calls and (block == 40 or calls[0] is not None)


def test_partners_and_bit_counts_lose_no_link():
    """Against all pairs of random sets: their first common element passes the rule of places, and their bitmaps leave them connected."""
    rng = np.random.default_rng(7)
    order = rng.permutation(5000).argsort()
    for percent in (80, 85):
        sets = []
        for _ in range(60):
            base = rng.choice(5000, int(rng.integers(3, 150)), replace=False)
            sets += [np.unique(base[int(rng.integers(0, len(base) // 4 + 1)) :]) for _ in range(3)]
        sets.sort(key=len)
        n = np.array([len(s) for s in sets])
        hashes = [np.sort(J.common.mix(s.astype(np.uint64))) for s in sets]
        label = J.alike(n, [J.bitmap(h) for h in hashes], np.full(len(n), J.ALL), percent)
        ranked = [sorted(s.tolist(), key=lambda x: order[x]) for s in sets]
        linked = 0
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                both = np.intersect1d(sets[i], sets[j])
                if len(both) and 100 * len(both) >= percent * len(np.union1d(sets[i], sets[j])):
                    linked += 1
                    first = min(both.tolist(), key=lambda x: order[x])
                    at = np.array([ranked[i].index(first), ranked[j].index(first)])
                    assert label[i] == label[j] and (at < [J.prefix_length(n[i], percent), J.prefix_length(n[j], percent)]).all()
                    assert min(n[i] - at[0], n[j] - at[1]) >= J.needed(n[i], n[j], percent) and J.has_partner(n[[i, j]], at, percent).all()
        assert linked > 30 and len(set(label.tolist())) > 20


def test_common_passages_and_copies_send_no_texts(spark, docs_of, monkeypatch):
    """Documents of one passage that no count of shingles tells as frequent: their bitmaps part them. Copies are not paired with each other."""
    passage = " ".join(f"p{i}" for i in range(40))
    text = lambda i: f"{passage} " + " ".join(f"d{i}x{j}" for j in range(120))
    rows = [(i, text(i)) for i in range(300)] + [(1000 + i, text(7)) for i in range(6)]
    monkeypatch.setattr(J, "HOT_LEAST", 10**6)
    sent, kept, links, checkpointed = [], [], J._Comparison.links, J.common.checkpointed
    monkeypatch.setattr(J._Comparison, "links", lambda self, blobs: sent.append(blobs.count()) or links(self, blobs))
    monkeypatch.setattr(J.common, "checkpointed", lambda df: kept.append(checkpointed(df)) or kept[-1])
    found = {r.doc_id: r.component_id for r in J.join_documents(docs_of(rows).repartition(8)).collect()}
    assert found == {i: 7 if i >= 1000 else i for i, _ in rows}
    tiled = next(df for df in kept if "kind" in df.columns)
    assert sent == [0] and tiled.filter(f"kind = {J.PAIRS}").count() == 0
