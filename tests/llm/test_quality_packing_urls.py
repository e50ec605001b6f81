import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomlog.llm import packing, quality, url_filter
from loomlog.llm.url_filter import Rule


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
    covered = {k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_counts(spark, docs_of, odd_rows):
    rows = [*odd_rows, (30, "a b c a b c a b\na b c\n\na b c \nx | y # é"), (31, "\ud7ff two"), (32, "a b"), (33, "é\u00a0b c\u2003d " * 30)]
    found = quality.judge(docs_of(rows)).collect()
    told = Counter((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    assert told == Counter((str(i), *counts(t)) for i, t in rows)
    assert not any(r.kept for r in found if r.base_failed)


def test_quality_is_native(spark, docs_of):
    plan = quality.judge(docs_of([(1, "a b c")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def prose(i):
    rng = np.random.default_rng(i)
    words = ["the", "of", "and", "to", "in", *(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300))]
    return " ".join(rng.choice(words, 120)) + "."


def test_weak_supervision_separates(spark, docs_of):
    good = [(i, prose(i)) for i in range(120)]
    bad = [(1000 + i, prose(i).upper().replace(" ", "!! ")) for i in range(15)] + [(2000 + i, prose(i).replace(" ", "### ")) for i in range(15)]
    kept = {r.doc_id for r in quality.judge(docs_of(good + bad)).collect() if r.kept}
    assert kept == {i for i, _ in good}
    df = spark.createDataFrame([(*r, "x") for r in good + bad], "doc_id bigint, text string, _row string")
    same = quality.keep_good(df)
    assert same.columns == df.columns and {r.doc_id for r in same.collect()} == kept
    assert quality.judge(docs_of([])).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = ["", None, "hello world", " leading", "a" * 3000, "don't  stop\n\n\tnow 123 4567 !!?", "<|endoftext|> inside", "ünï¢ødé ñ ß", "日本語のテキスト", "emoji 👍🏽 mix", "\u200bzero\ufeffwidth", "ᏣᎳᎩ ꭰ 𞤀 𑄀", "x" * 20 + " " * 500 + "y", "\x00\x01 \x85 \u2028", *(prose(i) * 8 for i in range(30))]


def test_ids_equal_the_tokenizers_library(tokenizer):
    ids = packing.TokenIds()
    for t in TEXTS:
        assert ids(t or "").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("partitions", [1, 7])
def test_packing_keeps_every_id_once(spark, docs_of, tokenizer, partitions):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, " leading")]
    out = packing.pack(docs_of(rows).repartition(partitions)).collect()
    ids = {(i, t): np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for i, t in rows}
    by_sequence = defaultdict(list)
    pieces = defaultdict(list)
    for r in out:
        by_sequence[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for i in {i for i, _ in rows}:
        mine = [v for k, v in ids.items() if k[0] == i]
        n = sum(1 for k, _ in rows if k == i)
        assert sum(r.length for r in pieces[i]) == n * len(mine[0]) and {r.doc_tokens for r in pieces[i]} == {len(mine[0])}
        for r in pieces[i]:
            assert r.ids_crc32 == zlib.crc32(mine[0][r.start : r.start + r.length].tobytes())
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        assert s[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(s, s[1:], strict=False)) and s[-1].offset + s[-1].length <= 1024
    partial = [s for s in by_sequence.values() if sum(r.length for r in s) < 1024]
    assert len(partial) <= max(1, partitions)


def test_packing_merges_leftovers(spark, docs_of):
    out = packing.pack(docs_of([(i, "word") for i in range(40)]).repartition(20)).collect()
    assert len({r.sequence_id for r in out}) == 1 and sum(r.length for r in out) == 80
    assert packing.pack(docs_of([])).count() == 0


PAGES = "page_id bigint, url string, html string, host string, rank string"


def fit(url):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max((r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])), key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_rules(spark):
    urls = [None, "", "nothing", "http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "http://example.org/en/2", "http://x.com/fr/1", "http://x.com/de/", "http://x.com/fr", "http://notorg/", "http://org", "http://org/", "http://b.org?x=/es/", "ftp://É.com/de/ü#://y", "a://b://c.org/x", "http://myexample.org/es/"]
    rows = [(k, u, None, "h", "r") for k, u in enumerate(urls)] + [(3, urls[3], None, "h", "r"), (None, "http://x.com/fr/1", "", "h", "r")]
    out = url_filter.judge_pages(spark.createDataFrame(rows, PAGES)).collect()
    assert len(out) == len(rows)
    for r in out:
        url = urls[r.page_id] if r.page_id is not None else "http://x.com/fr/1"
        host, path, rule, verdict = fit(url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert verdict is None or r.verdict == verdict
    assert url_filter.judge_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_trust_flows_along_links(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [(1, "http://good.test/", link("friend.test"), "", ""), (2, "http://friend.test/", link("far.test"), "", ""), (3, "http://bad.test/", "", "", ""), (4, "http://shady.test/", link("bad.test"), "", ""), (5, "http://far.test/", "", "", ""), (6, "http://lone.test/", None, "", "")]
    rules = (Rule("good.test", "/", True), Rule("bad.test", "/", False))
    got = {r.host: r for r in url_filter.judge_pages(spark.createDataFrame(rows, PAGES), rules).collect()}
    assert {h: r.verdict for h, r in got.items()} == {"good.test": "allow", "friend.test": "allow", "bad.test": "block", "shady.test": "block", "far.test": "allow", "lone.test": "allow"}
    assert got["friend.test"].trust > got["far.test"].trust > 0 and got["shady.test"].distrust > 0


def brute_rank(edges, seeds, rounds, damping):
    out = defaultdict(float)
    for (a, _), w in edges.items():
        out[a] += w
    total = sum(seeds.values())
    start = {h: w / total for h, w in seeds.items()}
    rank = dict(start)
    for _ in range(rounds):
        new = defaultdict(float, {h: r * (1 - damping) for h, r in start.items()})
        for (a, b), w in edges.items():
            new[b] += damping * rank.get(a, 0) * w / out[a]
        lost = damping * sum(r for h, r in rank.items() if h not in out)  # back to the seeds
        for h, r in start.items():
            new[h] += lost * r
        rank = new
    return rank


def test_page_rank_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    edges = {(f"h{a}", f"h{b}"): float(rng.integers(1, 5)) for a, b in rng.integers(0, 12, (40, 2)) if a != b}
    seeds = {"h1": 2.0, "h5": 1.0}
    df = spark.createDataFrame([(*k, w) for k, w in edges.items()], "src string, dst string, w double")
    got = {r.host: r["rank"] for r in url_filter.page_rank(df, spark.createDataFrame(list(seeds.items()), "host string, weight double"), rounds=120).collect()}
    want = brute_rank(edges, seeds, 300, url_filter.DAMPING)
    assert got.keys() == want.keys() and all(abs(got[h] - want[h]) < 1e-8 for h in want)


def test_page_rank_converges(spark):
    rng = np.random.default_rng(5)
    edges = {(f"h{a}", f"h{b}"): float(rng.integers(1, 5)) for a, b in rng.integers(0, 12, (40, 2)) if a != b}
    edges |= {(f"c{k}", f"c{k + 1}"): 1.0 for k in range(14)}
    seeds = {"h1": 2.0, "c0": 1.0}
    df = spark.createDataFrame([(*k, w) for k, w in edges.items()], "src string, dst string, w double")
    got = {r.host: r["rank"] for r in url_filter.page_rank(df, spark.createDataFrame(list(seeds.items()), "host string, weight double")).collect()}
    want = brute_rank(edges, seeds, 400, url_filter.DAMPING)
    assert abs(sum(got.values()) - 1) < 1e-9 and abs(sum(want.values()) - 1) < 1e-9
    assert got.keys() == want.keys() and all(abs(got[h] - want[h]) <= 2 * url_filter.TOLERANCE * want[h] for h in want)


def test_distrust_flows_along_a_chain_of_15_hosts(spark):
    rows = [(k, f"http://c{k}.test/", f'<a href="http://c{k + 1}.test/">', "", "") for k in range(15)] + [(99, "http://c15.test/", "", "", "")]
    got = url_filter.judge_pages(spark.createDataFrame(rows, PAGES), (Rule("c15.test", "/", False),)).collect()
    whole = sum(0.85**k for k in range(16))
    assert {r.verdict for r in got} == {"block"} and all(abs(r.distrust - 0.85 ** (15 - int(r.host[1:-5])) / whole) < 1e-9 for r in got)


def test_verdicts_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    hosts = [f"h{k}.test" for k in range(16)]
    links = {h: sorted({hosts[j] for j in rng.integers(0, 16, 2)} - {h}) if k % 4 else [] for k, h in enumerate(hosts)}
    rows = [(k, f"http://{h}/", "".join(f'<a href="http://{x}/">' for x in links[h]), "", "") for k, h in enumerate(hosts)]
    rules = (Rule("h1.test", "/", True), Rule("h2.test", "/", False), Rule("h3.test", "/", True), Rule("h6.test", "/", False))
    seeds = {r.host: r.allow for r in rules}
    forward = {(a, b): 1.0 for a in hosts for b in links[a]}
    trust = brute_rank(forward, {h: 1.0 for h, allow in seeds.items() if allow}, 300, url_filter.DAMPING)
    distrust = brute_rank({(b, a): 1.0 for a, b in forward}, {h: 1.0 for h, allow in seeds.items() if not allow}, 300, url_filter.DAMPING)
    # links count backwards as they weigh forwards, each host's shares adding up to one
    got = {r.host: r for r in url_filter.judge_pages(spark.createDataFrame(rows, PAGES), rules).collect()}
    for h in hosts:
        assert abs(got[h].trust - trust.get(h, 0) / 2) < 1e-4 and abs(got[h].distrust - distrust.get(h, 0) / 2) < 1e-4
        want = seeds.get(h, distrust.get(h, 0) <= 2 * trust.get(h, 0))
        assert got[h].verdict == ("allow" if want else "block")
    assert {r.verdict for r in got.values() if r.host not in seeds} == {"allow", "block"}


def test_hosts_under_public_suffixes_share_no_parent(spark):
    pages = spark.createDataFrame([("a.co.uk", None), ("x.a.co.uk", None), ("b.co.uk", None)], "host string, html string")
    assert {(r.src, r.dst) for r in url_filter.host_edges(pages).collect()} == {("x.a.co.uk", "a.co.uk"), ("a.co.uk", "x.a.co.uk")}


def test_rounds_take_tasks_by_the_graph(spark):
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        edges = spark.createDataFrame([(f"h{i}", f"h{(i * 7 + 1) % 40}", 1.0) for i in range(40)], "src string, dst string, w double")
        seeds = spark.createDataFrame([("h0", 1.0), ("h5", 2.0)], "host string, weight double")
        rank = url_filter.page_rank(edges, seeds, rounds=4)
        assert rank.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism  # 64 before, and as many shuffle files in every round
        assert abs(rank.agg(F.sum("rank")).first()[0] - 1) < 1e-9
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
