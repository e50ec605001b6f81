import random
import re

import pytest

from pyspark.sql import functions as F
from test_jaccard import expected as near_expected
from test_quality_packing_urls import counts, prose

import __spark_entry__
import corpus_pipeline
from loomlog.llm import decontamination, pii, quality
from loomlog.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def test_stages_on_a_planted_corpus(spark, tmp_path):
    good = [(i, prose(i), "en", "s", 0) for i in range(60)]
    near = [(100, prose(0) + " extra", "en", "s", 0), (101, prose(1), "en", "s", 0)]
    bench = prose(500)[:300]
    rows = [*good, *near, (200, "short text", "en", "s", 0), (201, prose(9).upper().replace(" ", "!! "), "en", "s", 0), (202, f"{prose(10)} {bench}", "en", "s", 0), (203, f"mail bob.1@example.com now {prose(999)}x", "en", "s", 0), (None, prose(77), "en", "s", 0), (204, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id for r in docs.collect()}
    every = {r[0] for r in rows}
    assert every - kept["quality"] == {200, 201, 204}
    assert kept["quality"] - kept["near_duplicates"] == {100, 101}
    assert kept["near_duplicates"] - kept["decontamination"] == {202}
    assert kept["decontamination"] == kept["pii"]
    text = docs.filter("doc_id = 203").first()
    assert text.text.startswith("mail <email> now ") and text.n_chars == len(text.text)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept["pii"]


def test_stages_equal_brute_force_on_the_table(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    first = corpus_pipeline.STAGES[0][1](spark, table, DATA).cache()
    judged = {r.doc_id: r for r in quality.judge(table).collect()}
    assert {r.doc_id for r in first.collect()} == {i for i, t in rows if not counts(t)[-1] and judged[i].p_good >= quality.KEEP_AT}
    left = [(r.doc_id, r.text) for r in first.collect()]
    second = corpus_pipeline.STAGES[1][1](spark, first, DATA).cache()
    assert {str(r.doc_id) for r in second.collect()} == {c for _, _, c in near_expected(left)}
    leaked = {r.doc_id for r in decontamination.find_leaks(second, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    third = corpus_pipeline.STAGES[2][1](spark, second, DATA)
    assert {r.doc_id for r in third.collect()} == {r.doc_id for r in second.collect()} - leaked
    fourth = corpus_pipeline.STAGES[3][1](spark, second, DATA)
    finder = pii.Finder()
    assert {r.doc_id: r.text for r in fourth.collect()} == {r.doc_id: pii.redact_text(r.text, finder.spans(r.text)) for r in second.collect()}


def test_near_duplicates_equal_a_brute_force_over_five_words(spark):
    rng = random.Random(6)
    rows = []
    for k in range(0, 120, 4):
        base = [f"w{k}x{i}" for i in range(200)]
        rows.append((k, " ".join(base)))
        for j in (1, 2, 3):  # appended words and scattered substitutions on both sides of 0.8
            near = base + [f"n{k}x{j}x{i}" for i in range(rng.randint(30, 60))] if j < 3 else [f"s{k}" if rng.random() < 0.02 else w for w in base]
            rows.append((k + j, " ".join(near)))
    rows += [(500, " ".join(f"q{i}" for i in range(200))), (501, " ".join(f"q{i}" for i in range(240)))]  # 196 of 236 shingles
    sets = {i: {tuple(w[p : p + 5]) for p in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    least = {i: i for i in sets}
    for _ in range(4):  # components of at most four documents
        for a in sets:
            for b in sets:
                x = len(sets[a] & sets[b])
                if x and 100 * x >= 80 * len(sets[a] | sets[b]):
                    least[a] = min(least[a], least[b])
    want = set(least.values())
    assert 500 in want and 501 not in want
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()} == want


def test_queries_are_registered(spark):
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {re.match(r"[a-z]+\d*", n)[0] for n in names} and "pipeline" in names
    assert set(ORACLES) <= set(QUERIES) and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_on_the_table(spark, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    key = "page_id" if name.startswith("op4") else "doc_id"
    n = df.count()
    if name[:4] in ("op1_", "op2_", "op3_", "op4_", "op5_", "op6_", "op8_"):
        assert n == spark.read.parquet(f"{DATA}/{'pages' if key == 'page_id' else 'documents'}.parquet").count()
    assert df.select(F.col(key).cast("bigint")).filter(f"{key} is null").count() == 0
