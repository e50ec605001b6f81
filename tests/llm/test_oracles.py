"""Queries against their SQL, on whole tables and on odd rows."""

import os

import duckdb
import pytest

from loomlog.llm import queries

NAMES = sorted(queries.ORACLES)


def rows_of(table):
    return sorted(zip(*(table.column(c).to_pylist() for c in sorted(table.column_names)), strict=True), key=repr)


def compared(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        path = f"{folder}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    found = queries.QUERIES[name](spark, folder).toArrow()
    told = con.sql(queries.ORACLES[name]).to_arrow_table()
    assert sorted(found.column_names) == sorted(told.column_names)
    return rows_of(found), rows_of(told)


@pytest.mark.parametrize("name", NAMES)
def test_whole_table(spark, name):
    found, told = compared(spark, "/root/testdata/sf0.01", name)
    assert len(found) == {"op11_vector_codes": 500}.get(name, 1000) and found == told


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, docs_of, odd_rows, tmp_path, name):
    seen, rows = set(), []
    for i, t in odd_rows:  # the SQL tells documents apart by their ids
        if i is not None and i not in seen:
            seen.add(i)
            rows.append((i, t))
    rows += [(20, "a b"), (21, "A B"), (22, "ünï " * 90), (23, "ünï " * 70 + " ß x\n\nx"), (24, "ü" * 300)]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(k, [float((k * j) % 7 - 3) / 4 for j in range(1, 9)], k % 3) for k in range(300)]
    vectors += [(300, None, 1), (301, [1.0] * 7 + [None], 1), (302, [float("nan")] * 8, 1), (303, [float("inf")] * 8, 1), (304, [0.5] * 8, None), (305, [0.5] * 8, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found, told = compared(spark, str(tmp_path), name)
    assert found == told
