import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda rows, schema="doc_id bigint, text string": frame(spark, rows, schema)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, words of every separator, a long text."""
    passage = " ".join(f"w{i}" for i in range(60))
    return [
        (1, f"{passage} tail one"),
        (2, f"head {passage}\x0bx"),
        (None, f"q {passage}"),
        (3, None),
        (4, ""),
        (5, " \t\n\x0b\f\r"),
        (6, f"{passage} tail one"),
        (6, f"{passage} tail one"),
        (7, f"A {passage.upper()}"),
        (7, "other text of the same id é ü \u00a0 x"),
        (8, "a " * 3000),
        (9, "ab" * 2000 + passage),
        (10, f"{passage} {passage} tail"),
        (11, "x" * 50_000),
    ]
