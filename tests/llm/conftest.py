from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, clashing names."""
    long = " ".join(f"w{i % 977}{i % 13}" for i in range(40_000)) + "\n" + "x" * 70_000
    text = "One two three four five six seven eight. " * 3
    data = [
        (1, text, None, "a", 1),
        (1, text, None, "a", 1),
        (1, "another text under the same number with a few words", "en", None, 2),
        (2, text, "en", "b", 3),
        (3, None, "en", "b", None),
        (4, "", None, None, 0),
        (5, " \t\n \n", "de", "c", 4),
        (6, "short", "de", "c", 5),
        (None, text, "fr", "c", 6),
        (None, None, None, None, None),
        (7, long, "en", "d", len(long)),
        (8, "É世界 \U0001f600 ß\u2581\x00 " * 8, "xx", "d", 9),
    ]
    schema = (
        "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, "
        "component string, text_key string, score double, `group` int, id string, h1 int, `a b` string"
    )
    return spark.createDataFrame([(*r, "x", "y", "z", 0.5, 1, "i", 2, "s") for r in data], schema)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
