"""Ranked search against its plain version and on odd rows."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from trialbraid.llm import search
from trialbraid.llm.catalog import LLM_QUERIES


def found(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def frames(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, score int, item string"),
        spark.createDataFrame(items, "item_id bigint, text string, rank int"),
    )


def test_query_equals_plain_version(spark, sf_dir, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    expected = sorted(brute.ranked(rows, items), key=str)
    assert found(LLM_QUERIES["op13_ranked_search"](spark, sf_dir)) == expected


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.sampled_from([0, 1, 2]))
def test_limited_accumulators_lose_nothing(seed, k, known):
    """Random postings: the k best scores are those of a full evaluation, also above a floor."""
    rng = np.random.default_rng(seed)
    n_docs, n_terms = int(rng.integers(1, 60)), int(rng.integers(1, 12))
    held = rng.random((n_terms, n_docs)) < rng.random((n_terms, 1)) ** 2
    part = rng.integers(1, 5, (n_terms, n_docs)) * held
    weights = np.sort(rng.integers(0, 6, n_terms))[::-1].astype(np.int64)
    term, row = np.nonzero(held)
    postings = (
        np.searchsorted(term, np.arange(n_terms + 1)), row, part[held].astype(np.int64),
        part.max(1, initial=0).astype(np.int64),
    )
    exact = weights @ part
    best = np.sort(exact)[::-1]
    floor = int(best[min(k, n_docs) - 1]) * known // 2
    scores = np.zeros(n_docs, np.int64)
    rows = search.best_rows(np.arange(n_terms), weights, postings, scores, k, floor)
    wanted = np.flatnonzero((exact >= max(floor, 1)) & (exact >= best[min(k, n_docs) - 1]))
    assert set(wanted) <= set(rows.tolist())
    assert (scores[rows] == exact[rows]).all()


def test_random_texts_in_several_blocks_and_batches(spark, monkeypatch):
    monkeypatch.setattr(search, "BATCH_DOCS", 7)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    share = 1 / np.arange(1, 61)
    draw = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    docs = [(i, draw(rng.integers(0, 40)), 0, "x") for i in range(120)]
    docs += [(200 + i, docs[5][1], 0, "x") for i in range(30)]
    items = [(i, draw(rng.integers(0, 25)), 1) for i in range(9)]
    d, b = frames(spark, docs, items)
    expected = brute.ranked([r[:2] for r in docs], [r[:2] for r in items], 7)
    assert found(search.search(d.repartition(5), b, 7, entries=30)) == sorted(expected, key=str)


def test_odd_rows(spark, odd, nothing):
    text = "One two three four five six seven eight. " * 3
    items = [(1, "two TWO zzz"), (1, "two TWO zzz"), (None, text), (3, None), (4, ""), (5, "世界 É")]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(search.search(odd, b)) == sorted(brute.ranked(docs, items), key=str)
    assert search.search(nothing, b).count() == 0
    assert search.search(odd, b.limit(0)).count() == 0
    named = odd.selectExpr("'d' || doc_id AS doc_id", "text")
    assert search.search(named, b).schema["doc_id"].dataType.simpleString() == "string"
    assert search.search(named, b).count() == len(brute.ranked(docs, items))
