"""Conversation repair against a plain dynamic program, in every cut of chunks and tasks."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from trialbraid.llm import turns
from trialbraid.llm.catalog import LLM_QUERIES, damaged

COLUMNS = "conv_id bigint, turn bigint, role string, text string"
RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def expected(rows, convs=()):
    """Results by conversation of undamaged (conv, turn, role, text) rows without ties in a turn."""
    by = defaultdict(list, {c: [] for c in convs})
    for conv, turn, role, text in rows:
        by[conv].append((turn, role, text))
    order = lambda r: (r[0] is not None, r[0])
    return {c: brute.repair(sorted(rs, key=order)) for c, rs in by.items()}


def found(df):
    return {r.conv_id: tuple(r[c] for c in RESULT) for r in df.collect()}


def same(df, rows, convs=()):
    got, wanted = found(df), expected(rows, convs)
    assert got == {c: w[:8] for c, w in wanted.items()}


def test_query_equals_plain_version(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    out = LLM_QUERIES["op11_structure_repair"](spark, sf_dir)
    assert out.columns == ["conv_id", *RESULT]
    same(out, brute.damage(rows), {r[0] for r in rows})


ROWS = st.lists(
    st.tuples(
        st.sampled_from(["system", "user", "assistant", "tool", "", " "]),
        st.sampled_from(["a.", "b!", "c", "d?", "", " \t", "e", "f."]),
    ),
    max_size=17,
)


@settings(max_examples=400, deadline=None)
@given(ROWS)
def test_block_tables_equal_plain_program(rows):
    chunk = turns._Chunk(1, 0, False)
    for i, (role, text) in enumerate(rows):
        chunk.add(i, role, text)
    got = chunk.result(True)
    wanted = brute.repair([(i, r, t) for i, (r, t) in enumerate(rows)])
    assert tuple(got[c] for c in RESULT) == wanted[:8]
    assert [(r["role"], r["text"]) for r in got["repaired"]] == wanted[8]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=23))
def test_function_of_rows_is_their_trace_for_every_vector(symbols):
    t = turns.tables()
    vector, cost, leave = t.function(np.array(symbols, np.int64))
    for v in range(len(t.vectors)):
        for q in range(4):
            _, state, before, total = t.trace(np.array(symbols, np.int64), v, q)
            assert (before, total, state) == (vector[v], cost[v], leave[v][q])


@pytest.mark.parametrize("rows_of_a_chunk", [1, 3, 50])
def test_conversations_across_chunks_and_tasks(spark, monkeypatch, rows_of_a_chunk):
    monkeypatch.setattr(turns, "CHUNK_ROWS", rows_of_a_chunk)
    rng = np.random.default_rng(rows_of_a_chunk)
    texts = ["a.", "b!", "c", "", "yes.", "no"] + [f"t{i}." for i in range(60)]
    rows = []
    for conv, n in enumerate([300, 1, 2, 45, 7, 130, 3, 9]):
        for turn in rng.permutation(np.arange(n) * rng.integers(1, 3) + rng.integers(0, 2)):
            role = str(rng.choice(["system", "user", "assistant", "tool"], p=[0.1, 0.4, 0.4, 0.1]))
            rows.append((conv, int(turn), role, str(rng.choice(texts))))
    df = spark.createDataFrame(rows, COLUMNS).repartition(6)
    same(turns.repair(df), rows)


def test_one_row_in_a_third_of_all_rows(spark, monkeypatch):
    """Equal rows of one turn are dealt over tasks; all but one are repeated rows."""
    monkeypatch.setattr(turns, "CHUNK_ROWS", 20)
    rows = [(1, 5, "user", "same.")] * 200 + [(1, t, "assistant", f"x{t}.") for t in range(6, 40)]
    rows += [(c, 0, "user", "hello.") for c in range(2, 200)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(8)
    same(turns.repair(df), rows)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "a."), (None, 1, "user", "a."),
        (1, None, "user", "b."), (1, 3, "assistant", None), (1, 9, None, "c."),
        (2, 1, "system", "x" * 100_000), (3, 4, "", "é世界。"), (4, 2, "user", "\x00?"),
    ]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], COLUMNS + ", audit string, cost int")
    clean = [(c, t, r or (" " if r is None else r), " " if x is None else x) for c, t, r, x in rows]
    same(turns.repair(df), clean)
    got = {r.conv_id: r.repaired for r in turns.repair(df, with_rows=True).collect()}
    assert {c: [tuple(x) for x in v] for c, v in got.items()} == {
        c: w[8] for c, w in expected(clean).items()
    }
    none = spark.createDataFrame([], COLUMNS)
    assert turns.repair(none).count() == 0 and damaged(none).count() == 0
    gone = df.selectExpr("conv_id", "turn", "role", "text", "true AS absent")
    empty = (0, 0, 0, 0, 0, 0, "", brute.sha(""))
    assert found(turns.repair(gone)) == {c: empty for c in (None, 1, 2, 3, 4)}
    named = df.selectExpr("'k' || conv_id AS conv_id", "turn", "role", "text")
    assert turns.repair(named).count() == 5
