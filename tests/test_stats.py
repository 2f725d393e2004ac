"""Shares, quantiles and label sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trialbraid import vocab
from trialbraid.functions import stats
from trialbraid.functions.stats import COUNT, tally

PROBABILITIES = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9}


@settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.integers(-50, 50))),
        min_size=1,
        max_size=40,
    )
)
def test_quantiles_equal_numpy(spark, rows):
    df = spark.createDataFrame(rows, "k string, v int")
    result = stats.quantiles(
        tally(df, "k", "v", n=COUNT), ["k"], "v", "n", PROBABILITIES, n="sum(n)"
    )
    frame = pd.DataFrame(rows, columns=["k", "v"])
    for row in result.collect():
        group = frame[frame.k == row.k].v
        values = group.dropna().to_numpy(dtype=float)
        assert row.n == len(group)
        for name, p in PROBABILITIES.items():
            if len(values) == 0:
                assert row[name] is None
            else:
                assert row[name] == pytest.approx(np.quantile(values, p), abs=1e-9)


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.tuples(
            st.sampled_from("ab"),
            st.one_of(st.none(), st.floats(-1e12, 1e12), st.floats(0, 1e-9), st.integers(0, 9).map(float)),
        ),
        max_size=60,
    )
)
def test_spread_quantiles_equal_numpy(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    frame = pd.DataFrame(rows, columns=["k", "v"]).dropna()
    by_key = stats.spread_quantiles(tally(df, "k", "v", n=COUNT), ["k"], "v", "n", PROBABILITIES)
    groups = {r.k: (r, frame[frame.k == r.k].v.to_numpy(float)) for r in by_key.collect()}
    assert set(groups) == set(frame.k)
    (whole,) = stats.spread_quantiles(tally(df, "v", n=COUNT), [], "v", "n", PROBABILITIES).collect()
    for row, values in [*groups.values(), (whole, frame.v.to_numpy(float))]:
        for name, p in PROBABILITIES.items():
            expected = np.quantile(values, p) if len(values) else None
            assert row[name] == (expected if expected is None else pytest.approx(expected, rel=1e-9, abs=1e-12))


def test_values_spread_over_tasks(spark):
    """Only ranges are ordered together, never the values of a key."""
    df = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(100)], "v double, k string")
    plan = stats.spread_quantiles(tally(df, "k", "v", n=COUNT), ["k"], "v", "n", {"m": 0.5})
    text = plan._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert windows and all("range_" in line or "v#" not in line for line in windows)


def test_rounding_rules_differ_at_the_half(spark):
    row = spark.sql(
        f"SELECT {stats.pct('1', '16')} AS up, {stats.pct_half_even('1', '16')} AS even,"
        f" {stats.pct('23', '2000')} AS tie"
    ).first()
    # 6.25 is a tie: away from zero against to the even digit; 1.15 goes up.
    assert (row.up, row.even, row.tie) == (6.3, 6.2, 1.2)


def test_label_sets_round_trip(spark):
    df = spark.createDataFrame(
        [(i, a) for i, a in enumerate(vocab.AREAS)] + [(0, vocab.AREAS[3])], "id int, area string"
    )
    bits = df.selectExpr("id", f"{stats.label_bit('area', vocab.AREAS)} AS bit")
    sets = tally(bits, "id", mask="bit_or(bit)")
    labels = {
        r.id: r.labels
        for r in sets.selectExpr("id", f"{stats.labels_of('mask', vocab.AREAS)} AS labels").collect()
    }
    assert labels[0] == [vocab.AREAS[0], vocab.AREAS[3]]
    assert all(labels[i] == [vocab.AREAS[i]] for i in range(1, len(vocab.AREAS)))


def test_unknown_label_is_an_error(spark):
    df = spark.createDataFrame([("Atlantis",)], "area string")
    with pytest.raises(Exception, match="label outside the vocabulary"):
        df.selectExpr(f"{stats.label_bit('area', vocab.AREAS)} AS bit").collect()
