"""Every query against its oracle, and the driver contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from checks.compare import difference
from checks.oracle_queries import ORACLE
from trialbraid.catalog import QUERIES

# Queries of the optional subpackage have tests of their own.


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry_is_lazy_and_has_rows(spark):
    assert entry_module.entry(spark).columns == [
        "continent",
        "therapeutic_area",
        "area_trials",
        "local_pct",
        "global_pct",
        "specialization_index",
    ]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, sf_dir, name):
    assert difference(spark, con, QUERIES[name], ORACLE[name], sf_dir) is None
