"""Physical plans: what must hold at any scale."""

from __future__ import annotations

import re

import pytest

from trialbraid.catalog import QUERIES, clean, raw, star
from trialbraid.operators import profile
from trialbraid.sources import files

WRITES = {
    "scan_raw_csv", "scan_multiline_csv", "rejected_csv", "scan_clean_csv", "sink_clean_flat",
    "sink_tables", "reset_tables", "dq_load_drift", "q4b_merged_loads",
}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for operator in ("CartesianProduct", "NestedLoopJoin", "Python", "CollectLimit"):
        assert operator not in plan


def test_only_needed_columns_are_read(spark, sf_dir):
    """The phase follows from the key; status and price decide whether a row is accepted."""
    plan = plan_of(QUERIES["q1a_phase_distribution"](spark, sf_dir))
    (read,) = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert set(read.split(",")) == {"o_orderkey:bigint", "o_orderstatus:string", "o_totalprice:double"}


def test_cleaning_needs_no_shuffle(spark, sf_dir):
    assert "Exchange" not in plan_of(clean(spark, sf_dir))


@pytest.mark.parametrize("multi_line", [True, False])
def test_csv_records_need_no_shuffle_and_are_parsed_once(spark, tmp_path, multi_line):
    (tmp_path / "a.csv").write_text("k,t\n" + '1,"x"\n' * 9)
    plan = plan_of(files.scan_csv(spark, str(tmp_path), multi_line).select("t"))
    assert "Exchange" not in plan and "Window" not in plan
    # One scan of the text; the records that cross splits are a table of their own.
    assert plan.count("FileScan text") == 1 and plan.count("from_csv") == 1 + multi_line


def without_broadcast(spark, sf_dir, name) -> str:
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return plan_of(QUERIES[name](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_studies_are_shuffled_once_by_the_join_key(spark, sf_dir):
    plan = without_broadcast(spark, sf_dir, "q5b_duration_by_area")
    below = plan[plan.index("SortMergeJoin") :]
    assert "partial_min_by" in below and "Window" not in below
    # One for the studies and one for the label sets of the children.
    assert len(re.findall(r"Exchange hashpartitioning\(study_id", below)) == 2


@pytest.mark.parametrize("name", ["q2b_completion_by_sponsor", "q2c_completion_by_design"])
def test_children_are_counted_before_the_join(spark, sf_dir, name):
    plan = without_broadcast(spark, sf_dir, name)
    below = plan[plan.index("SortMergeJoin") :]
    assert re.search(r"keys=\[study_id#\d+L, \w+#\d+.*functions=\[partial_count\(1\)", below)


@pytest.mark.parametrize("name", ["q1c_area_distribution", "q4b_specialization_index"])
def test_studies_are_only_counted_for_a_total(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    total = text[text.index("scalar-subquery") :]
    assert "min_by" not in total and "count(distinct" in total


def test_examples_are_limited_before_the_shuffle(spark, sf_dir):
    assert re.search(r"WindowGroupLimit .*Partial", plan_of(profile.location_part_counts(raw(spark, sf_dir))))


def test_area_labels_shuffle_keys_and_bits_only(spark, sf_dir):
    """The join of questions 5 has one row per study on both sides."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES["q5b_duration_by_area"](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan
    assert re.search(r"keys=\[study_id#\d+L\], functions=\[partial_bit_or", plan)


def test_window_over_everything_only_sees_aggregates(spark, sf_dir):
    for name in ("q1a_phase_distribution", "q1b_status_distribution", "q4a_continent_counts"):
        plan = plan_of(QUERIES[name](spark, sf_dir))
        above = plan[: plan.index("Exchange SinglePartition")]
        below = plan[plan.index("Exchange SinglePartition") :]
        assert "FileScan" not in above and "HashAggregate" in below


@pytest.mark.parametrize(
    # The types without any number are a second question to the source.
    ("name", "scans"), [("enrollment_describe", 1), ("enrollment_by_study_type", 2)]
)
def test_enrollment_reports_build_one_histogram(spark, sf_dir, name, scans):
    df = QUERIES[name](spark, sf_dir)
    df.collect()
    plan = plan_of(df)
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert final.count("FileScan") == scans and "ReusedExchange" in final
