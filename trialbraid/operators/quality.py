"""Checks for a daily load: bounds, drift of missing shares, freshness."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialbraid import vocab
from trialbraid.functions import rules, stats, text
from trialbraid.operators.cleaning import extraction_date
from trialbraid.operators.profile import missing_profile


def bounds(flat: DataFrame) -> DataFrame:
    """Violations per rule on the raw columns, in one pass."""
    start, completion = (rules.parse_date(f"`{c} Date`") for c in ("Start", "Completion"))
    number = rules.enrollment_number("Enrollment")
    cutoff = rules.cutoff_after(rules.date_literal(vocab.EXTRACTION_DATE))
    checks = {
        "nct_number_missing": "`NCT Number` IS NULL",
        "status_not_known": f"NOT {text.is_in('Status', vocab.KNOWN_STATUSES)}",
        "enrollment_not_a_number": f"Enrollment IS NOT NULL AND {number} IS NULL",
        "enrollment_negative": f"{number} < 0",
        "start_date_not_a_date": f"`Start Date` IS NOT NULL AND {start} IS NULL",
        "start_date_out_of_range": rules.starts_before(start, vocab.DATE_ERROR_BEFORE),
        "completion_date_out_of_range": f"{completion} > {cutoff}",
        "completion_before_start": f"{completion} < {start}",
    }
    counts = flat.agg(
        F.count("*").alias("n_rows"),
        *[F.expr(f"count_if({c})").alias(k) for k, c in checks.items()],
    )
    rows = counts.unpivot("n_rows", list(checks), "rule", "violations")
    share = stats.pct_half_even("violations", "n_rows")
    return rows.selectExpr("rule", "violations", f"{share} AS pct")


def null_drift(previous: DataFrame, current: DataFrame, limit_points: float = 5.0) -> DataFrame:
    """Missing share per column against an earlier load."""
    before, now = (
        missing_profile(load).select("column_name", F.col("missing_pct").alias(name))
        for load, name in ((previous, "previous_pct"), (current, "current_pct"))
    )
    change = F.round(F.col("current_pct") - F.col("previous_pct"), 1)
    return (
        before.join(now, "column_name")
        .withColumn("change_points", change)
        .withColumn("alert", F.col("change_points") > limit_points)
    )


def load_drift(profiles: DataFrame, limit_points: float = 5.0) -> DataFrame:
    """Missing share per column of every load against the load before it.

    ``profiles`` (number, table_name, column_name, n_rows, missing) has one row per
    load and column, so no row of a load is read. A column that its table has
    had in no earlier load has no previous share and no alert; a load without
    rows has a share of 0.
    """
    share = "coalesce(bround(100.0D * missing / nullif(n_rows, 0), 1), 0D)"
    column = Window.partitionBy("table_name", "column_name").orderBy("number")
    rows = profiles.withColumn("missing_pct", F.expr(share))
    rows = rows.withColumn("previous_pct", F.lag("missing_pct").over(column))
    change = F.round(F.col("missing_pct") - F.col("previous_pct"), 1)
    return rows.withColumn("change_points", change).withColumn(
        "alert", F.coalesce(F.abs("change_points") > limit_points, F.lit(False))
    )


def freshness(flat: DataFrame, today: dt.date, max_age_days: int = 1) -> DataFrame:
    """Newest update and whether it is older than the expected cadence."""
    newest = extraction_date(flat).select(F.col("extraction_date").alias("newest_update"))
    age = F.datediff(F.lit(today), F.col("newest_update"))
    return newest.withColumn("age_days", age).withColumn(
        "late", F.coalesce(F.col("age_days") > max_age_days, F.lit(True))
    )
