"""Question 1: how trials spread over phases, statuses, areas and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialbraid import vocab
from trialbraid.functions import stats
from trialbraid.functions.stats import COUNT, tally
from trialbraid.operators.star import Star


def phase_distribution(star: Star) -> DataFrame:
    """q1a: trials per phase and share of all."""
    counts = tally(star.studies, "phase", trial_count=COUNT)
    share = stats.pct("trial_count", stats.grand_total("trial_count"))
    return counts.selectExpr("*", f"{share} AS pct").orderBy(F.desc("trial_count"), "phase")


def status_distribution(star: Star) -> DataFrame:
    """q1b: statuses within their group.

    One aggregate by (group, status); the group and overall totals are windows
    over its few rows, so the studies are read once.
    """
    counts = tally(star.studies, "status_group", "status", status_count=COUNT)
    grouped = counts.selectExpr(
        "*", "sum(status_count) OVER (PARTITION BY status_group) AS group_count"
    )
    overall = stats.grand_total("status_count")
    return grouped.selectExpr(
        "*",
        f"{stats.pct('status_count', 'group_count')} AS pct_within_group",
        f"{stats.pct('status_count', overall)} AS pct_overall",
    ).orderBy(F.desc("group_count"), F.desc("status_count"), "status")


def area_distribution(star: Star) -> DataFrame:
    """q1c: distinct trials per area; a trial counts once in each of its areas."""
    counts = trials_per_label(star.label_masks("areas"), "therapeutic_area", vocab.AREAS)
    total = star.n_studies().scalar()
    return (
        counts.withColumn("total", total)
        .selectExpr(
            "therapeutic_area",
            "trial_count",
            f"{stats.pct('trial_count', 'total')} AS pct_of_all_studies",
        )
        .orderBy(F.desc("trial_count"), "therapeutic_area")
    )


def monthly_timeline(star: Star) -> DataFrame:
    """q1d: trials started per month, by group, with a running total."""
    started = star.studies.filter("NOT pre_covid_start AND start_date IS NOT NULL").selectExpr(
        "trunc(start_date, 'month') AS month", "status_group"
    )
    monthly = tally(
        started,
        "month",
        total_started=COUNT,
        active="count_if(status_group = 'Active')",
        completed="count_if(status_group = 'Completed')",
        stopped="count_if(status_group = 'Stopped')",
    )
    # Ordered over months, of which there are few whatever the number of trials.
    return monthly.selectExpr(
        "*", "sum(total_started) OVER (ORDER BY month) AS cumulative_total"
    ).orderBy("month")


def trials_per_label(labels: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """(label, trial_count): studies are counted by label set, then spread out."""
    sets = tally(labels, "mask", n=COUNT)
    spread = sets.selectExpr("n", f"explode({stats.labels_of('mask', vocabulary)}) AS {column}")
    return tally(spread, column, trial_count="sum(n)")
