"""Question 3: how many participants trials enroll, and for what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialbraid import vocab
from trialbraid.functions import stats
from trialbraid.functions.stats import COUNT, tally
from trialbraid.operators.star import Star


def enrollment_distribution(star: Star) -> DataFrame:
    """q3a: quartiles and maximum of the enrollment by study type and phase."""
    keys = ["study_type", "phase"]
    enrolled = star.studies.filter(f"enrollment > 0 AND phase != '{vocab.UNKNOWN}'")
    quartiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    summary = stats.quantiles(
        tally(enrolled, *keys, "enrollment", n=COUNT),
        keys,
        "enrollment",
        "n",
        quartiles,
        n_trials="sum(n)",
        enrollment_max="max(enrollment)",
    )
    return summary.selectExpr(
        *keys,
        "n_trials",
        *[f"round({q}, 0) AS enrollment_{q}" for q in quartiles],
        "enrollment_max",
    ).orderBy(F.asc_nulls_last("study_type"), "phase")


def top_conditions(star: Star, top: int = 20) -> DataFrame:
    """q3b: conditions by total enrollment.

    A study listing the same condition twice is summed twice and counted once.
    Conditions are counted per study before the join, so neither a study
    repeated in the source nor the dominant condition makes a large group; the
    rank is taken on the top rows, where it equals the rank among all.
    """
    keys = ["condition_name", "therapeutic_area"]
    listed = tally(star.conditions, "study_id", *keys, times=COUNT)
    enrolled = star.studies.filter("enrollment > 0").select("study_id", "enrollment")
    histogram = tally(
        enrolled.join(listed, "study_id"), *keys, "enrollment", trials=COUNT, n="sum(times)"
    )
    summary = stats.quantiles(
        histogram,
        keys,
        "enrollment",
        "n",
        {"median": 0.5},
        n_trials="sum(trials)",
        total_enrollment="sum(enrollment * n)",
    )
    best = summary.orderBy(F.desc("total_enrollment"), *keys).limit(top)
    return best.selectExpr(
        *keys,
        "n_trials",
        "total_enrollment",
        "round(median, 0) AS median_enrollment_per_trial",
        "cast(rank() OVER (ORDER BY total_enrollment DESC) AS bigint) AS enrollment_rank",
    ).orderBy("enrollment_rank", *keys)
