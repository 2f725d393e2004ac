"""Question 2: what goes with completion, and how stopped trials look."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialbraid import vocab
from trialbraid.functions import rules, stats
from trialbraid.functions.stats import COUNT, tally
from trialbraid.functions.text import is_in
from trialbraid.operators.star import Star

_DESIGN_FEATURES = {
    "Allocation": "allocation",
    "Intervention Model": "intervention_model",
    "Masking": "masking",
}
_COMPLETED = "count_if(status_group = 'Completed')"
_TIMES_COMPLETED = "sum(if(status_group = 'Completed', times, 0))"
_RATE = f"{stats.pct('completed', 'total_resolved')} AS completion_rate_pct"


def resolved(studies: DataFrame) -> DataFrame:
    """Trials that have reached an outcome."""
    return studies.filter(is_in("status_group", vocab.RESOLVED_GROUPS))


def _with_outcome(star: Star, weighted: DataFrame) -> DataFrame:
    """Weighted children of resolved trials.

    The children are counted per study and class before the join, so a study
    registered millions of times arrives there as a few rows.
    """
    return resolved(star.studies).select("study_id", "status_group").join(weighted, "study_id")


def completion_by_phase(star: Star) -> DataFrame:
    """q2a: completion rate and median enrollment by phase and study type."""
    keys = ["phase", "study_type"]
    known = resolved(star.studies).filter(f"phase != '{vocab.UNKNOWN}'")
    histogram = tally(known, *keys, "enrollment", n=COUNT, n_completed=_COMPLETED)
    summary = stats.quantiles(
        histogram,
        keys,
        "enrollment",
        "n",
        {"median": 0.5},
        total_resolved="sum(n)",
        completed="sum(n_completed)",
        stopped="sum(n - n_completed)",
    )
    return summary.selectExpr(
        *keys,
        "total_resolved",
        "completed",
        "stopped",
        _RATE,
        "round(median, 0) AS median_enrollment",
    ).orderBy(F.desc("completion_rate_pct"), "phase", F.asc_nulls_last("study_type"))


def completion_by_sponsor(star: Star) -> DataFrame:
    """q2b: completion rate by the class of the lead sponsor."""
    leads = star.sponsors.filter("lead_or_collaborator = 'Lead'")
    joined = _with_outcome(star, tally(leads, "study_id", "agency_class", times=COUNT))
    counts = tally(
        joined,
        "agency_class",
        total_resolved="sum(times)",
        completed=_TIMES_COMPLETED,
        stopped="sum(if(status_group = 'Stopped', times, 0))",
    )
    return counts.selectExpr("*", _RATE).orderBy(
        F.desc("completion_rate_pct"), F.asc_nulls_last("agency_class")
    )


def completion_by_design(star: Star) -> DataFrame:
    """q2c: completion rate by allocation, model and masking, stacked.

    The three features are counted together in one pass; the stacking then
    works on the few combinations instead of reading the trials three times.
    """
    features = list(_DESIGN_FEATURES.values())
    joined = _with_outcome(star, tally(star.study_design, "study_id", *features, times=COUNT))
    combos = tally(joined, *features, n="sum(times)", n_completed=_TIMES_COMPLETED)
    long = (
        combos.withColumnsRenamed({c: name for name, c in _DESIGN_FEATURES.items()})
        .unpivot(["n", "n_completed"], list(_DESIGN_FEATURES), "design_feature", "feature_value")
        .filter("feature_value IS NOT NULL")
    )
    counts = tally(
        long,
        "design_feature",
        "feature_value",
        total_resolved="sum(n)",
        completed="sum(n_completed)",
    )
    return counts.selectExpr("*", _RATE).orderBy(
        "design_feature", F.desc("completion_rate_pct"), "feature_value"
    )


def stopped_deep_dive(star: Star) -> DataFrame:
    """q2d: stopped trials by status and phase, ranked within the status.

    Both medians come out of one pass: the two measures are stacked, reduced
    to one histogram and spread out again.
    """
    keys = ["status", "phase"]
    stopped = star.studies.filter(
        f"status_group = 'Stopped' AND phase != '{vocab.UNKNOWN}'"
    ).selectExpr(
        *keys, "enrollment", f"{rules.age_days('completion_date', 'start_date')} AS duration_days"
    )
    long = stopped.unpivot(keys, ["enrollment", "duration_days"], "measure", "value")
    medians = stats.quantiles(
        tally(long, *keys, "measure", "value", n=COUNT),
        [*keys, "measure"],
        "value",
        "n",
        {"median": 0.5},
        n_trials="sum(n)",
    )
    summary = tally(
        medians,
        *keys,
        n_trials="max(n_trials)",
        median_enrollment="round(max(if(measure = 'enrollment', median, NULL)), 0)",
        median_duration_days="round(max(if(measure = 'duration_days', median, NULL)), 0)",
    )
    rank = "cast(rank() OVER (PARTITION BY status ORDER BY n_trials DESC) AS bigint)"
    return summary.selectExpr("*", f"{rank} AS rank_within_status").orderBy(
        "status", "rank_within_status", "phase"
    )


def resolved_rate(star: Star) -> DataFrame:
    """KPI: completed share of all trials that reached an outcome."""
    counts = resolved(star.studies).agg(
        F.expr(_COMPLETED).alias("completed"), F.count("*").alias("total_resolved")
    )
    rate = stats.pct("completed", "nullif(total_resolved, 0)")
    return counts.selectExpr("*", f"{rate} AS completion_rate_pct")
