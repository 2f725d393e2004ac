"""Question 5: how long completed trials take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialbraid import vocab
from trialbraid.functions import stats
from trialbraid.functions.stats import COUNT, tally
from trialbraid.operators.star import Star

_QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
_ROUNDED = [f"round({q}, 0) AS duration_{q}" for q in _QUARTILES]


def durations(studies: DataFrame) -> DataFrame:
    """(study_id, phase, duration_days) of trials with a usable duration."""
    usable = studies.filter(
        "status_group = 'Completed' AND NOT pre_covid_start AND NOT date_error"
    )
    return usable.selectExpr(
        "study_id", "phase", "datediff(completion_date, start_date) AS duration_days"
    ).filter("duration_days >= 0")


def _summary(histogram: DataFrame, key: str) -> DataFrame:
    summary = stats.quantiles(
        histogram,
        [key],
        "duration_days",
        "n",
        _QUARTILES,
        n_trials="sum(n)",
        duration_mean="sum(duration_days * n) / cast(sum(n) AS double)",
        duration_min="min(duration_days)",
        duration_max="max(duration_days)",
    )
    return summary.selectExpr(
        key,
        "n_trials",
        *_ROUNDED,
        "round(duration_mean, 0) AS duration_mean",
        "duration_min",
        "duration_max",
    )


def duration_by_phase(star: Star) -> DataFrame:
    """q5a: duration by phase."""
    known = durations(star.studies).filter(f"phase != '{vocab.UNKNOWN}'")
    histogram = tally(known, "phase", "duration_days", n=COUNT)
    return _summary(histogram, "phase").orderBy("duration_median", "phase")


def _area_histogram(star: Star, trials: DataFrame, *keys: str) -> DataFrame:
    """Histogram of durations by area and the other keys.

    Areas are one mask per study before the join, so both sides have one row
    per study and no key can be hot. Trials are counted by mask first; only
    the distinct combinations are spread over their areas.
    """
    masks = star.label_masks("areas")
    sets = tally(trials.join(masks, "study_id"), "mask", *keys, "duration_days", n=COUNT)
    area = f"explode({stats.labels_of('mask', vocab.AREAS)}) AS therapeutic_area"
    spread = sets.selectExpr(*keys, "duration_days", "n", area)
    return tally(spread, "therapeutic_area", *keys, "duration_days", n="sum(n)")


def duration_by_area(star: Star, min_trials: int = 10) -> DataFrame:
    """q5b: duration by therapeutic area."""
    histogram = _area_histogram(star, durations(star.studies))
    return (
        _summary(histogram, "therapeutic_area")
        .filter(f"n_trials >= {min_trials}")
        .orderBy(F.desc("duration_median"), "therapeutic_area")
    )


def duration_by_area_and_phase(star: Star) -> DataFrame:
    """q5c: duration by area and clinical phase."""
    clinical = durations(star.studies).filter(
        f"phase NOT IN ('{vocab.UNKNOWN}', 'Not Applicable')"
    )
    keys = ["therapeutic_area", "phase"]
    summary = stats.quantiles(
        _area_histogram(star, clinical, "phase"),
        keys,
        "duration_days",
        "n",
        _QUARTILES,
        n_trials="sum(n)",
    )
    return summary.selectExpr(*keys, "n_trials", *_ROUNDED).orderBy(*keys)


def pipeline_outliers(star: Star, threshold: float = 1.5, min_trials: int = 10) -> DataFrame:
    """KPI: phases that take much longer than the median of their area.

    Phase medians and area medians come out of one pass: every histogram row
    counts for its phase and for the NULL phase that stands for all of them.
    """
    keys = ["therapeutic_area", "phase"]
    histogram = _area_histogram(star, durations(star.studies), "phase").selectExpr(
        "therapeutic_area", "explode(array(phase, NULL)) AS phase", "duration_days", "n"
    )
    medians = stats.quantiles(
        tally(histogram, *keys, "duration_days", n="sum(n)"),
        keys,
        "duration_days",
        "n",
        {"median": 0.5},
        n_trials="sum(n)",
    ).selectExpr(*keys, "n_trials", "round(median, 0) AS phase_median")

    def of_area(value: str) -> str:
        return f"max(if(phase IS NULL, {value}, NULL)) OVER (PARTITION BY therapeutic_area)"

    compared = medians.selectExpr(
        "*", f"{of_area('phase_median')} AS area_median", f"{of_area('n_trials')} AS area_trials"
    ).filter(
        f"phase IS NOT NULL AND phase NOT IN ('{vocab.UNKNOWN}', 'Not Applicable') "
        f"AND area_trials >= {min_trials}"
    )
    ratio = "round(phase_median / nullif(area_median, 0.0D), 2)"
    return compared.drop("area_trials").selectExpr(
        "*", f"{ratio} AS ratio", f"{ratio} >= {threshold} AS longer_than_expected"
    )
