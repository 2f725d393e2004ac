"""Chart data: reshaping of question results.

The inputs are results of the questions, a few rows to a few hundred; every
function stays a lazy DataFrame so that it ends up in the same plan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialbraid import vocab
from trialbraid.functions import text


def ordinal(spark: SparkSession, values: Sequence[str], column: str) -> DataFrame:
    """(column, position): a fixed order as a tiny frame."""
    rows = ", ".join(f"({text.quote(v)}, {i})" for i, v in enumerate(values))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS fixed_order({column}, position)")


def position_in(c: str, values: Sequence[str]) -> Column:
    """0-based position in a fixed order; NULL outside of it."""
    return F.expr(f"nullif(array_position(array({text.word_list(values)}), {c}), 0) - 1")


# --- Question 1 ---------------------------------------------------------------
def group_rollup(status_distribution: DataFrame) -> DataFrame:
    """Status counts re-summed per group, largest first, and the grand total last."""
    sums = status_distribution.rollup("status_group").agg(F.sum("status_count").alias("n"))
    return sums.orderBy(F.col("status_group").isNull(), F.desc("n"), "status_group")


def main_window(timeline: DataFrame, last_month: dt.date = vocab.MAIN_WINDOW_END) -> DataFrame:
    """Months of the main period, one row per month and status series."""
    series = ["completed", "active", "stopped"]
    months = timeline.filter(F.col("month") <= F.lit(last_month)).withColumn(
        "month_label", F.date_format("month", "MMM yyyy")
    )
    long = months.unpivot(
        ["month", "month_label", "cumulative_total"], series, "series", "trials_started"
    )
    return (
        long.withColumn("series_no", position_in("series", series) + 1)
        .orderBy("month", "series_no")
    )


# --- Question 2 ---------------------------------------------------------------
def in_phase_order(completion: DataFrame) -> DataFrame:
    """Rows in clinical order; a phase without trials is a row of NULLs."""
    order = ordinal(completion.sparkSession, vocab.PHASE_ORDER, "phase")
    return order.join(completion, "phase", "left").orderBy("position", "study_type")


def phase_risk_band(completion: DataFrame) -> DataFrame:
    rate = F.col("completion_rate_pct")
    band = F.when(rate < 60, "High Risk").when(rate < 75, "Moderate Risk").otherwise("Low Risk")
    return completion.select(
        "phase", "study_type", "total_resolved", "completion_rate_pct", band.alias("risk_band")
    )


def design_risk_band(design: DataFrame) -> DataFrame:
    """Bands at 80 / 70 for the allocation and at 75 / 65 for the other features."""
    rate = F.col("completion_rate_pct")
    is_allocation = F.col("design_feature") == "Allocation"
    low, moderate = F.when(is_allocation, 80).otherwise(75), F.when(is_allocation, 70).otherwise(65)
    band = (
        F.when(rate >= low, "Low Risk").when(rate >= moderate, "Moderate Risk").otherwise("High Risk")
    )
    return design.withColumn("risk_band", band)


def masking_labels(design: DataFrame, min_trials: int = 10) -> DataFrame:
    """Masking levels with enough trials, labelled without the parentheses."""
    label = F.expr(text.strip(r"regexp_replace(feature_value, '\\(.*?\\)', '')"))
    return (
        design.filter(
            (F.col("design_feature") == "Masking") & (F.col("total_resolved") >= min_trials)
        )
        .select("feature_value", label.alias("display_label"), "total_resolved", "completion_rate_pct")
        .orderBy("completion_rate_pct", "feature_value")
    )


def stopped_matrix(stopped: DataFrame) -> DataFrame:
    """Status by phase matrix in fixed row and column order, 0 where empty."""
    cells = (
        stopped.groupBy("status").pivot("phase", vocab.PHASE_ORDER).agg(F.first("n_trials"))
    )
    rows = ordinal(stopped.sparkSession, vocab.STOPPED_STATUS_ORDER, "status")
    return (
        rows.join(cells, "status", "left")
        .fillna(0, vocab.PHASE_ORDER)
        .orderBy("position")
        .select("status", *[F.col(p).alias(column_label(p)) for p in vocab.PHASE_ORDER])
    )


def failure_summary(stopped: DataFrame) -> DataFrame:
    return (
        stopped.groupBy("status").agg(F.sum("n_trials").alias("total_trials")).orderBy("status")
    )


# --- Question 3 ---------------------------------------------------------------
def iqr_spread(result: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    """Distances from the median to the quartiles, smallest median first."""
    q1, median, q3 = (F.col(f"{prefix}_{q}") for q in ("q1", "median", "q3"))
    return result.select(
        *keys,
        "n_trials",
        median.alias("median"),
        (median - q1).alias("spread_down"),
        (q3 - median).alias("spread_up"),
    ).orderBy("median", *keys)


def enrollment_top8(top_conditions: DataFrame, top: int = 8) -> DataFrame:
    """Largest conditions with a short label: ``118.7M`` or ``500K``."""
    total = F.col("total_enrollment")

    def short(divisor: float, digits: int, unit: str):
        """Rounds the binary value, as printing a float does: 1.15 is below the half."""
        return F.concat(F.replace(F.format_number(total / F.lit(divisor), digits), F.lit(",")), F.lit(unit))

    label = F.when(total >= 1_000_000, short(1e6, 1, "M")).otherwise(short(1e3, 0, "K"))
    best = top_conditions.orderBy(F.desc("total_enrollment"), "condition_name").limit(top)
    return best.select("condition_name", "n_trials", "total_enrollment", label.alias("label"))


def log_weight(top_conditions: DataFrame) -> DataFrame:
    """log10 of the total enrollment per condition."""
    return top_conditions.select(
        "condition_name", F.round(F.log10("total_enrollment"), 6).alias("weight")
    )


# --- Question 4 ---------------------------------------------------------------
def top_continents(continents: DataFrame, top: int = 5) -> DataFrame:
    return continents.orderBy(F.desc("trial_count"), "continent").limit(top)


def specialization_heatmap(
    index: DataFrame, continents: DataFrame, top: int = 10
) -> DataFrame:
    """Continent by area matrix of the index for the largest continents."""
    largest = top_continents(continents, top).select("continent")
    areas = sorted(vocab.AREAS)
    cells = (
        index.join(largest, "continent", "left_semi")
        .groupBy("continent")
        .pivot("therapeutic_area", areas)
        .agg(F.first("specialization_index"))
    )
    return (
        cells.fillna(0.0, areas)
        .select("continent", *[F.col(f"`{a}`").alias(column_label(a)) for a in areas])
        .orderBy("continent")
    )


# --- Question 5 ---------------------------------------------------------------
def label_with_count(name: str) -> Column:
    return F.format_string("%s (n=%d)", F.col(name), F.col("n_trials"))


def duration_phase_chart(by_phase: DataFrame) -> DataFrame:
    """Clinical phases, last phase first, with label and quartile distances."""
    clinical = by_phase.filter(F.col("phase").isin(vocab.CLINICAL_PHASES)).withColumn(
        "position", position_in("phase", vocab.CLINICAL_PHASES)
    )
    return clinical.select(
        label_with_count("phase").alias("y_label"),
        "position",
        F.col("duration_median").alias("median"),
        (F.col("duration_median") - F.col("duration_q1")).alias("spread_down"),
        (F.col("duration_q3") - F.col("duration_median")).alias("spread_up"),
    ).orderBy(F.desc("position"))


def duration_area_chart(by_area: DataFrame) -> DataFrame:
    """Areas, shortest median first, with label and quartile distances."""
    return by_area.select(
        label_with_count("therapeutic_area").alias("y_label"),
        F.col("duration_median").alias("median"),
        (F.col("duration_median") - F.col("duration_q1")).alias("spread_down"),
        (F.col("duration_q3") - F.col("duration_median")).alias("spread_up"),
    ).orderBy("median", "y_label")


def duration_facets(by_area_and_phase: DataFrame) -> DataFrame:
    """Area facets with their phases in clinical order."""
    position = position_in("phase", vocab.CLINICAL_PHASES)
    return by_area_and_phase.withColumn("position", position).orderBy(
        "therapeutic_area", F.asc_nulls_last("position")
    )


def column_label(value: str) -> str:
    """A value as a plain column name."""
    return "".join(ch.lower() if ch.isalnum() else "_" for ch in value)
