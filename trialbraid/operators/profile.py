"""Profiling reports over the flat file.

Reports count values before they classify them: the expensive rules then run
once per distinct value, after the map-side combine, not once per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialbraid import vocab
from trialbraid.functions import rules, stats, text
from trialbraid.functions.stats import COUNT, tally
from trialbraid.operators import cleaning
from trialbraid.schema import INGEST_POS


# --- Missing values and value counts -----------------------------------------
def missing_profile(flat: DataFrame, columns: list[str] = vocab.CRITICAL_COLUMNS) -> DataFrame:
    """Missing count and share per column, most incomplete first."""
    counts = flat.agg(
        F.count("*").alias("n_rows"),
        *[F.expr(f"count_if({text.name(c)} IS NULL)").alias(c) for c in columns],
    )
    rows = counts.unpivot("n_rows", columns, "column_name", "missing_count")
    return rows.selectExpr(
        "column_name",
        "missing_count",
        f"{stats.pct_half_even('missing_count', 'n_rows')} AS missing_pct",
    ).orderBy(F.desc("missing_pct"), "column_name")


def missing_severity(missing: DataFrame) -> DataFrame:
    """High above 20 %, medium above 5 %, else low."""
    band = "CASE WHEN missing_pct > 20 THEN 'high' WHEN missing_pct > 5 THEN 'medium' ELSE 'low' END"
    return missing.selectExpr("column_name", "missing_pct", f"{band} AS severity")


def value_counts(flat: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per value and column; a missing value is a value of its own.

    The columns are counted together first, so the unpivot multiplies the few
    distinct combinations and not the rows.
    """
    long = tally(flat, *columns, n=COUNT).unpivot("n", columns, "column_name", "value")
    return tally(long, "column_name", "value", n="sum(n)").orderBy(
        "column_name", F.desc("n"), F.asc_nulls_last("value")
    )


def status_group_share(flat: DataFrame) -> DataFrame:
    counts = tally(flat, "status_group", n=COUNT)
    share = stats.pct("n", stats.grand_total("n"))
    return counts.selectExpr("*", f"{share} AS pct").orderBy(F.desc("n"), "status_group")


# --- Enrollment ---------------------------------------------------------------
def enrollment_describe(flat: DataFrame) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of the enrollment.

    One row always; without any value the count is 0 and the rest NULL.
    """
    values = cleaning.with_enrollment_number(flat).filter("Enrollment IS NOT NULL")
    summary = stats.spread_summary(
        tally(values, "Enrollment", n=COUNT),
        [],
        "Enrollment",
        "n",
        {"q1": 0.25, "median": 0.5, "q3": 0.75},
    )
    return summary.selectExpr(
        "n_values", *[f"round({c}, 6) AS {c}" for c in ("mean", "stddev")], "min", "q1", "median", "q3", "max"
    )


def enrollment_flags(flat: DataFrame) -> DataFrame:
    return cleaning.with_enrollment_number(flat).selectExpr(
        "count_if(Enrollment IS NULL) AS missing",
        "count_if(Enrollment = 0) AS zero",
        f"count_if(Enrollment > {vocab.LARGE_ENROLLMENT}) AS over_100k",
    )


def zero_enrollment_by_status(flat: DataFrame) -> DataFrame:
    zero = cleaning.with_enrollment_number(flat).filter("Enrollment = 0")
    return tally(zero.withColumnRenamed("Status", "status"), "status", n=COUNT).orderBy(
        F.desc("n"), "status"
    )


def enrollment_by_study_type(flat: DataFrame) -> DataFrame:
    """Median, mean and maximum per study type, rounded half to even."""
    typed = (
        cleaning.with_enrollment_number(flat)
        .withColumnRenamed("Study Type", "study_type")
        .filter("study_type IS NOT NULL")
    )
    histogram = tally(typed, "study_type", "Enrollment", n=COUNT)
    summary = stats.spread_summary(histogram, ["study_type"], "Enrollment", "n", {"median": 0.5})
    # Types without any number have a row of their own.
    types = histogram.select("study_type").distinct()
    return types.join(summary, "study_type", "left").selectExpr(
        "study_type", *[f"bround({c}, 0) AS {c}" for c in ("median", "mean", "max")]
    )


def expanded_access_profile(flat: DataFrame) -> DataFrame:
    counts = flat.selectExpr(
        "count(*) AS n_rows",
        f"count_if({rules.is_expanded_access('`Study Type`')}) AS n_expanded",
    )
    share = stats.pct_half_even("n_expanded", "n_rows")
    return counts.selectExpr("*", f"{share} AS pct_expanded")


# --- Dates ----------------------------------------------------------------------
def date_range_profile(raw: DataFrame) -> DataFrame:
    """Valid, missing, earliest and latest per date column, before and after cleaning."""
    flat = cleaning.drop_expanded_access(raw)
    columns = vocab.STUDY_DATE_COLUMNS
    parsed = cleaning.parse_dates(flat, columns)
    cutoff = cleaning.data_cutoff(flat)
    versions = {
        c: {
            "before": text.name(c),
            "after": rules.keep_until(text.name(c), "cutoff")
            if c in cleaning.PLACEHOLDER_COLUMNS
            else text.name(c),
        }
        for c in columns
    }
    wide = parsed.withColumn("cutoff", cutoff).agg(
        F.count("*").alias("n_rows"),
        *[
            F.expr(f"{call}({value})").alias(f"{call}|{c}|{stage}")
            for c, stages in versions.items()
            for stage, value in stages.items()
            for call in ("count", "min", "max")
        ],
    )
    rows = [
        F.struct(
            F.lit(stage).alias("stage"),
            F.lit(c).alias("column_name"),
            F.col(f"count|{c}|{stage}").alias("valid"),
            (F.col("n_rows") - F.col(f"count|{c}|{stage}")).alias("missing"),
            F.col(f"min|{c}|{stage}").alias("min_date"),
            F.col(f"max|{c}|{stage}").alias("max_date"),
        )
        for c in columns
        for stage in ("before", "after")
    ]
    return wide.select(F.inline(F.array(*rows)))


def date_issue_counts(raw: DataFrame) -> DataFrame:
    """Dates beyond the cutoff, starts before 2020 and before 2000."""
    flat = cleaning.drop_expanded_access(raw)
    parsed = cleaning.parse_dates(flat, vocab.STUDY_DATE_COLUMNS)
    parsed = parsed.withColumn("cutoff", cleaning.data_cutoff(flat))
    issues = {
        "completion_after_cutoff": "`Completion Date` > cutoff",
        "primary_completion_after_cutoff": "`Primary Completion Date` > cutoff",
        "start_before_2020": rules.starts_before("`Start Date`", vocab.PRE_COVID_BEFORE),
        "start_before_2000": rules.starts_before("`Start Date`", vocab.DATE_ERROR_BEFORE),
    }
    counts = parsed.agg(
        F.count("*").alias("n_rows"),
        *[F.expr(f"count_if({test})").alias(k) for k, test in issues.items()],
    )
    rows = counts.unpivot("n_rows", list(issues), "issue", "n")
    return rows.selectExpr("issue", "n", f"{stats.pct_half_even('n', 'n_rows')} AS pct")


def pre_covid_status_mix(clean: DataFrame) -> DataFrame:
    early = clean.filter(F.col("pre_covid_start"))
    return (
        early.groupBy(F.col("Status").alias("status"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "status")
    )


# --- Conditions -------------------------------------------------------------------
def explode_conditions(flat: DataFrame) -> DataFrame:
    """One row per stripped condition entry; empty entries stay in this report."""
    entries = flat.selectExpr(f"explode({text.pipe_tokens('Conditions')}) AS entry")
    return entries.selectExpr(f"{text.strip('entry')} AS condition")


def condition_counts(flat: DataFrame) -> DataFrame:
    """Entries per distinct condition text: the base of all reports below."""
    return explode_conditions(flat).groupBy("condition").agg(F.count("*").alias("n"))


def classified_counts(flat: DataFrame) -> DataFrame:
    """Distinct condition texts with entries, canonical name and area."""
    return rules.classify_conditions(condition_counts(flat), "condition")


def condition_stats(flat: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent lower-cased conditions, with the overall counts."""
    counts = condition_counts(flat)
    best = (
        tally(counts.withColumn("condition", F.lower("condition")), "condition", n="sum(n)")
        .orderBy(F.desc("n"), "condition")
        .limit(top)
    )
    return best.select(
        "condition",
        "n",
        counts.agg(F.sum("n")).scalar().alias("total_entries"),
        counts.agg(F.count("*")).scalar().alias("unique_conditions"),
    )


def normalization_effect(flat: DataFrame) -> DataFrame:
    """Distinct names before and after normalization and the reduction."""
    by_name = (
        classified_counts(flat)
        .groupBy("condition_name")
        .agg(F.count("*").alias("spellings"))
        .agg(F.sum("spellings").alias("unique_before"), F.count("*").alias("unique_after"))
    )
    kept = F.lit(100.0) * (F.col("unique_before") - F.col("unique_after"))
    return by_name.withColumn("reduction_pct", F.bround(kept / F.col("unique_before"), 1))


def area_entry_distribution(flat: DataFrame) -> DataFrame:
    """Condition entries and share per therapeutic area."""
    counts = tally(classified_counts(flat), "therapeutic_area", n_entries="sum(n)")
    total = stats.grand_total("n_entries")
    return counts.selectExpr(
        "therapeutic_area",
        "n_entries",
        f"{stats.pct_half_even('n_entries', total)} AS pct",
        f"{total} AS total_entries",
    ).orderBy(F.desc("n_entries"), "therapeutic_area")


def other_top_terms(flat: DataFrame, top: int = 30) -> DataFrame:
    """Most frequent names that no area claims.

    The area is carried as an aggregate, so the filter on it stays above the
    aggregation: as a grouping key it would be pushed down and the rules would
    run on every row again.
    """
    by_name = tally(
        classified_counts(flat),
        "condition_name",
        n="sum(n)",
        therapeutic_area="max(therapeutic_area)",
    )
    return (
        by_name.filter(f"therapeutic_area = '{vocab.OTHER}'")
        .select("condition_name", "n")
        .orderBy(F.desc("n"), "condition_name")
        .limit(top)
    )


# --- Locations ----------------------------------------------------------------------
def explode_locations(flat: DataFrame) -> DataFrame:
    """One row per stripped location entry with its position in the source."""
    entries = flat.selectExpr(
        INGEST_POS, f"posexplode({text.pipe_tokens('Locations')}) AS (list_pos, entry)"
    )
    return entries.selectExpr(INGEST_POS, "list_pos", f"{text.strip('entry')} AS location")


def location_part_counts(flat: DataFrame, examples: int = 3) -> DataFrame:
    """Entries per number of comma parts, with the first examples of each.

    The rank filter becomes a per-task limit before the shuffle, so only a few
    rows per task and part count move, whatever their share of the data.
    """
    entries = explode_locations(flat).withColumn("n_parts", F.size(F.split("location", ",")))
    counts = entries.groupBy("n_parts").agg(F.count("*").alias("n_locations"))
    order = Window.partitionBy("n_parts").orderBy(INGEST_POS, "list_pos")
    first = entries.withColumn("example_no", F.row_number().over(order)).filter(
        F.col("example_no") <= examples
    )
    return (
        first.join(counts, "n_parts")
        .select("n_parts", "n_locations", "example_no", F.col("location").alias("example"))
        .orderBy("n_parts", "example_no")
    )


def country_entries(flat: DataFrame) -> DataFrame:
    """Entries per country text (the part after the last comma)."""
    country = F.expr(text.last_comma_part("location")).alias("country")
    return explode_locations(flat).groupBy(country).agg(F.count("*").alias("n"))


def country_counts(flat: DataFrame, top: int = 30) -> DataFrame:
    return country_entries(flat).orderBy(F.desc("n"), "country").limit(top)


def continent_entries(flat: DataFrame) -> DataFrame:
    """Entries and distinct countries per continent of the lookup."""
    return (
        country_entries(flat)
        .groupBy(F.expr(rules.continent("country")).alias("continent"))
        .agg(F.count("*").alias("n_countries"), F.sum("n").alias("n_entries"))
        .orderBy(F.desc("n_entries"), "continent")
    )


def unmapped_countries(flat: DataFrame) -> DataFrame:
    """Country texts outside the lookup with their share of all entries.

    Whether a text is mapped is an aggregate, so the lookup runs once per
    distinct text and the total shares the one count.
    """
    counts = country_entries(flat).groupBy("country").agg(
        F.sum("n").alias("n"), F.expr(f"bool_or({rules.is_mapped_country('country')})").alias("mapped")
    )
    total = counts.agg(F.sum("n")).scalar()
    return (
        counts.withColumn("total", total)
        .filter("NOT mapped")
        .selectExpr("country", "n", f"{stats.pct_half_even('n', 'total')} AS pct")
        .orderBy(F.desc("n"), "country")
    )
