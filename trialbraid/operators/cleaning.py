"""From the raw flat file to the clean flat file, one lazy column chain."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialbraid import vocab
from trialbraid.functions import rules
from trialbraid.functions.text import name

#: Flag of the clean file: the row has a place in the star.
IN_STAR = "in_star"
PLACEHOLDER_COLUMNS = ["Completion Date", "Primary Completion Date"]


def drop_expanded_access(flat: DataFrame) -> DataFrame:
    """Remove expanded-access programmes; a missing study type stays."""
    return flat.filter(f"NOT {rules.is_expanded_access(name('Study Type'))}")


def with_status_group(flat: DataFrame) -> DataFrame:
    return flat.withColumn("status_group", F.expr(rules.status_group("Status")))


def with_clean_phase(flat: DataFrame) -> DataFrame:
    return flat.withColumn("phase_clean", F.expr(rules.clean_phase("Phases")))


def with_enrollment_number(flat: DataFrame) -> DataFrame:
    return flat.withColumn("Enrollment", F.expr(rules.enrollment_number("Enrollment")))


def parse_dates(flat: DataFrame, columns: list[str], lenient: bool = False) -> DataFrame:
    return flat.withColumns({c: F.expr(rules.parse_date(name(c), lenient)) for c in columns})


def extraction_date(flat: DataFrame) -> DataFrame:
    """Extraction date and placeholder cutoff, from the newest update in the data."""
    newest = rules.parse_date(name("Last Update Posted"))
    return flat.agg(F.expr(f"max({newest})").alias("extraction_date")).withColumn(
        "cutoff_date", F.expr(rules.cutoff_after("extraction_date"))
    )


def data_cutoff(flat: DataFrame) -> Column:
    """The cutoff of :func:`extraction_date` as a scalar subquery."""
    return extraction_date(flat).select("cutoff_date").scalar()


def null_placeholder_dates(flat: DataFrame, cutoff: str) -> DataFrame:
    """Completion dates beyond the cutoff become NULL."""
    return flat.withColumns(
        {c: F.expr(rules.keep_until(name(c), cutoff)) for c in PLACEHOLDER_COLUMNS}
    )


def with_date_flags(flat: DataFrame) -> DataFrame:
    start = name("Start Date")
    return flat.withColumns(
        {
            "pre_covid_start": F.expr(rules.starts_before(start, vocab.PRE_COVID_BEFORE)),
            "date_error": F.expr(rules.starts_before(start, vocab.DATE_ERROR_BEFORE)),
        }
    )


def clean_pipeline(
    raw: DataFrame, extraction: dt.date = vocab.EXTRACTION_DATE, lenient_dates: bool = False
) -> DataFrame:
    """All cleaning decisions in order.

    Only expressions and one filter: no shuffle and no second read, so the
    whole chain runs in the stage that scans the source.
    """
    flat = drop_expanded_access(raw)
    flat = with_clean_phase(flat)
    flat = with_status_group(flat)
    flat = parse_dates(flat, vocab.STUDY_DATE_COLUMNS, lenient_dates)
    flat = null_placeholder_dates(flat, rules.cutoff_after(rules.date_literal(extraction)))
    flat = with_date_flags(flat)
    flat = flat.withColumn(IN_STAR, F.expr(rules.has_star_place("`NCT Number`", "Enrollment")))
    return with_enrollment_number(flat)
