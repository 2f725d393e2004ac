"""Every operator and question as a query over the order tables.

Each entry takes (spark, sf_dir) and returns a lazy DataFrame over whole
tables. Only the entries of the file sources and sinks write, because writing
and reading back is what they show.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialbraid import vocab
from trialbraid.functions import rules, text
from trialbraid.operators import cleaning, profile, quality, reshape
from trialbraid.operators import star as tables
from trialbraid.operators.star import Star
from trialbraid.plans import completion, duration, enrollment, geography, landscape
from trialbraid.schema import INGEST_POS, RAW_COLUMNS
from trialbraid.sources import files
from trialbraid.sources import tables as stored
from trialbraid.sources.adapter import raw_registry

Query = Callable[[SparkSession, str], DataFrame]

SPONSORS = "Sponsor/Collaborators"
OTHER_COLUMNS = [c for c in RAW_COLUMNS if c != SPONSORS]
FLAT_OUTPUT = [
    "`NCT Number` AS nct_id",
    "status_group",
    "phase_clean",
    "`Start Date` AS start_date",
    "`Completion Date` AS completion_date",
    "`Primary Completion Date` AS primary_completion_date",
    "Enrollment AS enrollment",
    "pre_covid_start",
    "date_error",
]
STATUS_SQL = """
    SELECT status_group, status, count(*) AS status_count,
           sum(count(*)) OVER (PARTITION BY status_group) AS group_count
    FROM {studies} GROUP BY status_group, status
"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry without the sponsor names, which cost a join."""
    return raw_registry(spark, sf_dir, OTHER_COLUMNS)


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.drop_expanded_access(raw(spark, sf_dir))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_pipeline(raw(spark, sf_dir))


def star(spark: SparkSession, sf_dir: str) -> Star:
    """The star over the registry; only the sponsors table reads the customers."""

    def sponsors() -> DataFrame:
        return tables.build_sponsors(cleaning.clean_pipeline(raw_registry(spark, sf_dir)))

    return Star.of_flat(clean(spark, sf_dir), sponsors=sponsors)


# --- Sources and sinks ---------------------------------------------------------
def _raw_extract(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The raw registry as an extract of two groups of files with different column orders.

    As in a real extract, there is no position column.
    """
    folder = stored.work_folder(spark, name)
    cells = raw_registry(spark, sf_dir)
    turned = F.col(INGEST_POS) % 3 == 0
    files.write_flat(cells.filter(~turned).select(RAW_COLUMNS), f"{folder}/a", "csv")
    files.write_flat(cells.filter(turned).select(RAW_COLUMNS[::-1]), f"{folder}/b", "csv")
    return f"{folder}/*"


def scan_raw_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _raw_extract(spark, sf_dir, "scan_raw_csv")
    return files.scan_raw_csv(spark, path, multi_line=False).select(
        *[F.col(c).alias(reshape.column_label(c)) for c in RAW_COLUMNS]
    )


def scan_multiline_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extract whose titles hold line breaks, quotes and commas, in files of many splits."""
    folder = stored.work_folder(spark, "scan_multiline_csv")
    title = "CASE WHEN k % 3 = 0 THEN concat(Title, '\n\"line\", ', k) ELSE Title END"
    cells = raw_registry(spark, sf_dir, ["NCT Number", "Title", "Conditions"])
    cells = cells.withColumn("k", F.col(INGEST_POS)).withColumn("Title", F.expr(title))
    files.write_flat(cells.select("k", "NCT Number", "Title", "Conditions"), folder, "csv")
    return files.scan_raw_csv(spark, folder).selectExpr(
        "cast(k AS bigint) AS k", "`NCT Number` AS nct_id", "Title AS title", "Conditions AS conditions"
    )


def rejected_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry lines of which some lack a field, have one more, or text behind a quote."""
    folder = stored.work_folder(spark, "rejected_csv")
    cells = raw_registry(spark, sf_dir, ["Status"])
    cells = cells.withColumn("Status", F.regexp_replace("Status", ",", ";"))
    line = f"""CASE {INGEST_POS} % 100 WHEN 1 THEN concat({INGEST_POS}, ',', Status)
        WHEN 2 THEN concat({INGEST_POS}, ',', Status, ',\"a\nb\",more')
        WHEN 3 THEN concat({INGEST_POS}, ',\"', Status, '\" x,y')
        ELSE concat({INGEST_POS}, ',', Status, ',\"a\nb\"') END"""

    def with_head(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The header in front of the lines of a task, which become one file.
        yield pd.DataFrame({"line": ["k,status,note"]})
        yield from parts

    lines = cells.selectExpr(f"{line} AS line").mapInPandas(with_head, "line string")
    lines.write.mode("overwrite").text(folder)
    return files.rejected_csv(spark, folder).select("text", "reason")


def _clean_extract(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Raw CSV, scanned and cleaned."""
    path = _raw_extract(spark, sf_dir, name)
    return cleaning.clean_pipeline(files.scan_raw_csv(spark, path, multi_line=False))


def scan_clean_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stored.work_folder(spark, "scan_clean_csv_clean")
    files.write_flat(_clean_extract(spark, sf_dir, "scan_clean_csv_raw"), path, "csv")
    return files.scan_clean_csv(spark, path, multi_line=False).selectExpr(*FLAT_OUTPUT)


def sink_clean_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stored.work_folder(spark, "sink_clean_flat_clean")
    files.write_flat(_clean_extract(spark, sf_dir, "sink_clean_flat_raw"), path)
    return files.scan_clean(spark, path).selectExpr(*FLAT_OUTPUT)


def _flat_star(spark: SparkSession, sf_dir: str, name: str) -> Star:
    """The star over the clean flat file, written once for all seven tables."""
    path = stored.work_folder(spark, f"{name}_flat")
    files.write_flat(cleaning.clean_pipeline(raw_registry(spark, sf_dir)), path)
    return Star.of_flat(files.scan_clean(spark, path))


def sink_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same load twice is one load."""
    folder = stored.work_folder(spark, "sink_tables")
    load = _flat_star(spark, sf_dir, "sink_tables")
    stored.reset_tables(spark, folder)
    stored.append_tables(load, folder)
    stored.append_tables(load, folder, repeated="skip")
    return tables.row_count_audit(stored.read_star(spark, folder))


def reset_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads with a reset between them leave one load."""
    folder = stored.work_folder(spark, "reset_tables")
    load = _flat_star(spark, sf_dir, "reset_tables")
    stored.reset_tables(spark, folder)
    stored.append_tables(load, folder)
    stored.reset_tables(spark, folder)
    stored.append_tables(load, folder)
    return tables.row_count_audit(stored.read_star(spark, folder))


def merged_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The specialization index over three loads, from the label sets they keep."""
    folder = stored.work_folder(spark, "q4b_merged_loads")
    path = stored.work_folder(spark, "q4b_merged_loads_flat")
    files.write_flat(cleaning.clean_pipeline(raw_registry(spark, sf_dir)), path)
    stored.reset_tables(spark, folder)
    for part in range(3):
        rows = files.scan_clean(spark, path).filter(f"{rules.study_key('`NCT Number`')} % 3 = {part}")
        stored.append_tables(Star.of_flat(rows), folder)
    return geography.specialization_index(stored.read_star(spark, folder))


def load_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three loads by study key; the newest one has no dates on half of its studies."""
    folder = stored.work_folder(spark, "dq_load_drift")
    path = stored.work_folder(spark, "dq_load_drift_flat")
    files.write_flat(cleaning.clean_pipeline(raw_registry(spark, sf_dir)), path)
    flat = files.scan_clean(spark, path)
    key = rules.study_key("`NCT Number`")
    stored.reset_tables(spark, folder)
    for part in range(3):
        rows = flat.filter(f"{key} % 3 = {part}")
        if part == 2:
            rows = rows.withColumn("Completion Date", F.expr(f"if({key} % 2 = 0, NULL, `Completion Date`)"))
        stored.append_tables(Star.of_flat(rows), folder)
    drift = quality.load_drift(stored.load_profiles(spark, folder))
    order = "dense_rank() OVER (ORDER BY number)"
    return drift.filter("table_name IN ('studies', 'conditions')").selectExpr(
        f"cast({order} AS bigint) AS load_no", "table_name", "column_name", "n_rows", "missing",
        "missing_pct", "previous_pct", "change_points", "alert",
    )


# --- Cleaning, row by row --------------------------------------------------------
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [*vocab.STUDY_DATE_COLUMNS, *vocab.POSTED_DATE_COLUMNS]
    return cleaning.parse_dates(raw(spark, sf_dir), columns).selectExpr(
        INGEST_POS, *[f"`{c}` AS {reshape.column_label(c)}" for c in columns]
    )


def placeholder_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = kept(spark, sf_dir)
    parsed = cleaning.parse_dates(flat, vocab.STUDY_DATE_COLUMNS)
    parsed = parsed.withColumn("cutoff", cleaning.data_cutoff(flat))
    return cleaning.null_placeholder_dates(parsed, "cutoff").selectExpr(
        INGEST_POS, *[f"`{c}` AS {reshape.column_label(c)}" for c in cleaning.PLACEHOLDER_COLUMNS]
    )


def date_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = cleaning.parse_dates(kept(spark, sf_dir), ["Start Date"])
    return cleaning.with_date_flags(parsed).select(INGEST_POS, "pre_covid_start", "date_error")


def normalized_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.classified_counts(kept(spark, sf_dir)).select("condition", "condition_name", "n")


def condition_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = profile.classified_counts(kept(spark, sf_dir))
    return named.groupBy("condition_name", "therapeutic_area").agg(F.sum("n").alias("n"))


def mapped_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.country_entries(kept(spark, sf_dir)).withColumn(
        "continent", F.expr(rules.continent("country"))
    )


# --- Normalization -----------------------------------------------------------------
def split_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).selectExpr(
        INGEST_POS, f"posexplode({text.split_pipe('`Funded Bys`')}) AS (pos, token)"
    )


def surrogate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(spark, sf_dir).selectExpr(
        INGEST_POS, "`NCT Number` AS nct_id", f"{rules.study_key('`NCT Number`')} AS study_id"
    )


def _table(name: str) -> Query:
    return lambda spark, sf_dir: getattr(star(spark, sf_dir), name)


def _on_star(plan: Callable[[Star], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(star(spark, sf_dir))


def _on_raw(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(raw(spark, sf_dir))


def _on_kept(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(kept(spark, sf_dir))


QUERIES: dict[str, Query] = {
    # sources and sinks
    "scan_raw_csv": scan_raw_csv,
    "scan_multiline_csv": scan_multiline_csv,
    "rejected_csv": rejected_csv,
    "scan_clean_csv": scan_clean_csv,
    "sink_clean_flat": sink_clean_flat,
    "sink_tables": sink_tables,
    "reset_tables": reset_tables,
    "read_key_map": _on_star(lambda s: tables.key_map(s.studies)),
    "query_to_frame": _on_star(lambda s: stored.query(s, STATUS_SQL)),
    # profiling and cleaning
    "missing_profile": _on_raw(profile.missing_profile),
    "missing_severity": _on_raw(lambda r: profile.missing_severity(profile.missing_profile(r))),
    "value_counts": _on_raw(
        lambda r: profile.value_counts(
            cleaning.with_clean_phase(cleaning.with_status_group(r)),
            ["Status", "Phases", "phase_clean", "status_group"],
        )
    ),
    "status_group": _on_raw(
        lambda r: cleaning.with_status_group(r).selectExpr(
            INGEST_POS, "Status AS status", "status_group"
        )
    ),
    "status_group_share": _on_raw(
        lambda r: profile.status_group_share(cleaning.with_status_group(r))
    ),
    "clean_phase": _on_raw(
        lambda r: cleaning.with_clean_phase(r).selectExpr(
            INGEST_POS, "Phases AS phases", "phase_clean"
        )
    ),
    "enrollment_numeric": _on_raw(
        lambda r: cleaning.with_enrollment_number(r).selectExpr(
            INGEST_POS, "Enrollment AS enrollment"
        )
    ),
    "enrollment_describe": _on_raw(profile.enrollment_describe),
    "enrollment_flags": _on_raw(profile.enrollment_flags),
    "zero_enrollment_by_status": _on_raw(profile.zero_enrollment_by_status),
    "enrollment_by_study_type": _on_raw(profile.enrollment_by_study_type),
    "expanded_access_profile": _on_raw(profile.expanded_access_profile),
    "drop_expanded_access": _on_kept(
        lambda k: k.selectExpr(INGEST_POS, "`Study Type` AS study_type")
    ),
    "parse_dates": parsed_dates,
    "date_range_profile": _on_raw(profile.date_range_profile),
    "extraction_cutoff": _on_kept(cleaning.extraction_date),
    "date_issue_counts": _on_raw(profile.date_issue_counts),
    "null_placeholder_dates": placeholder_dates,
    "date_flags": date_flags,
    "pre_covid_status_mix": lambda s, d: profile.pre_covid_status_mix(clean(s, d)),
    "explode_conditions": _on_kept(profile.explode_conditions),
    "condition_stats": _on_kept(profile.condition_stats),
    "normalize_condition": normalized_conditions,
    "therapeutic_area": condition_areas,
    "normalization_effect": _on_kept(profile.normalization_effect),
    "area_entry_distribution": _on_kept(profile.area_entry_distribution),
    "other_top_terms": _on_kept(profile.other_top_terms),
    "location_part_counts": _on_kept(profile.location_part_counts),
    "country_counts": _on_kept(profile.country_counts),
    "continent_map": mapped_countries,
    "continent_entries": _on_kept(profile.continent_entries),
    "unmapped_countries": _on_kept(profile.unmapped_countries),
    "clean_pipeline": lambda s, d: clean(s, d).selectExpr(INGEST_POS, *FLAT_OUTPUT),
    # normalization into the star
    "split_pipe": split_pipe,
    "surrogate_key": surrogate_key,
    "build_studies": _table("studies"),
    "build_conditions": _table("conditions"),
    "build_interventions": _table("interventions"),
    "build_sponsors": _table("sponsors"),
    "build_outcomes": _table("outcomes"),
    "build_locations": _table("locations"),
    "build_study_design": _table("study_design"),
    "rejected_rows": lambda s, d: tables.rejected_rows(clean(s, d)),
    "row_count_audit": _on_star(tables.row_count_audit),
    # questions
    "q1a_phase_distribution": _on_star(landscape.phase_distribution),
    "q1b_status_distribution": _on_star(landscape.status_distribution),
    "q1c_area_distribution": _on_star(landscape.area_distribution),
    "q1d_monthly_timeline": _on_star(landscape.monthly_timeline),
    "q2a_completion_by_phase": _on_star(completion.completion_by_phase),
    "q2b_completion_by_sponsor": _on_star(completion.completion_by_sponsor),
    "q2c_completion_by_design": _on_star(completion.completion_by_design),
    "q2d_stopped_deep_dive": _on_star(completion.stopped_deep_dive),
    "q3a_enrollment_distribution": _on_star(enrollment.enrollment_distribution),
    "q3b_top_conditions": _on_star(enrollment.top_conditions),
    "q4a_continent_counts": _on_star(geography.continent_counts),
    "q4b_specialization_index": _on_star(geography.specialization_index),
    "q4b_merged_loads": merged_index,
    "q4m_country_map": _on_star(geography.country_map),
    "q5a_duration_by_phase": _on_star(duration.duration_by_phase),
    "q5b_duration_by_area": _on_star(duration.duration_by_area),
    "q5c_duration_area_phase": _on_star(duration.duration_by_area_and_phase),
    # chart data and key figures
    "r1b_group_rollup": _on_star(
        lambda s: reshape.group_rollup(landscape.status_distribution(s))
    ),
    "r1d_main_window": _on_star(lambda s: reshape.main_window(landscape.monthly_timeline(s))),
    "r2a_phase_order": _on_star(
        lambda s: reshape.in_phase_order(completion.completion_by_phase(s))
    ),
    "r2a_risk_band": _on_star(lambda s: reshape.phase_risk_band(completion.completion_by_phase(s))),
    "r2c_risk_band": _on_star(
        lambda s: reshape.design_risk_band(completion.completion_by_design(s))
    ),
    "r2c_masking_labels": _on_star(
        lambda s: reshape.masking_labels(completion.completion_by_design(s))
    ),
    "r2d_pivot": _on_star(lambda s: reshape.stopped_matrix(completion.stopped_deep_dive(s))),
    "r2d_failure_summary": _on_star(
        lambda s: reshape.failure_summary(completion.stopped_deep_dive(s))
    ),
    "r3a_iqr_spread": _on_star(
        lambda s: reshape.iqr_spread(
            enrollment.enrollment_distribution(s), "enrollment", ["study_type", "phase"]
        )
    ),
    "r3b_top8": _on_star(lambda s: reshape.enrollment_top8(enrollment.top_conditions(s))),
    "r3b_log_weight": _on_star(lambda s: reshape.log_weight(enrollment.top_conditions(s))),
    "r4a_top_continents": _on_star(lambda s: reshape.top_continents(geography.continent_counts(s))),
    "r4b_heatmap": _on_star(
        lambda s: reshape.specialization_heatmap(
            geography.specialization_index(s), geography.continent_counts(s)
        )
    ),
    "r5_label_iqr": _on_star(
        lambda s: reshape.duration_phase_chart(duration.duration_by_phase(s))
    ),
    "r5_area_label_iqr": _on_star(
        lambda s: reshape.duration_area_chart(duration.duration_by_area(s))
    ),
    "r5c_facets": _on_star(
        lambda s: reshape.duration_facets(duration.duration_by_area_and_phase(s))
    ),
    "k_resolved_rate": _on_star(completion.resolved_rate),
    "k_pipeline_outliers": _on_star(duration.pipeline_outliers),
    # checks for a daily load
    "dq_bounds": _on_raw(quality.bounds),
    "dq_null_drift": lambda s, d: quality.null_drift(raw(s, d), clean(s, d)),
    "dq_load_drift": load_drift,
    "dq_freshness": _on_raw(lambda r: quality.freshness(r, dt.date(2021, 4, 16))),
}
