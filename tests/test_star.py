"""Invariants of the star, stored tables and file round trips."""

from __future__ import annotations

import datetime as dt

import pytest

from trialbraid.catalog import clean
from trialbraid.catalog import star as derived_star
from trialbraid.operators import cleaning, profile, quality, reshape
from trialbraid.operators.star import Star, accepted, rejected_rows, row_count_audit
from trialbraid.plans import completion, duration, enrollment, geography, landscape
from trialbraid.schema import INGEST_POS, RAW_COLUMNS, STAR_SCHEMAS
from trialbraid.sources import files
from trialbraid.sources import tables as stored
from trialbraid.sources.adapter import raw_registry


@pytest.fixture(scope="module")
def star(spark, sf_dir):
    return derived_star(spark, sf_dir)


def test_tables_have_the_fixed_schemas(star):
    for name, df in star.tables().items():
        assert [(f.name, f.dataType) for f in df.schema] == [
            (f.name, f.dataType) for f in STAR_SCHEMAS[name]
        ]


def test_children_have_a_study(star):
    for name in ("conditions", "interventions", "outcomes", "sponsors", "locations"):
        children = getattr(star, name)
        assert children.count() > 0
        assert children.join(star.studies, "study_id", "left_anti").count() == 0


def test_studies_are_unique_and_designs_complete(spark, sf_dir, star):
    studies = star.studies
    assert studies.select("study_id").distinct().count() == studies.count()
    assert star.study_design.count() == accepted(clean(spark, sf_dir)).count()
    assert studies.join(star.study_design, "study_id", "left_anti").count() == 0


def test_first_registration_is_kept_with_all_children(registry):
    number = {"NCT Number": "NCT00000001"}
    flat = cleaning.clean_pipeline(
        registry(
            {**number, "Title": "first", "Conditions": "COVID-19", "Status": "Completed"},
            {**number, "Title": "second", "Conditions": "Asthma|Asthma", "Status": "Withdrawn"},
            {"Title": "no number", "Conditions": "Sepsis"},
        )
    )
    star = Star.of_flat(flat)
    assert [(r.study_id, r.title) for r in star.studies.collect()] == [(1, "first")]
    assert sorted(r.condition_name for r in star.conditions.collect()) == [
        "Asthma",
        "Asthma",
        "COVID-19",
    ]


def test_sponsors_shift_over_an_empty_funder(registry):
    flat = cleaning.clean_pipeline(
        registry(
            {
                "NCT Number": "NCT00000007",
                "Sponsor/Collaborators": "A|B| C|",
                "Funded Bys": "Other||Industry",
            }
        )
    )
    rows = Star.of_flat(flat).sponsors.collect()
    assert [(r.agency, r.agency_class, r.lead_or_collaborator) for r in rows] == [
        ("A", "Other", "Lead"),
        ("B", "Industry", "Collaborator"),
        ("C", None, "Collaborator"),
    ]


def test_repeated_condition_is_summed_twice_and_counted_once(registry):
    row = {"NCT Number": "NCT00000001", "Enrollment": "10", "Conditions": "Asthma|asthma|Sepsis"}
    flat = cleaning.clean_pipeline(registry(row))
    rows = enrollment.top_conditions(Star.of_flat(flat)).collect()
    assert [(r.condition_name, r.n_trials, r.total_enrollment) for r in rows] == [
        ("Asthma", 1, 20),
        ("Sepsis", 1, 10),
    ]


def test_totals_fit_together(star):
    studies = star.studies.count()
    phases = landscape.phase_distribution(star).collect()
    assert sum(r.trial_count for r in phases) == studies
    areas = landscape.area_distribution(star).collect()
    assert sum(r.pct_of_all_studies for r in areas) > 100
    months = landscape.monthly_timeline(star).collect()
    assert months[-1].cumulative_total == sum(r.total_started for r in months)
    statuses = landscape.status_distribution(star).collect()
    assert sum(r.status_count for r in statuses) == studies


def test_hot_study_and_hot_area_keep_whole_results(registry):
    """A third of all rows is one number with one condition."""
    hot = {
        "NCT Number": "NCT00000001",
        "Conditions": "COVID-19",
        "Status": "Completed",
        "Locations": "H, Paris, France",
        "Start Date": "2020-03-01",
        "Completion Date": "2020-03-11",
    }
    others = [dict(hot, **{"NCT Number": f"NCT{n:08d}"}) for n in range(2, 22)]
    star = Star.of_flat(cleaning.clean_pipeline(registry(*[hot] * 10, *others)))
    (area,) = landscape.area_distribution(star).collect()
    assert (area.trial_count, area.pct_of_all_studies) == (21, 100.0)
    (place,) = geography.continent_counts(star).collect()
    assert (place.continent, place.trial_count) == ("Europe", 21)
    (spent,) = duration.duration_by_area(star).collect()
    assert (spent.n_trials, spent.duration_median) == (21, 10.0)
    (cell,) = geography.specialization_index(star).collect()
    assert (cell.area_trials, cell.specialization_index) == (21, 1.0)


def test_stored_star_gives_the_same_answers(spark, star):
    folder = stored.work_folder(spark, "same_answers")
    stored.append_tables(star, folder)
    again = stored.read_star(spark, folder)
    assert row_count_audit(again).collect() == row_count_audit(star).collect()
    for plan in (
        geography.specialization_index,
        completion.completion_by_sponsor,
        duration.duration_by_area_and_phase,
        enrollment.top_conditions,
    ):
        assert plan(again).collect() == plan(star).collect()
    empty = stored.reset_tables(spark, folder)
    assert {r.n_rows for r in row_count_audit(empty).collect()} == {0}


def test_bucketed_tables_join_without_a_shuffle(spark, star):
    spark.sql("CREATE DATABASE IF NOT EXISTS registry_test")
    stored.save_bucketed(star, "registry_test", 4)
    saved = Star(lambda name: spark.table(f"registry_test.{name}"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = saved.studies.join(saved.conditions, "study_id").groupBy("study_id").count()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_raw_csv_to_clean_csv_to_star(spark, sf_dir, star):
    """An extract without positions, cleaned, written as CSV and read again, gives the same star."""
    folder = stored.work_folder(spark, "round_trip")
    raw = raw_registry(spark, sf_dir)
    files.write_flat(raw.coalesce(1).sortWithinPartitions(INGEST_POS).select(RAW_COLUMNS), f"{folder}/raw", "csv")
    scanned = files.scan_raw_csv(spark, f"{folder}/raw", multi_line=False)
    assert scanned.select(RAW_COLUMNS).exceptAll(raw.select(RAW_COLUMNS)).count() == 0
    assert scanned.count() == raw.count()
    files.write_flat(cleaning.clean_pipeline(scanned), f"{folder}/clean", "csv")
    again = Star.of_flat(files.scan_clean_csv(spark, f"{folder}/clean"))
    assert again.studies.exceptAll(star.studies).count() == 0
    assert row_count_audit(again).collect() == row_count_audit(star).collect()


def test_each_csv_file_is_mapped_by_its_own_header(spark, tmp_path):
    head = "NCT Number,Status,Title\nNCT00000001,Completed,one\n"
    (tmp_path / "a.csv").write_text(head, encoding="utf-8")
    other = "NCT Number,Title,Acronym,Status\nNCT00000002,two,ACR,Withdrawn\n"
    (tmp_path / "b.csv").write_text(other, encoding="utf-8")
    for multi_line in (True, False):
        rows = files.scan_raw_csv(spark, str(tmp_path), multi_line=multi_line).orderBy(INGEST_POS)
        assert [(r["NCT Number"], r.Status, r.Title, r.Acronym) for r in rows.collect()] == [
            ("NCT00000001", "Completed", "one", None),
            ("NCT00000002", "Withdrawn", "two", "ACR"),
        ]
    with pytest.raises(Exception, match="Phases"):
        files.scan_raw_csv(spark, str(tmp_path), ["Phases"])


def test_a_repeated_load_is_refused_or_skipped(spark, star):
    folder = stored.work_folder(spark, "repeated")
    stored.reset_tables(spark, folder)
    stored.append_tables(star, folder)
    with pytest.raises(ValueError, match="stored already"):
        stored.append_tables(star, folder)
    stored.append_tables(star, folder, repeated="skip")
    again = stored.read_star(spark, folder)
    assert row_count_audit(again).collect() == row_count_audit(star).collect()
    assert landscape.area_distribution(again).collect() == landscape.area_distribution(star).collect()


def test_an_unfinished_load_is_invisible(spark, star):
    folder = stored.work_folder(spark, "unfinished")
    stored.reset_tables(spark, folder)
    for name in ("studies", "conditions"):
        getattr(star, name).write.mode("overwrite").parquet(f"{folder}/{name}/load=broken")
    assert landscape.area_distribution(stored.read_star(spark, folder)).collect() == []


def test_two_numbers_with_one_key_are_an_error(registry, monkeypatch):
    flat = cleaning.clean_pipeline(registry({"NCT Number": "A-1"}, {"NCT Number": "B-2"}))
    monkeypatch.setattr("trialbraid.functions.rules.study_key", lambda c: f"cast(length({c}) AS bigint)")
    with pytest.raises(Exception, match="study key of two numbers"):
        Star.of_flat(flat).studies.collect()


def test_enrollment_report_of_nothing_has_a_row(registry):
    (row,) = profile.enrollment_describe(registry({"Enrollment": "unknown"})).collect()
    assert row.n_values == 0 and row.median is None and row.mean is None


def test_rows_without_a_place_are_counted(registry):
    flat = cleaning.clean_pipeline(
        registry(
            {"Title": "no number", "Conditions": "Asthma"},
            {"NCT Number": "NCT00000001", "Enrollment": "3000000000", "Conditions": "Asthma"},
            {"NCT Number": "NCT00000002", "Enrollment": "30", "Conditions": "Asthma"},
        )
    )
    assert {(r.reason, r.n_rows) for r in rejected_rows(flat).collect()} == {
        ("no registry number", 1),
        ("enrollment out of range", 1),
    }
    star = Star.of_flat(flat)
    assert [r.nct_id for r in star.studies.collect()] == ["NCT00000002"]
    assert star.conditions.count() == 1 and star.n_studies().first()[0] == 1


def test_hot_study_counts_once_per_registration(registry):
    """Many rows of one number weigh as their count in the questions on sponsors and designs."""
    row = {
        "NCT Number": "NCT00000001", "Status": "Completed", "Funded Bys": "NIH",
        "Sponsor/Collaborators": "A", "Study Designs": "Allocation: Randomized",
    }
    hot = Star.of_flat(cleaning.clean_pipeline(registry(*[row] * 40)))
    (sponsor,) = completion.completion_by_sponsor(hot).collect()
    assert (sponsor.total_resolved, sponsor.completed, sponsor.stopped) == (40, 40, 0)
    (design,) = completion.completion_by_design(hot).collect()
    assert (design.total_resolved, design.completed) == (40, 40)


def test_csv_with_line_breaks_and_quotes(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(
        'Rank,NCT Number,Title,Enrollment\n1,NCT00000001,"two\nlines, ""quoted""",N/A\n'
        "2,NCT00000002,plain,170\n",
        encoding="utf-8",
    )
    rows = files.scan_raw_csv(spark, str(path)).orderBy(INGEST_POS).collect()
    assert [(r["NCT Number"], r.Title, r.Enrollment) for r in rows] == [
        ("NCT00000001", 'two\nlines, "quoted"', None),
        ("NCT00000002", "plain", "170"),
    ]
    wanted = files.scan_raw_csv(spark, str(path), ["Title"])
    assert wanted.columns == [INGEST_POS, "Title"]


def test_cutoff_from_the_data(registry):
    flat = registry({"Last Update Posted": "2021-04-14"}, {"Last Update Posted": "March 1, 2020"})
    row = cleaning.extraction_date(flat).first()
    assert (row.extraction_date, row.cutoff_date) == (dt.date(2021, 4, 14), dt.date(2031, 4, 14))


def test_profile_keeps_empty_condition_entries(registry):
    flat = registry({"Conditions": "a| b|"}, {"Conditions": None})
    assert sorted(r.condition for r in profile.explode_conditions(flat).collect()) == ["", "a", "b"]


def test_missing_phases_are_rows_of_nulls(spark):
    df = spark.createDataFrame(
        [("Phase 2", "Interventional", 50.0)], "phase string, study_type string, rate double"
    )
    rows = reshape.in_phase_order(df).collect()
    assert [r.phase for r in rows][2] == "Phase 2" and len(rows) == 6
    assert [r.rate for r in rows] == [None, None, 50.0, None, None, None]


def test_enrollment_labels(spark):
    totals = [1_118_700_000, 1_250_000, 1_150_000, 499_600, 0]
    df = spark.createDataFrame(
        [(f"c{i}", 1, t) for i, t in enumerate(totals)],
        "condition_name string, n_trials bigint, total_enrollment bigint",
    )
    labels = [r.label for r in reshape.enrollment_top8(df).collect()]
    assert labels == ["1118.7M", "1.2M", "1.1M", "500K", "0K"]


def test_freshness(registry):
    flat = registry({"Last Update Posted": "2021-04-14"})
    row = quality.freshness(flat, dt.date(2021, 4, 15)).first()
    assert (row.age_days, row.late) == (1, False)
    assert quality.freshness(registry({}), dt.date(2021, 4, 15)).first().late is True


def test_sql_text_over_the_star(star):
    """Named frames, an array aggregate and a ranking inside the text."""
    rows = stored.query(
        star,
        """
        WITH sites AS (
            SELECT continent, country, count(*) AS entries FROM {locations} GROUP BY ALL
        )
        SELECT continent, max_by(country, struct(entries, country)) AS largest,
               array_sort(collect_list(entries))[0] AS fewest
        FROM sites WHERE continent IS NOT NULL GROUP BY continent
        """,
    ).collect()
    sites = star.locations.groupBy("continent", "country").count().collect()
    expected = {}
    for s in sites:
        if s.continent is not None:
            expected.setdefault(s.continent, []).append((s["count"], s.country or ""))
    assert {r.continent: (r.largest, r.fewest) for r in rows} == {
        c: (max(v)[1], min(v)[0]) for c, v in expected.items()
    }
