"""The oracle text of every query in the catalog."""

from __future__ import annotations

from checks.oracle import _half_even_pct, _half_up, _in, _s, sql
from trialbraid import vocab
from trialbraid.schema import STAR_SCHEMAS

_FLAT = """nct AS nct_id, status_group, phase_clean, start_date, completion_date,
    primary_completion_date, enrolled AS enrollment, pre_covid_start, date_error"""

_CRITICAL = {
    "Phases": "phases",
    "Status": "status",
    "Conditions": "conditions",
    "Start Date": "start_text",
    "Funded Bys": "funders",
    "Study Type": "study_type",
    "Study Designs": "designs",
    "Enrollment": "enrollment",
    "Locations": "locations",
    "Completion Date": "completion_text",
    "Primary Completion Date": "primary_text",
}
_CLEANED = dict(
    _CRITICAL,
    **{
        "Start Date": "start_date",
        "Completion Date": "completion_date",
        "Primary Completion Date": "primary_completion_date",
        "Enrollment": "enrolled",
    },
)


def _missing(table: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {_s(name)} AS column_name, count(*) - count({c}) AS missing_count, "
        f"{_half_even_pct(f'count(*) - count({c})', 'count(*)')} AS missing_pct FROM {table}"
        for name, c in columns.items()
    )


def _audit() -> str:
    tables = [
        "studies", "conditions", "interventions", "outcomes", "sponsors", "locations",
        "study_design",
    ]
    body = " UNION ALL ".join(
        f"SELECT {_s(t)} AS table_name, count(*) AS n_rows FROM {t}" for t in tables
    )
    return sql(body, *tables)


def _cells(table: str, columns: list[str], **changed: str) -> str:
    return " UNION ALL ".join(
        f"SELECT study_id, {_s(c)} AS column_name, CAST({changed.get(c, c)} AS VARCHAR) AS v FROM {table}"
        for c in columns
    )


def _counts(column: str, label: str) -> str:
    return f"SELECT {_s(label)} AS column_name, {column} AS value, count(*) AS n FROM grouped GROUP BY 2"


def _range(column: str, label: str, stage: str) -> str:
    return f"""SELECT {_s(stage)} AS stage, {_s(label)} AS column_name, count({column}) AS valid,
        count(*) - count({column}) AS missing, min({column}) AS min_date,
        max({column}) AS max_date FROM flat"""


def _issue(name: str, test: str) -> str:
    return f"""SELECT {_s(name)} AS issue, count(*) FILTER (WHERE {test}) AS n,
        {_half_even_pct(f"count(*) FILTER (WHERE {test})", "count(*)")} AS pct FROM kept"""


def _rule(name: str, test: str) -> str:
    return f"""SELECT {_s(name)} AS rule, count(*) FILTER (WHERE {test}) AS violations,
        {_half_even_pct(f"count(*) FILTER (WHERE {test})", "count(*)")} AS pct FROM grouped"""


def _med(column: str, p: str = "0.5") -> str:
    return f"round(quantile_cont({column}, {p}), 0)"


_DONE = "count(*) FILTER (WHERE status_group = 'Completed')"
_HALT = "count(*) FILTER (WHERE status_group = 'Stopped')"
_RATE = f"{_half_up(_DONE, 'count(*)')} AS completion_rate_pct"

_Q1A = f"""SELECT phase, count(*) AS trial_count,
    {_half_up("count(*)", "(SELECT count(*) FROM studies)")} AS pct FROM studies GROUP BY phase"""
_Q1B = f"""SELECT a.status_group, a.status, a.c AS status_count, b.c AS group_count,
    {_half_up("a.c", "b.c")} AS pct_within_group,
    {_half_up("a.c", "(SELECT count(*) FROM studies)")} AS pct_overall
    FROM (SELECT status_group, status, count(*) AS c FROM studies GROUP BY 1, 2) a,
         (SELECT status_group, count(*) AS c FROM studies GROUP BY 1) b
    WHERE a.status_group = b.status_group"""
_Q1C = f"""SELECT therapeutic_area, count(*) AS trial_count,
    {_half_up("count(*)", "(SELECT count(*) FROM studies)")} AS pct_of_all_studies
    FROM areas GROUP BY 1"""
_Q1D = """SELECT month, total_started, active, completed, stopped,
    (SELECT sum(e.total_started) FROM months e WHERE e.month <= m.month)::BIGINT
        AS cumulative_total FROM months m"""
_MONTHS = """SELECT make_date(year(start_date), month(start_date), 1) AS month,
    count(*) AS total_started,
    count(*) FILTER (WHERE status_group = 'Active') AS active,
    count(*) FILTER (WHERE status_group = 'Completed') AS completed,
    count(*) FILTER (WHERE status_group = 'Stopped') AS stopped
    FROM studies WHERE start_date >= DATE '2020-01-01' GROUP BY 1"""
_Q2A = f"""SELECT phase, study_type, count(*) AS total_resolved, {_DONE} AS completed,
    {_HALT} AS stopped, {_RATE}, {_med("enrollment")} AS median_enrollment
    FROM studies WHERE status_group IN ('Completed', 'Stopped') AND phase <> 'Unknown'
    GROUP BY ALL"""
_Q2B = f"""SELECT agency_class, count(*) AS total_resolved, {_DONE} AS completed,
    {_HALT} AS stopped, {_RATE}
    FROM studies JOIN sponsors USING (study_id)
    WHERE lead_or_collaborator = 'Lead' AND status_group IN ('Completed', 'Stopped')
    GROUP BY 1"""
_Q2C = " UNION ALL ".join(
    f"""SELECT {_s(label)} AS design_feature, {c} AS feature_value,
    count(*) AS total_resolved, {_DONE} AS completed, {_RATE}
    FROM studies JOIN study_design USING (study_id)
    WHERE status_group IN ('Completed', 'Stopped') AND {c} IS NOT NULL GROUP BY 2"""
    for label, c in (
        ("Allocation", "allocation"),
        ("Intervention Model", "intervention_model"),
        ("Masking", "masking"),
    )
)
_Q2D = f"""SELECT *, rank() OVER (PARTITION BY status ORDER BY n_trials DESC)
        AS rank_within_status
    FROM (SELECT status, phase, count(*) AS n_trials, {_med("enrollment")} AS median_enrollment,
        {_med("date_part('day', age(completion_date, start_date))")} AS median_duration_days
        FROM studies WHERE status_group = 'Stopped' AND phase <> 'Unknown' GROUP BY ALL)"""
_Q3A = f"""SELECT study_type, phase, count(*) AS n_trials,
    {_med("enrollment", "0.25")} AS enrollment_q1, {_med("enrollment")} AS enrollment_median,
    {_med("enrollment", "0.75")} AS enrollment_q3, max(enrollment) AS enrollment_max
    FROM studies WHERE enrollment > 0 AND phase <> 'Unknown' GROUP BY ALL"""
_Q3B = f"""SELECT * FROM (SELECT condition_name, therapeutic_area,
    count(DISTINCT study_id) AS n_trials, sum(enrollment)::BIGINT AS total_enrollment,
    {_med("enrollment")} AS median_enrollment_per_trial,
    rank() OVER (ORDER BY sum(enrollment) DESC) AS enrollment_rank
    FROM studies JOIN conditions USING (study_id) WHERE enrollment > 0 GROUP BY 1, 2)
    ORDER BY enrollment_rank, condition_name, therapeutic_area LIMIT 20"""
_Q4A = f"""SELECT continent, count(DISTINCT study_id) AS trial_count,
    {_half_up("count(DISTINCT study_id)", "(SELECT count(DISTINCT study_id) FROM locations)")}
        AS pct_of_trials FROM locations GROUP BY 1"""
_Q4B = f"""SELECT r.continent, r.therapeutic_area, r.a AS area_trials,
    {_half_up("r.a", "c.t")} AS local_pct,
    {_half_up("g.g", "(SELECT count(*) FROM studies)")} AS global_pct,
    {_half_up("r.a::HUGEINT * (SELECT count(*) FROM studies)", "c.t::HUGEINT * g.g", 100, "1")}
        AS specialization_index
    FROM (SELECT continent, therapeutic_area, count(DISTINCT study_id) AS a
          FROM locations JOIN areas USING (study_id) GROUP BY ALL) r
    JOIN (SELECT continent, count(DISTINCT study_id) AS t FROM locations GROUP BY 1) c
      ON r.continent = c.continent
    JOIN (SELECT therapeutic_area, count(*) AS g FROM areas GROUP BY 1) g
      ON r.therapeutic_area = g.therapeutic_area
    WHERE r.a >= 5"""
_SPREAD = f"""{_med("d", "0.25")} AS duration_q1, {_med("d")} AS duration_median,
    {_med("d", "0.75")} AS duration_q3"""
_WIDE = f"""count(*) AS n_trials, {_SPREAD},
    {_half_up("sum(d)", "count(*)", 1, "1")} AS duration_mean,
    min(d)::INTEGER AS duration_min, max(d)::INTEGER AS duration_max"""
_Q5A = f"SELECT phase, {_WIDE} FROM durations WHERE phase <> 'Unknown' GROUP BY 1"
_Q5B = f"""SELECT therapeutic_area, {_WIDE} FROM durations JOIN areas USING (study_id)
    GROUP BY 1 HAVING count(*) >= 10"""
_Q5C = f"""SELECT therapeutic_area, phase, count(*) AS n_trials, {_SPREAD}
    FROM durations JOIN areas USING (study_id)
    WHERE phase NOT IN ('Unknown', 'Not Applicable') GROUP BY ALL"""

_BAND = """CASE WHEN completion_rate_pct >= {low} THEN 'Low Risk'
    WHEN completion_rate_pct >= {mid} THEN 'Moderate Risk' ELSE 'High Risk' END"""
_PHASE_ROWS = ", ".join(f"({_s(p)}, {i})" for i, p in enumerate(vocab.PHASE_ORDER))
_CLINICAL = f"list_position([{', '.join(_s(p) for p in vocab.CLINICAL_PHASES)}], phase)"
_STATUS_ROWS = ", ".join(f"({_s(p)}, {i})" for i, p in enumerate(vocab.STOPPED_STATUS_ORDER))


def _plain(value: str) -> str:
    return "".join(ch.lower() if ch.isalnum() else "_" for ch in value)


_MATRIX = ", ".join(
    f"coalesce(sum(n_trials) FILTER (WHERE phase = {_s(p)}), 0)::BIGINT AS {_plain(p)}"
    for p in vocab.PHASE_ORDER
)
_HEAT = ", ".join(
    f"coalesce(max(specialization_index) FILTER (WHERE therapeutic_area = {_s(a)}), 0.0)::DOUBLE"
    f" AS {_plain(a)}"
    for a in vocab.AREAS
)
_RAW_OUT = """nct AS nct_number, title, acronym, status, conditions, interventions,
    outcomes AS outcome_measures, sponsors AS sponsor_collaborators, gender, phases, enrollment,
    funders AS funded_bys, study_type, designs AS study_designs, start_text AS start_date,
    primary_text AS primary_completion_date, completion_text AS completion_date,
    first_posted_text AS first_posted, updated_text AS last_update_posted, locations"""
_CUTOFF = "(SELECT max(updated) + INTERVAL 10 YEAR FROM kept)"
_TYPE_STATS = f"""round_even(quantile_cont(enrolled, 0.5), 0) AS median,
    round_even(avg(enrolled), 0) AS mean, round_even(max(enrolled), 0) AS max"""
_IQR = "duration_median - duration_q1 AS spread_down, duration_q3 - duration_median AS spread_up"

ORACLE: dict[str, str] = {
    "scan_raw_csv": sql(f"SELECT {_RAW_OUT} FROM raw", "raw"),
    "scan_multiline_csv": sql(
        """SELECT k, nct AS nct_id, conditions, CASE WHEN k % 3 = 0
        THEN concat(title, chr(10), '"line", ', k) ELSE title END AS title FROM base JOIN raw ON ingest_pos = k""",
        "raw",
    ),
    "rejected_csv": sql(
        """SELECT concat(ingest_pos, CASE ingest_pos % 100 WHEN 1 THEN ',' || replace(status, ',', ';')
            WHEN 2 THEN ',' || replace(status, ',', ';') || ',"a' || chr(10) || 'b",more'
            ELSE ',"' || replace(status, ',', ';') || '" x,y' END) AS text,
        ['too few fields', 'too many fields', 'text behind a closing quote'][ingest_pos % 100] AS reason
        FROM raw WHERE ingest_pos % 100 BETWEEN 1 AND 3""",
        "raw",
    ),
    "scan_clean_csv": sql(f"SELECT {_FLAT} FROM flat", "flat"),
    "sink_clean_flat": sql(f"SELECT {_FLAT} FROM flat", "flat"),
    "sink_tables": _audit(),
    "reset_tables": _audit(),
    "read_key_map": sql("SELECT DISTINCT study_id, nct AS nct_id FROM accepted", "accepted"),
    "rejected_rows": sql(
        """SELECT CASE WHEN nct IS NULL THEN 'no registry number' ELSE 'enrollment out of range' END
            AS reason, count(*) AS n_rows
        FROM flat WHERE nct IS NULL OR abs(enrolled) > 2147483647 GROUP BY ALL""",
        "flat",
    ),
    "query_to_frame": sql(
        """SELECT status_group, status, count(*) AS status_count,
        (SELECT count(*) FROM studies g WHERE g.status_group = s.status_group) AS group_count
        FROM studies s GROUP BY ALL""",
        "studies",
    ),
    "missing_profile": sql(_missing("raw", _CRITICAL), "raw"),
    "missing_severity": sql(
        f"""SELECT column_name, missing_pct, CASE WHEN missing_pct > 20 THEN 'high'
        WHEN missing_pct > 5 THEN 'medium' ELSE 'low' END AS severity
        FROM ({_missing("raw", _CRITICAL)})""",
        "raw",
    ),
    "value_counts": sql(
        " UNION ALL ".join(
            _counts(c, label)
            for c, label in (
                ("status", "Status"),
                ("phases", "Phases"),
                ("phase_clean", "phase_clean"),
                ("status_group", "status_group"),
            )
        ),
        "grouped",
    ),
    "status_group": sql("SELECT ingest_pos, status, status_group FROM grouped", "grouped"),
    "status_group_share": sql(
        f"""SELECT status_group, count(*) AS n,
        {_half_up("count(*)", "(SELECT count(*) FROM grouped)")} AS pct
        FROM grouped GROUP BY 1""",
        "grouped",
    ),
    "clean_phase": sql("SELECT ingest_pos, phases, phase_clean FROM grouped", "grouped"),
    "enrollment_numeric": sql("SELECT ingest_pos, enrolled AS enrollment FROM grouped", "grouped"),
    "enrollment_describe": sql(
        """SELECT count(enrolled) AS n_values, round(avg(enrolled), 6) AS mean,
        round(stddev_samp(enrolled), 6) AS stddev, min(enrolled) AS min,
        quantile_cont(enrolled, 0.25) AS q1, quantile_cont(enrolled, 0.5) AS median,
        quantile_cont(enrolled, 0.75) AS q3, max(enrolled) AS max FROM grouped""",
        "grouped",
    ),
    "enrollment_flags": sql(
        """SELECT count(*) - count(enrolled) AS missing,
        count(*) FILTER (WHERE enrolled = 0) AS zero,
        count(*) FILTER (WHERE enrolled > 100000) AS over_100k FROM grouped""",
        "grouped",
    ),
    "zero_enrollment_by_status": sql(
        "SELECT status, count(*) AS n FROM grouped WHERE enrolled = 0 GROUP BY 1", "grouped"
    ),
    "enrollment_by_study_type": sql(
        f"""SELECT study_type, {_TYPE_STATS} FROM grouped
        WHERE study_type IS NOT NULL GROUP BY 1""",
        "grouped",
    ),
    "expanded_access_profile": sql(
        f"""SELECT count(*) AS n_rows, count(*) FILTER (WHERE study_type LIKE '%Expanded%')
            AS n_expanded,
        {_half_even_pct("count(*) FILTER (WHERE study_type LIKE '%Expanded%')", "count(*)")}
            AS pct_expanded FROM raw""",
        "raw",
    ),
    "drop_expanded_access": sql("SELECT ingest_pos, study_type FROM kept", "kept"),
    "parse_dates": sql(
        """SELECT ingest_pos, start_date, completion_raw AS completion_date,
        primary_raw AS primary_completion_date, updated AS last_update_posted,
        coalesce(try_strptime(first_posted_text, '%Y-%m-%d'),
                 try_strptime(first_posted_text, '%B %d, %Y'))::DATE AS first_posted
        FROM grouped""",
        "grouped",
    ),
    "date_range_profile": sql(
        " UNION ALL ".join(
            _range(c, label, stage)
            for c, label, stage in (
                ("start_date", "Start Date", "before"),
                ("start_date", "Start Date", "after"),
                ("completion_raw", "Completion Date", "before"),
                ("completion_date", "Completion Date", "after"),
                ("primary_raw", "Primary Completion Date", "before"),
                ("primary_completion_date", "Primary Completion Date", "after"),
            )
        ),
        "flat",
    ),
    "extraction_cutoff": sql(
        f"SELECT max(updated) AS extraction_date, {_CUTOFF}::DATE AS cutoff_date FROM kept", "kept"
    ),
    "date_issue_counts": sql(
        " UNION ALL ".join(
            [
                _issue("completion_after_cutoff", f"completion_raw > {_CUTOFF}"),
                _issue("primary_completion_after_cutoff", f"primary_raw > {_CUTOFF}"),
                _issue("start_before_2020", "start_date < DATE '2020-01-01'"),
                _issue("start_before_2000", "start_date < DATE '2000-01-01'"),
            ]
        ),
        "kept",
    ),
    "null_placeholder_dates": sql(
        "SELECT ingest_pos, completion_date, primary_completion_date FROM flat", "flat"
    ),
    "date_flags": sql("SELECT ingest_pos, pre_covid_start, date_error FROM flat", "flat"),
    "pre_covid_status_mix": sql(
        "SELECT status, count(*) AS n FROM flat WHERE start_date < DATE '2020-01-01' GROUP BY 1",
        "flat",
    ),
    "explode_conditions": sql("SELECT condition FROM entries", "entries"),
    "condition_stats": sql(
        """SELECT lower(condition) AS condition, count(*) AS n,
        (SELECT count(*) FROM entries) AS total_entries,
        (SELECT count(DISTINCT condition) FROM entries) AS unique_conditions
        FROM entries GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20""",
        "entries",
    ),
    "normalize_condition": sql(
        "SELECT condition, condition_name, count(*) AS n FROM classified GROUP BY ALL",
        "classified",
    ),
    "therapeutic_area": sql(
        "SELECT condition_name, therapeutic_area, count(*) AS n FROM classified GROUP BY ALL",
        "classified",
    ),
    "normalization_effect": sql(
        f"""SELECT b AS unique_before, a AS unique_after,
        {_half_even_pct("b - a", "b")} AS reduction_pct
        FROM (SELECT count(DISTINCT condition) AS b, count(DISTINCT condition_name) AS a
              FROM classified)""",
        "classified",
    ),
    "area_entry_distribution": sql(
        f"""SELECT therapeutic_area, count(*) AS n_entries,
        {_half_even_pct("count(*)", "(SELECT count(*) FROM classified)")} AS pct,
        (SELECT count(*) FROM classified) AS total_entries FROM classified GROUP BY 1""",
        "classified",
    ),
    "other_top_terms": sql(
        """SELECT condition_name, count(*) AS n FROM classified
        WHERE therapeutic_area = 'Other' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 30""",
        "classified",
    ),
    "location_part_counts": sql(
        """SELECT n_parts, count(*) OVER (PARTITION BY n_parts) AS n_locations,
        row_number() OVER (PARTITION BY n_parts ORDER BY ingest_pos, i)::INTEGER AS example_no,
        location AS example
        FROM (SELECT *, len(string_split(location, ','))::INTEGER AS n_parts FROM sites)
        QUALIFY example_no <= 3""",
        "sites",
    ),
    "country_counts": sql(
        "SELECT country, n FROM site_countries ORDER BY n DESC, country LIMIT 30",
        "site_countries",
    ),
    "continent_map": sql(
        """SELECT s.country, s.n, coalesce(c.continent, 'Other') AS continent
        FROM site_countries s LEFT JOIN countries c ON s.country = c.country""",
        "site_countries",
        "countries",
    ),
    "continent_entries": sql(
        """SELECT coalesce(c.continent, 'Other') AS continent, count(*) AS n_countries,
        sum(s.n)::BIGINT AS n_entries
        FROM site_countries s LEFT JOIN countries c ON s.country = c.country GROUP BY 1""",
        "site_countries",
        "countries",
    ),
    "unmapped_countries": sql(
        f"""SELECT country, n, {_half_even_pct("n", "(SELECT sum(n) FROM site_countries)")} AS pct
        FROM site_countries s
        WHERE NOT EXISTS (SELECT 1 FROM countries c WHERE c.country = s.country)""",
        "site_countries",
        "countries",
    ),
    "clean_pipeline": sql(f"SELECT ingest_pos, {_FLAT} FROM flat", "flat"),
    "split_pipe": sql(
        """SELECT ingest_pos, (i - 1)::INTEGER AS pos, tokens[i] AS token
        FROM (SELECT ingest_pos, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM (
            SELECT ingest_pos,
                [trim(x) for x in string_split(funders, '|') if trim(x) != ''] AS tokens
            FROM raw))""",
        "raw",
    ),
    "surrogate_key": sql("SELECT ingest_pos, nct AS nct_id, study_id FROM flat", "flat"),
    "build_studies": sql("SELECT * FROM studies", "studies"),
    "build_conditions": sql("SELECT * FROM conditions", "conditions"),
    "build_interventions": sql("SELECT * FROM interventions", "interventions"),
    "build_sponsors": sql("SELECT * FROM sponsors", "sponsors"),
    "build_outcomes": sql("SELECT * FROM outcomes", "outcomes"),
    "build_locations": sql("SELECT * FROM locations", "locations"),
    "build_study_design": sql("SELECT * FROM study_design", "study_design"),
    "row_count_audit": _audit(),
    "q1a_phase_distribution": sql(_Q1A, "studies"),
    "q1b_status_distribution": sql(_Q1B, "studies"),
    "q1c_area_distribution": sql(_Q1C, "studies", "areas"),
    "q1d_monthly_timeline": sql(_Q1D, "studies", months=_MONTHS),
    "q2a_completion_by_phase": sql(_Q2A, "studies"),
    "q2b_completion_by_sponsor": sql(_Q2B, "studies", "sponsors"),
    "q2c_completion_by_design": sql(_Q2C, "studies", "study_design"),
    "q2d_stopped_deep_dive": sql(_Q2D, "studies"),
    "q3a_enrollment_distribution": sql(_Q3A, "studies"),
    "q3b_top_conditions": sql(_Q3B, "studies", "conditions"),
    "q4a_continent_counts": sql(_Q4A, "locations"),
    "q4b_specialization_index": sql(_Q4B, "studies", "locations", "areas"),
    "q4m_country_map": sql(
        "SELECT country, count(DISTINCT study_id) AS n_trials FROM locations GROUP BY 1",
        "locations",
    ),
    "q5a_duration_by_phase": sql(_Q5A, "durations"),
    "q5b_duration_by_area": sql(_Q5B, "durations", "areas"),
    "q5c_duration_area_phase": sql(_Q5C, "durations", "areas"),
    "r1b_group_rollup": sql(
        """SELECT status_group, count(*) AS n FROM studies GROUP BY 1
        UNION ALL SELECT NULL, count(*) FROM studies""",
        "studies",
    ),
    "r1d_main_window": sql(
        " UNION ALL ".join(
            f"""SELECT month, strftime(month, '%b %Y') AS month_label, cumulative_total,
            {_s(c)} AS series, {c} AS trials_started, {i}::BIGINT AS series_no FROM q
            WHERE month <= DATE '2021-06-01'"""
            for i, c in enumerate(("completed", "active", "stopped"), start=1)
        ),
        "studies",
        months=_MONTHS,
        q=_Q1D,
    ),
    "r2a_phase_order": sql(
        f"""SELECT p.phase, p.position::INTEGER AS position, q.* EXCLUDE (phase)
        FROM (VALUES {_PHASE_ROWS}) AS p(phase, position) LEFT JOIN q ON q.phase = p.phase""",
        "studies",
        q=_Q2A,
    ),
    "r2a_risk_band": sql(
        """SELECT phase, study_type, total_resolved, completion_rate_pct,
        CASE WHEN completion_rate_pct >= 75 THEN 'Low Risk'
             WHEN completion_rate_pct >= 60 THEN 'Moderate Risk' ELSE 'High Risk' END AS risk_band
        FROM q""",
        "studies",
        q=_Q2A,
    ),
    "r2c_risk_band": sql(
        f"""SELECT *, {_BAND.format(low=80, mid=70)} AS risk_band FROM q
        WHERE design_feature = 'Allocation' UNION ALL
        SELECT *, {_BAND.format(low=75, mid=65)} AS risk_band FROM q
        WHERE design_feature <> 'Allocation'""",
        "studies",
        "study_design",
        q=_Q2C,
    ),
    "r2c_masking_labels": sql(
        """SELECT feature_value, trim(split_part(feature_value, '(', 1)) AS display_label,
        total_resolved, completion_rate_pct
        FROM q WHERE design_feature = 'Masking' AND total_resolved >= 10""",
        "studies",
        "study_design",
        q=_Q2C,
    ),
    "r2d_pivot": sql(
        f"""SELECT s.status, {_MATRIX} FROM (VALUES {_STATUS_ROWS}) AS s(status, position)
        LEFT JOIN q ON q.status = s.status GROUP BY 1""",
        "studies",
        q=_Q2D,
    ),
    "r2d_failure_summary": sql(
        """SELECT status, count(*) AS total_trials FROM studies
        WHERE status_group = 'Stopped' AND phase <> 'Unknown' GROUP BY 1""",
        "studies",
    ),
    "r3a_iqr_spread": sql(
        """SELECT study_type, phase, n_trials, enrollment_median AS median,
        enrollment_median - enrollment_q1 AS spread_down,
        enrollment_q3 - enrollment_median AS spread_up FROM q""",
        "studies",
        q=_Q3A,
    ),
    "r3b_top8": sql(
        """SELECT condition_name, n_trials, total_enrollment,
        CASE WHEN total_enrollment >= 1000000
             THEN printf('%.1fM', total_enrollment / 1e6)
             ELSE printf('%.0fK', total_enrollment / 1e3) END AS label
        FROM q ORDER BY total_enrollment DESC, condition_name LIMIT 8""",
        "studies",
        "conditions",
        q=_Q3B,
    ),
    "r3b_log_weight": sql(
        "SELECT condition_name, round(log10(total_enrollment), 6) AS weight FROM q",
        "studies",
        "conditions",
        q=_Q3B,
    ),
    "r4a_top_continents": sql(
        "SELECT * FROM q ORDER BY trial_count DESC, continent LIMIT 5", "locations", q=_Q4A
    ),
    "r4b_heatmap": sql(
        f"""SELECT continent, {_HEAT} FROM q WHERE continent IN (
            SELECT continent FROM c ORDER BY trial_count DESC, continent LIMIT 10)
        GROUP BY 1""",
        "studies",
        "locations",
        "areas",
        q=_Q4B,
        c=_Q4A,
    ),
    "r5_label_iqr": sql(
        f"""SELECT concat(phase, ' (n=', n_trials, ')') AS y_label,
        {_CLINICAL}::BIGINT - 1 AS position, duration_median AS median, {_IQR}
        FROM q WHERE phase IN {_in(vocab.CLINICAL_PHASES)}""",
        "durations",
        q=_Q5A,
    ),
    "r5_area_label_iqr": sql(
        f"""SELECT concat(therapeutic_area, ' (n=', n_trials, ')') AS y_label,
        duration_median AS median, {_IQR} FROM q""",
        "durations",
        "areas",
        q=_Q5B,
    ),
    "r5c_facets": sql(
        f"SELECT *, {_CLINICAL}::BIGINT - 1 AS position FROM q", "durations", "areas", q=_Q5C
    ),
    "k_resolved_rate": sql(
        f"""SELECT {_DONE} AS completed, count(*) AS total_resolved, {_RATE}
        FROM studies WHERE status_group IN ('Completed', 'Stopped')""",
        "studies",
    ),
    "k_pipeline_outliers": sql(
        """SELECT *, round(phase_median / area_median, 2) AS ratio,
        round(phase_median / area_median, 2) >= 1.5 AS longer_than_expected
        FROM (SELECT c.therapeutic_area, c.phase, c.n_trials, c.duration_median AS phase_median,
              b.duration_median AS area_median
              FROM c JOIN b ON c.therapeutic_area = b.therapeutic_area)""",
        "durations",
        "areas",
        c=_Q5C,
        b=_Q5B,
    ),
    "dq_bounds": sql(
        " UNION ALL ".join(
            [
                _rule("nct_number_missing", "nct IS NULL"),
                _rule("status_not_known", f"status NOT IN {_in(vocab.KNOWN_STATUSES)}"),
                _rule("enrollment_not_a_number", "enrollment IS NOT NULL AND enrolled IS NULL"),
                _rule("enrollment_negative", "enrolled < 0"),
                _rule("start_date_not_a_date", "start_text IS NOT NULL AND start_date IS NULL"),
                _rule("start_date_out_of_range", "start_date < DATE '2000-01-01'"),
                _rule("completion_date_out_of_range", "completion_raw > DATE '2031-04-14'"),
                _rule("completion_before_start", "completion_raw < start_date"),
            ]
        ),
        "grouped",
    ),
    "dq_null_drift": sql(
        f"""SELECT column_name, p.missing_pct AS previous_pct, c.missing_pct AS current_pct,
        round(c.missing_pct - p.missing_pct, 1) AS change_points,
        round(c.missing_pct - p.missing_pct, 1) > 5 AS alert
        FROM ({_missing("raw", _CRITICAL)}) p JOIN ({_missing("flat", _CLEANED)}) c
        USING (column_name)""",
        "raw",
        "flat",
    ),
    "dq_load_drift": sql(
        f"""SELECT *, round(missing_pct - previous_pct, 1) AS change_points,
            coalesce(abs(round(missing_pct - previous_pct, 1)) > 5, false) AS alert
        FROM (SELECT *, lag(missing_pct) OVER (PARTITION BY table_name, column_name ORDER BY load_no) AS previous_pct
            FROM (SELECT study_id % 3 + 1 AS load_no, 'studies' AS table_name, column_name, count(*) AS n_rows,
                count(*) FILTER (v IS NULL) AS missing, {_half_even_pct("count(*) FILTER (v IS NULL)", "count(*)")} AS missing_pct
                FROM ({_cells("studies", STAR_SCHEMAS["studies"].names, completion_date=
                    "CASE WHEN study_id % 3 != 2 OR study_id % 2 != 0 THEN completion_date END")})
                GROUP BY 1, 3 UNION ALL
                SELECT study_id % 3 + 1, 'conditions', column_name, count(*), count(*) FILTER (v IS NULL),
                {_half_even_pct("count(*) FILTER (v IS NULL)", "count(*)")}
                FROM ({_cells("conditions", STAR_SCHEMAS["conditions"].names)}) GROUP BY 1, 3))""",
        "studies",
        "conditions",
    ),
    "dq_freshness": sql(
        """SELECT max(updated) AS newest_update,
        (DATE '2021-04-16' - max(updated))::INTEGER AS age_days,
        DATE '2021-04-16' - max(updated) > 1 AS late FROM grouped""",
        "grouped",
    ),
}

# The same question over stored loads has the same answer.
ORACLE["q4b_merged_loads"] = ORACLE["q4b_specialization_index"]
