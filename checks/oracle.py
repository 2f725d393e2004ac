"""Plain SQL for every query, written apart from the Spark code for DuckDB.

The texts share only word lists with the library. They state each result the
short way (windows, correlated lists, quantile aggregates), use exact integer
arithmetic for percentages and read the same tables.
"""

from __future__ import annotations

from trialbraid import vocab
from trialbraid.sources import adapter as words


def _s(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_s(v) for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(_s(v) for v in values) + ")"


def _at(values, index: str) -> str:
    return f"({_list(values)})[1 + ({index})]"


def _text_of(day: str) -> str:
    return (
        f"CASE WHEN k % 97 = 13 THEN strftime({day}, '%B %Y') "
        f"WHEN k % 4 = 1 THEN strftime({day}, '%B %-d, %Y') ELSE strftime({day}, '%Y-%m-%d') END"
    )


def _any(column: str, keywords) -> str:
    return f"regexp_matches({column}, {_s('|'.join(k.replace('.', '[.]') for k in keywords))})"


def _first_hit(column: str, table, otherwise: str) -> str:
    whens = " ".join(f"WHEN {_any(column, w)} THEN {_s(label)}" for label, w in table.items())
    return f"CASE {whens} ELSE {otherwise} END"


def _day(column: str) -> str:
    return (
        f"coalesce(try_strptime({column}, '%Y-%m-%d'), try_strptime({column}, '%B %d, %Y'))::DATE"
    )


def _half_up(part: str, whole: str, scale: int = 10, factor: str = "100") -> str:
    """round(factor * part / whole) half up at 1 / scale, in integers."""
    top = f"(2 * {factor}::HUGEINT * {scale} * ({part})::HUGEINT + ({whole})::HUGEINT)"
    return f"(({top} // (2 * ({whole})::HUGEINT))::DOUBLE / {scale})"


def _half_even_pct(part: str, whole: str) -> str:
    return f"round_even(100.0::DOUBLE * ({part}) / ({whole}), 1)"


_A, _B, _C = "CASE WHEN k % 3 = 1 THEN 0 ELSE k % 40 END", "(k * 7 + 3) % 40", "(k * 11 + 5) % 40"
_TERM = {i: _at(words.CONDITION_TERMS, i) for i in (_A, _B, _C)}
_SITE = [_at(words.LOCATION_TERMS, i) for i in ("k % 11", "(k * 5 + 2) % 11")]
_OUT = [_at(words.OUTCOME_TERMS, i) for i in ("k % 7", "(k * 3 + 1) % 7")]
_CELLS = {
    "nct": """CASE WHEN k % 1361 = 9 THEN NULL
        ELSE 'NCT' || CASE WHEN length(n) < 8 THEN lpad(n, 8, '0') ELSE n END END""",
    "title": f"replace({_at(words.TITLES, 'k % 3')}, '{{}}', {_TERM[_A]})",
    "acronym": _at(words.ACRONYMS, "k % 4"),
    "status": "st",
    "conditions": f"""CASE k % 3 WHEN 0 THEN {_TERM[_A]}
        WHEN 1 THEN concat({_TERM[_A]}, '| ', {_TERM[_B]})
        ELSE concat({_TERM[_A]}, '| ', {_TERM[_B]}, '|', {_TERM[_C]},
            CASE WHEN k % 7 = 3 THEN ' variant ' || k END, '|') END""",
    "interventions": f"""concat({_at(words.INTERVENTION_FIRST, "k % 5")},
        CASE WHEN k % 2 = 1 THEN '|' || {_at(words.INTERVENTION_SECOND, "(k + 1) % 5")} END)""",
    "outcomes": f"""CASE WHEN k % 19 = 4 THEN NULL WHEN k % 2 = 0 THEN {_OUT[0]}
        ELSE concat({_OUT[0]}, '|', {_OUT[1]}) END""",
    "sponsors": """concat(c_name, CASE k % 3 WHEN 1 THEN '|Univ. of X'
        WHEN 2 THEN '| WHO|Univ. of X|' END)""",
    "gender": _at(words.GENDERS, "k % 4"),
    "phases": f"CASE WHEN k % 3 = 0 THEN NULL ELSE {_at(words.PHASE_LISTS, 'k % 11')} END",
    "enrollment": """CASE WHEN k % 1361 = 10 THEN '3000000000' WHEN k % 1009 = 7 THEN NULL WHEN k % 1009 = 8 THEN 'approx. 200'
        WHEN st = 'Withdrawn' THEN '0' ELSE floor(o_totalprice / 100)::BIGINT::VARCHAR END""",
    "funders": _at(words.FUNDER_LISTS, "k % 5"),
    "study_type": """CASE WHEN k % 170 = 0 THEN 'Expanded Access: Treatment IND'
        WHEN k % 997 = 5 THEN NULL WHEN k % 3 = 0 THEN 'Observational'
        ELSE 'Interventional' END""",
    "designs": f"""CASE WHEN k % 170 = 0 THEN NULL
        WHEN k % 3 = 0 THEN concat('Observational Model: ',
            {_at(words.OBSERVATIONAL_MODELS, "k // 3 % 3")}, '|Time Perspective: ',
            {_at(words.PERSPECTIVES, "k // 9 % 3")})
        ELSE concat('Allocation: ', {_at(words.ALLOCATIONS, "k % 3 - 1 + k % 2")},
            '|Intervention Model: ', {_at(words.MODELS, "k // 5 % 4")},
            '|Masking: ', {_at(words.MASKINGS, "k // 7 % 4")},
            '|Primary Purpose: ', {_at(words.PURPOSES, "k // 11 % 5")},
            CASE WHEN k % 101 = 0 THEN '|Masking: Triple' END) END""",
    "start_text": f"""CASE WHEN k % 12 = 5 THEN NULL WHEN k % 1000 = 1 THEN '1998-01-01'
        ELSE {_text_of("day")} END""",
    "primary_text": f"""CASE WHEN k % 1500 = 3 THEN '2099-12-31'
        WHEN o_orderstatus = 'O' AND k % 2 = 0 THEN NULL ELSE {_text_of("done - 30")} END""",
    "completion_text": f"""CASE WHEN k % 500 = 3 THEN '2099-12-31'
        WHEN o_orderstatus = 'O' AND k % 2 = 0 THEN NULL ELSE {_text_of("done")} END""",
    "first_posted_text": _text_of("day - 10"),
    "updated_text": "strftime(DATE '2021-04-14' - (k % 60)::INT, '%Y-%m-%d')",
    "locations": f"""CASE WHEN k % 10 = 9 THEN NULL
        ELSE concat({_SITE[0]}, CASE WHEN k % 3 > 0 THEN '|' || {_SITE[1]} END,
            CASE WHEN k % 3 = 2 THEN '| ' || {_SITE[0]} END) END""",
}

_TOKENS = "list_transform(string_split(phases, '|'), lambda x: trim(x))"
_HIGHEST = " ".join(
    f"WHEN list_contains({_TOKENS}, {_s(p)}) THEN {_s(p)}" for p in reversed(vocab.PHASE_ORDER)
)
_GROUP = " ".join(
    f"WHEN status IN {_in(members)} THEN {_s(g)}" for g, members in vocab.STATUS_GROUPS.items()
)
_RUNS = r"regexp_extract_all(item, '\p{L}+|\P{L}+')"
_TITLE = (
    f"array_to_string(list_transform({_RUNS}, lambda r: upper(r[1]) || lower(r[2:])), '')"
)
_COUNTRIES = ", ".join(
    f"({_s(country)}, {_s(continent)})"
    for continent, countries in vocab.CONTINENT_COUNTRIES.items()
    for country in countries
)


def _slot(key: str) -> str:
    part = (
        "list_filter(string_split(designs, '|'), lambda p: contains(p, ':') "
        f"AND contains(lower(split_part(p, ':', 1)), {_s(key)}))[-1]"
    )
    return f"trim(substr({part}, strpos({part}, ':') + 1))"


def _items(column: str) -> str:
    return f"""SELECT study_id, trim(t) AS item FROM
        (SELECT study_id, unnest(string_split({column}, '|')) AS t FROM accepted) WHERE trim(t) != ''"""


# Name -> text. Each may use the names before it; unused ones cost nothing.
_WITH = {
    "base": f"""SELECT *, o_orderkey AS k, o_orderdate::DATE + 8766 AS day,
            o_orderdate::DATE + 8766 + (o_orderkey * 37 % 400 - 20)::INT AS done,
            (CASE WHEN o_orderkey % 750 = 11 THEN o_orderkey - 1 WHEN o_orderkey % 10 = 7 THEN 7
                ELSE o_orderkey END)::VARCHAR AS n,
            CASE WHEN o_orderkey % 170 = 0
                 THEN {_at(vocab.EXPANDED_ACCESS_STATUSES, "o_orderkey // 170 % 4")}
                 WHEN o_orderstatus = 'F' THEN 'Completed'
                 WHEN o_orderstatus = 'O'
                 THEN {_at(vocab.STATUS_GROUPS["Active"], "o_orderkey % 4")}
                 ELSE {_at(words.STOPPED_STATUSES, "o_orderkey % 5")} END AS st
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
    "raw": "SELECT k AS ingest_pos, "
    + ", ".join(f"{expr} AS {name}" for name, expr in _CELLS.items())
    + " FROM base",
    "grouped": f"""SELECT *, CASE {_GROUP} ELSE 'Other' END AS status_group,
        CASE WHEN phases IS NULL THEN 'Unknown' {_HIGHEST} ELSE {_TOKENS}[-1] END AS phase_clean,
        try_cast(enrollment AS DOUBLE) AS enrolled,
        {_day("start_text")} AS start_date, {_day("completion_text")} AS completion_raw,
        {_day("primary_text")} AS primary_raw, {_day("updated_text")} AS updated
        FROM raw""",
    "kept": """SELECT * FROM grouped
        WHERE study_type IS NULL OR study_type NOT LIKE '%Expanded%'""",
    "flat": """SELECT *, substr(nct, 4)::BIGINT AS study_id,
        CASE WHEN completion_raw > DATE '2031-04-14' THEN NULL ELSE completion_raw END
            AS completion_date,
        CASE WHEN primary_raw > DATE '2031-04-14' THEN NULL ELSE primary_raw END
            AS primary_completion_date,
        start_date IS NOT NULL AND start_date < DATE '2020-01-01' AS pre_covid_start,
        start_date IS NOT NULL AND start_date < DATE '2000-01-01' AS date_error
        FROM kept""",
    "accepted": """SELECT * FROM flat
        WHERE nct IS NOT NULL AND (enrolled IS NULL OR abs(enrolled) <= 2147483647)""",
    "studies": """SELECT study_id, nct AS nct_id, title, acronym, status, status_group,
        phase_clean AS phase, study_type, start_date, completion_date, primary_completion_date,
        round_even(enrolled, 0)::INTEGER AS enrollment, gender, pre_covid_start, date_error
        FROM accepted QUALIFY row_number() OVER (PARTITION BY nct ORDER BY ingest_pos) = 1""",
    "named": f"""SELECT study_id, {_first_hit("lower(item)", vocab.CONDITION_KEYWORDS, _TITLE)}
        AS condition_name FROM ({_items("conditions")})""",
    "conditions": f"""SELECT study_id, condition_name, NULL::VARCHAR AS mesh_term,
        {_first_hit("lower(condition_name)", vocab.AREA_KEYWORDS, "'Other'")} AS therapeutic_area
        FROM named""",
    "interventions": f"""SELECT study_id,
        CASE WHEN item LIKE '%:%' THEN trim(split_part(item, ':', 1)) ELSE 'Other' END
            AS intervention_type,
        trim(substr(item, strpos(item, ':') + 1)) AS name, NULL::VARCHAR AS description
        FROM ({_items("interventions")})""",
    "outcomes": f"""SELECT study_id, NULL::VARCHAR AS outcome_type, item AS measure,
        NULL::VARCHAR AS time_frame, NULL::VARCHAR AS description
        FROM ({_items("outcomes")})""",
    "sponsors": """SELECT study_id, agencies[i] AS agency, classes[i] AS agency_class,
        CASE WHEN i = 1 THEN 'Lead' ELSE 'Collaborator' END AS lead_or_collaborator
        FROM (SELECT *, unnest(range(1, len(agencies) + 1)) AS i FROM (
            SELECT study_id,
                [trim(x) for x in string_split(sponsors, '|') if trim(x) != ''] AS agencies,
                [trim(x) for x in string_split(funders, '|') if trim(x) != ''] AS classes
            FROM accepted))""",
    "countries": f"SELECT * FROM (VALUES {_COUNTRIES}) AS v(country, continent)",
    "locations": f"""SELECT study_id, NULL::VARCHAR AS facility, NULL::VARCHAR AS city,
        NULL::VARCHAR AS state, l.country, coalesce(continent, 'Other') AS continent
        FROM (SELECT study_id, trim(string_split(item, ',')[-1]) AS country
              FROM ({_items("locations")})) l
        LEFT JOIN countries USING (country)""",
    "study_design": "SELECT study_id, "
    + ", ".join(f"{_slot(key)} AS {name}" for name, key in vocab.DESIGN_KEYS.items())
    + " FROM accepted",
    "entries": """SELECT ingest_pos, trim(t) AS condition
        FROM (SELECT ingest_pos, unnest(string_split(conditions, '|')) AS t FROM kept)""",
    "classified": f"""SELECT condition, condition_name,
        {_first_hit("lower(condition_name)", vocab.AREA_KEYWORDS, "'Other'")} AS therapeutic_area
        FROM (SELECT item AS condition,
              {_first_hit("lower(item)", vocab.CONDITION_KEYWORDS, _TITLE)} AS condition_name
              FROM (SELECT condition AS item FROM entries))""",
    "sites": """SELECT ingest_pos, i, trim(parts[i]) AS location FROM (
            SELECT ingest_pos, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
                SELECT ingest_pos, string_split(locations, '|') AS parts
                FROM kept WHERE locations IS NOT NULL))""",
    "site_countries": """SELECT trim(string_split(location, ',')[-1]) AS country, count(*) AS n
        FROM sites GROUP BY 1""",
    "durations": """SELECT study_id, phase, completion_date - start_date AS d FROM studies
        WHERE status_group = 'Completed' AND NOT pre_covid_start AND NOT date_error
          AND completion_date >= start_date""",
    "areas": "SELECT DISTINCT study_id, therapeutic_area FROM conditions",
}

_DEPENDS = {
    "base": [],
    "raw": ["base"],
    "grouped": ["raw"],
    "kept": ["grouped"],
    "flat": ["kept"],
    "accepted": ["flat"],
    "studies": ["accepted"],
    "named": ["accepted"],
    "conditions": ["named"],
    "interventions": ["accepted"],
    "outcomes": ["accepted"],
    "sponsors": ["accepted"],
    "countries": [],
    "locations": ["accepted", "countries"],
    "study_design": ["accepted"],
    "entries": ["kept"],
    "classified": ["entries"],
    "sites": ["kept"],
    "site_countries": ["sites"],
    "durations": ["studies"],
    "areas": ["conditions"],
}


def sql(body: str, *needs: str, **extra: str) -> str:
    """``body`` with the shared definitions it needs and its own ones."""
    wanted: set[str] = set()
    queue = list(needs)
    while queue:
        step = queue.pop()
        wanted.add(step)
        queue.extend(_DEPENDS[step])
    parts = [f"{step} AS ({text})" for step, text in _WITH.items() if step in wanted]
    parts += [f"{step} AS ({text})" for step, text in extra.items()]
    return f"WITH {', '.join(parts)} {body}"
