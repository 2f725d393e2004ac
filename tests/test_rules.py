"""Edge cases of the cleaning and classification rules."""

from __future__ import annotations

import datetime as dt

import pytest

from trialbraid import vocab
from trialbraid.functions import rules, text


def test_strip_takes_all_whitespace(evaluate):
    assert evaluate(text.strip("c"), ["\t a b  ", "　x", "", None, "  "]) == [
        "a b",
        "x",
        "",
        None,
        "",
    ]


def test_split_pipe_drops_empty_tokens(evaluate):
    values = ["a| b|", "a||b", " | ", "\ta\t|b", None, "one"]
    expected = [["a", "b"], ["a", "b"], [], ["a", "b"], [], ["one"]]
    assert evaluate(text.split_pipe("c"), values) == expected


@pytest.mark.parametrize(
    "value",
    ["crohn's disease", "covid-19/ARDS", "3rd degree", "état élevé", "ab2c", "UPPER lower", ""],
)
def test_title_case_is_the_one_of_python(evaluate, value):
    assert evaluate(text.title_case("c"), [value]) == [value.title()]


def test_phase_takes_the_highest(evaluate):
    values = [
        None,
        "",
        "Phase 1|Phase 2",
        "Phase 4|Not Applicable",
        "Pilot",
        "Pilot|Phase 1",
        " Phase 2 | Phase 1 ",
        "Pilot|Other label",
        "Early Phase 1|Phase 1",
    ]
    assert evaluate(rules.clean_phase("c"), values) == [
        "Unknown",
        "",
        "Phase 2",
        "Not Applicable",
        "Pilot",
        "Phase 1",
        "Phase 2",
        "Other label",
        "Phase 1",
    ]


def test_status_groups(evaluate):
    groups = evaluate(rules.status_group("c"), [*vocab.KNOWN_STATUSES, "something", None])
    assert groups == ["Active"] * 4 + ["Completed"] + ["Stopped"] * 3 + ["Other"] * 6


def test_dates(evaluate):
    values = ["November 9, 2020", " 2020-11-09 ", "April 2020", "2020-02-30", "soon", "", None]
    day = dt.date(2020, 11, 9)
    assert evaluate(rules.parse_date("c"), values) == [day, day, None, None, None, None, None]
    assert evaluate(rules.parse_date("c", lenient=True), values)[2] == dt.date(2020, 4, 1)


def test_cutoff_keeps_the_last_day(evaluate):
    cutoff = rules.cutoff_after(rules.date_literal(vocab.EXTRACTION_DATE))
    kept = evaluate(rules.keep_until("cast(c AS date)", cutoff), ["2031-04-14", "2031-04-15", None])
    assert kept == [dt.date(2031, 4, 14), None, None]


def test_date_flags_are_false_without_a_start(evaluate):
    flag = rules.starts_before("cast(c AS date)", vocab.PRE_COVID_BEFORE)
    assert evaluate(flag, ["2019-12-31", "2020-01-01", None]) == [True, False, False]


def test_enrollment(evaluate):
    values = ["0", "170", "n/a", None, "20000000", " 12.5 ", "1e3", "170d", "NaN", "Infinity", "-3"]
    expected = [0.0, 170.0, None, None, 2e7, 12.5, 1000.0, None, None, None, -3.0]
    assert evaluate(rules.enrollment_number("c"), values) == expected


def test_null_tokens_are_whole_cells(evaluate):
    assert evaluate(rules.nullify_tokens("c"), ["NA", "N/A", "", "NAN", "na", "None x"]) == [
        None,
        None,
        None,
        "NAN",
        "na",
        "None x",
    ]


def test_expanded_access_keeps_missing_types(evaluate):
    flag = rules.is_expanded_access("c")
    assert evaluate(flag, ["Expanded Access: X", "Interventional", None]) == [True, False, False]


CONDITIONS = {
    "SARS-CoV 2": ("COVID-19", "Infectious Disease"),
    "Cytokine Storm": ("COVID-19", "Infectious Disease"),
    "Hearing Aids": ("Hearing Aids", "Infectious Disease"),
    "Standards of Care": ("Acute Respiratory Distress Syndrome", "Respiratory/Critical Care"),
    "Pneumonia, Viral": ("Pneumonia", "Respiratory/Critical Care"),
    "AKI": ("Aki", "Renal"),
    "Post AKI": ("Acute Kidney Injury", "Renal"),
    "Speaking Ability": ("Speaking Ability", "Renal"),
    "Travel in Spain": ("Travel In Spain", "Musculoskeletal/Rheumatology"),
    "Stress, Psychological": ("Stress, Psychological", "Mental Health"),
    "Septic Shock": ("Septic Shock", "Other"),
    "crohn's disease": ("Crohn'S Disease", "Other"),
    "Maternal stroke": ("Maternal Stroke", "Metabolic/Cardiovascular"),
    "": ("", "Other"),
}


def test_condition_names_and_areas(spark):
    df = spark.createDataFrame([(c,) for c in CONDITIONS], "condition string")
    rows = rules.classify_conditions(df, "condition").collect()
    assert {r.condition: (r.condition_name, r.therapeutic_area) for r in rows} == CONDITIONS


def test_each_condition_keyword_alone_hits_its_name(spark):
    words = [(w.strip(), name) for name, ws in vocab.CONDITION_KEYWORDS.items() for w in ws]
    df = spark.createDataFrame([("x " + w, name) for w, name in words], "condition string, n string")
    wrong = rules.classify_conditions(df, "condition").filter("condition_name != n").collect()
    assert wrong == []


def test_continents(evaluate):
    countries = [
        "France",
        "Côte D'Ivoire",
        "Lao People's Democratic Republic",
        "Barbados",
        "Republic of",
        "france",
    ]
    assert evaluate(rules.continent("c"), countries) == [
        "Europe",
        "Africa",
        "Asia",
        "North America",
        "Other",
        "Other",
    ]
    sizes = {c: len(names) for c, names in vocab.CONTINENT_COUNTRIES.items()}
    assert sizes == {
        "North America": 13,
        "South America": 11,
        "Europe": 41,
        "Asia": 35,
        "Africa": 30,
        "Oceania": 3,
    }


def test_last_comma_part(evaluate):
    values = ["France", "A, B, France ", "H, Seoul, Korea, Republic of", "a,"]
    expected = ["France", "France", "Republic of", ""]
    assert evaluate(text.last_comma_part("c"), values) == expected


def test_interventions_split_at_the_first_colon(evaluate):
    values = ["Drug: X", "Device: CPAP: full mask", "Telemedicine", "Drug :  Y"]
    assert evaluate(rules.intervention_type("c"), values) == ["Drug", "Device", "Other", "Drug"]
    names = ["X", "CPAP: full mask", "Telemedicine", "Y"]
    assert evaluate(rules.intervention_name("c"), values) == names


def test_study_design_slots(evaluate):
    def slot(name, values):
        return evaluate(rules.design_value(rules.design_pairs("c"), name), values)

    values = [
        "Allocation: Randomized|Masking: None (Open Label)",
        "Masking: Double|masking : Triple",
        "no colon masking",
        "Allocation and masking: both",
        "Time Perspective:",
        None,
    ]
    assert slot("allocation", values) == ["Randomized", None, None, "both", None, None]
    assert slot("masking", values) == ["None (Open Label)", "Triple", None, None, None, None]
    assert slot("time_perspective", values) == [None, None, None, None, "", None]


def test_study_keys(evaluate):
    values = ["NCT00000123", "NCT123456789012", "ISRCTN123", "NCT1", "NCT012345678", None]
    keys = evaluate(rules.study_key("c"), values)
    assert keys[:2] == [123, 123456789012]
    assert all(k < 0 for k in keys[2:5]) and len(set(keys[:5])) == 5
    assert keys[5] is None


AGES = [
    ("2020-03-17", "2020-03-17", 0),
    ("2020-04-29", "2020-01-17", 12),
    ("2020-03-30", "2020-01-31", 30),
    ("2020-03-01", "2020-02-29", 1),
    ("2021-03-01", "2021-01-31", 1),
    ("2020-01-17", "2020-04-29", -12),
    ("2020-01-31", "2020-03-01", -1),
]


@pytest.mark.parametrize(("end", "start", "days"), AGES)
def test_age_days_is_the_day_part(spark, con, end, start, days):
    expression = rules.age_days(f"DATE '{end}'", f"DATE '{start}'")
    assert spark.sql(f"SELECT {expression} AS d").first().d == days
    age = f"SELECT date_part('day', age(DATE '{end}', DATE '{start}'))"
    assert con.execute(age).fetchone() == (days,)


def test_age_days_on_random_pairs(spark, con):
    import random

    rng, base = random.Random(7), dt.date(2019, 1, 1)
    pairs = [
        (base + dt.timedelta(rng.randrange(900)), base + dt.timedelta(rng.randrange(900)))
        for _ in range(400)
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a date, b date")
    ours = [r.d for r in df.selectExpr("i", f"{rules.age_days('a', 'b')} AS d").orderBy("i").collect()]
    theirs = [
        con.execute("SELECT date_part('day', age(?::DATE, ?::DATE))", list(p)).fetchone()[0]
        for p in pairs
    ]
    assert ours == theirs
