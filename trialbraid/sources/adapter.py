"""Registry adapter: a raw study registry derived from order tables.

One order gives one registry row in the raw shape (text cells, pipe lists,
spelling variants, bad dates, unparseable numbers, missing cells, repeated
registrations). The derivation is row by row, so it is a pure projection of
the scan: Catalyst prunes whatever a query does not use, down to the parquet
columns. Only the sponsor names need a second table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from trialbraid import vocab
from trialbraid.functions import rules
from trialbraid.functions.text import word_list
from trialbraid.schema import INGEST_POS, RAW_COLUMNS

# Columns read of the source tables; a given schema saves the inference job.
ORDERS = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz"
)
CUSTOMERS = "c_custkey bigint, c_name string"

# --- Fixed values of the derived registry ------------------------------------
CONDITION_TERMS = [
    "Covid19", "COVID-19", "SARS-CoV 2", "Corona Virus Infection", "Cytokine Storm",
    "Anosmia", "ARDS", "Acute Respiratory Distress Syndrome", "Pneumonia, Viral",
    "Acute Kidney Injury", "Post AKI", "AKI", "crohn's disease", "Hearing Aids",
    "Standards of Care", "Speaking Ability", "Stress, Psychological", "Septic Shock",
    "Quality of Life", "3rd degree burn", "Sepsis", "Influenza, Human", "Hypoxemia",
    "COPD", "Anxiety Disorder", "insomnia", "Diabetes Mellitus, Type 2", "Heart Failure",
    "Thromboembolism", "Breast Cancer", "LYMPHOMA", "Multiple Sclerosis",
    "alzheimer disease", "Chronic kidney disease", "Rheumatoid arthritis", "Travel in Spain",
    "Pregnancy Related", "Neonatal Care", "covid-19/ARDS overlap", "Healthy volunteers",
]
INTERVENTION_FIRST = [
    "Drug: Remdesivir", "Device: CPAP: full mask", "Behavioral: Exercise",
    "Biological: Convalescent plasma", "Telemedicine",
]
INTERVENTION_SECOND = [
    "Drug: Placebo", "Other: Survey", "Procedure : Prone position",
    "Dietary Supplement: Vitamin D", "Diagnostic Test: PCR",
]
OUTCOME_TERMS = [
    "Mortality at 28 days", "Length of stay", "Viral load", "Adverse events",
    "Quality of life", "Oxygen saturation", "Time to recovery",
]
FUNDER_LISTS = ["Industry|Other", "NIH", "U.S. Fed|NIH", "Other", "Other||Industry"]
LOCATION_TERMS = [
    "General Hospital, Paris, France", "Mayo Clinic, Rochester, Minnesota, United States",
    "University Hospital, Seoul, Korea, Republic of", "Wuhan Hospital, Wuhan, Hubei, China",
    "Hospital das Clinicas, Sao Paulo, SP, Brazil", "Kasr Al Ainy, Cairo, Egypt",
    "Clinic A, Ward 3, Madrid, Comunidad de Madrid, Spain", "CHU, Abidjan, Côte D'Ivoire",
    "Royal Hospital, Melbourne, Victoria, Australia",
    "Mahosot, Vientiane, Lao People's Democratic Republic",
    "Tehran Heart Center, Tehran, Iran, Islamic Republic of",
]
ALLOCATIONS = ["Randomized", "Non-Randomized", "N/A"]
MODELS = [
    "Parallel Assignment", "Single Group Assignment", "Crossover Assignment",
    "Sequential Assignment",
]
MASKINGS = [
    "None (Open Label)", "Single (Participant)", "Double (Participant, Investigator)",
    "Quadruple (Participant, Care Provider, Investigator, Outcomes Assessor)",
]
PURPOSES = ["Treatment", "Prevention", "Diagnostic", "Supportive Care", "Health Services Research"]
OBSERVATIONAL_MODELS = ["Cohort", "Case-Control", "Case-Only"]
PERSPECTIVES = ["Prospective", "Retrospective", "Cross-Sectional"]
PHASE_LISTS = [
    "Early Phase 1", "Phase 1", "Phase 1|Phase 2", "Phase 2", "Phase 2", "Phase 2 | Phase 3",
    "Phase 3", "Phase 4", "Not Applicable", "Not Applicable", None,
]
ACTIVE_STATUSES = vocab.STATUS_GROUPS["Active"]
STOPPED_STATUSES = ["Withdrawn", "Withdrawn", "Terminated", "Terminated", "Suspended"]
TITLES = ["A trial of {}", "Registry of {}", "Follow-up after {}"]
ACRONYMS = ["RECOVER", "SOLID", "ACTT", None]
GENDERS = ["All", "Female", "Male", None]


def _pick(values: Sequence[str | None], index: str) -> str:
    """Value at a 0-based position of a fixed list (folded to one literal)."""
    return f"element_at(array({word_list(values)}), cast({index} AS int) + 1)"


def _day_text(day: str) -> str:
    """A date as text: ISO, the long form, or (rarely) a month without a day."""
    return (
        f"CASE WHEN k % 97 = 13 THEN date_format({day}, 'MMMM yyyy') "
        f"WHEN k % 4 = 1 THEN date_format({day}, 'MMMM d, yyyy') "
        f"ELSE date_format({day}, 'yyyy-MM-dd') END"
    )


def _derivations() -> dict[str, str]:
    # A third of the rows is on one condition; some have a text of their own.
    first = _pick(CONDITION_TERMS, "CASE WHEN k % 3 = 1 THEN 0 ELSE k % 40 END")
    second = _pick(CONDITION_TERMS, "(k * 7 + 3) % 40")
    third = _pick(CONDITION_TERMS, "(k * 11 + 5) % 40")
    sites = [_pick(LOCATION_TERMS, i) for i in ("k % 11", "(k * 5 + 2) % 11", "k % 11")]
    outcomes = [_pick(OUTCOME_TERMS, i) for i in ("k % 7", "(k * 3 + 1) % 7")]
    design = " || ".join(
        [
            "'Allocation: '",
            _pick(ALLOCATIONS, "k % 3 - 1 + k % 2"),
            "'|Intervention Model: '",
            _pick(MODELS, "k div 5 % 4"),
            "'|Masking: '",
            _pick(MASKINGS, "k div 7 % 4"),
            "'|Primary Purpose: '",
            _pick(PURPOSES, "k div 11 % 5"),
            "if(k % 101 = 0, '|Masking: Triple', '')",
        ]
    )
    observation = " || ".join(
        [
            "'Observational Model: '",
            _pick(OBSERVATIONAL_MODELS, "k div 3 % 3"),
            "'|Time Perspective: '",
            _pick(PERSPECTIVES, "k div 9 % 3"),
        ]
    )
    return {
        # Every 750th row registers the study before it a second time, every tenth row one
        # and the same study; some rows have no number or an impossible enrollment.
        "NCT Number": "CASE WHEN k % 1361 != 9 THEN 'NCT' || lpad(n, greatest(8, length(n)), '0') END",
        "Title": f"replace({_pick(TITLES, 'k % 3')}, '{{}}', {first})",
        "Acronym": _pick(ACRONYMS, "k % 4"),
        "Status": "st",
        "Conditions": f"""CASE WHEN k % 3 = 0 THEN {first}
            WHEN k % 3 = 1 THEN {first} || '| ' || {second}
            ELSE {first} || '| ' || {second} || '|' || {third}
                || if(k % 7 = 3, ' variant ' || k, '') || '|' END""",
        "Interventions": f"""{_pick(INTERVENTION_FIRST, "k % 5")}
            || if(k % 2 = 0, '', '|' || {_pick(INTERVENTION_SECOND, "(k + 1) % 5")})""",
        "Outcome Measures": f"""CASE WHEN k % 19 = 4 THEN NULL
            WHEN k % 2 = 0 THEN {outcomes[0]}
            ELSE {outcomes[0]} || '|' || {outcomes[1]} END""",
        "Sponsor/Collaborators": """c_name || CASE WHEN k % 3 = 0 THEN ''
            WHEN k % 3 = 1 THEN '|Univ. of X' ELSE '| WHO|Univ. of X|' END""",
        "Gender": _pick(GENDERS, "k % 4"),
        "Phases": f"CASE WHEN k % 3 != 0 THEN {_pick(PHASE_LISTS, 'k % 11')} END",
        "Enrollment": """CASE WHEN k % 1361 = 10 THEN '3000000000'
            WHEN k % 1009 = 7 THEN 'n/a'
            WHEN k % 1009 = 8 THEN 'approx. 200'
            WHEN st = 'Withdrawn' THEN '0'
            ELSE cast(floor(price / 100) AS string) END""",
        "Funded Bys": _pick(FUNDER_LISTS, "k % 5"),
        "Study Type": """CASE WHEN k % 170 = 0 THEN 'Expanded Access: Treatment IND'
            WHEN k % 997 = 5 THEN NULL
            WHEN k % 3 = 0 THEN 'Observational' ELSE 'Interventional' END""",
        "Study Designs": f"""CASE WHEN k % 170 = 0 THEN NULL
            WHEN k % 3 = 0 THEN {observation} ELSE {design} END""",
        "Start Date": f"""CASE WHEN k % 12 = 5 THEN NULL
            WHEN k % 1000 = 1 THEN '1998-01-01' ELSE {_day_text("day")} END""",
        "Primary Completion Date": f"""CASE WHEN k % 1500 = 3 THEN '2099-12-31'
            WHEN os = 'O' AND k % 2 = 0 THEN NULL
            ELSE {_day_text("date_sub(completion, 30)")} END""",
        "Completion Date": f"""CASE WHEN k % 500 = 3 THEN '2099-12-31'
            WHEN os = 'O' AND k % 2 = 0 THEN NULL ELSE {_day_text("completion")} END""",
        "First Posted": _day_text("date_sub(day, 10)"),
        "Last Update Posted": "cast(date_sub(DATE '2021-04-14', cast(k % 60 AS int)) AS string)",
        "Locations": f"""CASE WHEN k % 10 = 9 THEN NULL
            WHEN k % 3 = 0 THEN {sites[0]}
            WHEN k % 3 = 1 THEN {sites[0]} || '|' || {sites[1]}
            ELSE {sites[0]} || '|' || {sites[1]} || '| ' || {sites[2]} END""",
    }


def raw_registry(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] = RAW_COLUMNS
) -> DataFrame:
    """The raw registry over the order tables of ``sf_dir``.

    Only a request for the sponsor column joins the customers. That join is
    left to the optimizer: a measured small side is broadcast, any other size
    is a sort-merge join whose hot customers AQE splits.
    """
    orders = spark.read.schema(ORDERS).parquet(f"{sf_dir}/orders.parquet")
    base = [
        "o_orderkey AS k",
        "o_orderstatus AS os",
        "o_totalprice AS price",
        "date_add(cast(o_orderdate AS date), 8766) AS day",
        """cast(CASE WHEN o_orderkey % 750 = 11 THEN o_orderkey - 1 WHEN o_orderkey % 10 = 7 THEN 7
            ELSE o_orderkey END AS string) AS n""",
    ]
    if "Sponsor/Collaborators" in columns:
        customers = spark.read.schema(CUSTOMERS).parquet(f"{sf_dir}/customer.parquet")
        orders = orders.join(customers, orders.o_custkey == customers.c_custkey, "left")
        base.append("c_name")
    derived = _derivations()
    derived["Enrollment"] = rules.nullify_tokens(f"({derived['Enrollment']})")
    steps = [
        "date_add(day, cast(k * 37 % 400 - 20 AS int)) AS completion",
        f"""CASE WHEN k % 170 = 0 THEN {_pick(vocab.EXPANDED_ACCESS_STATUSES, "k div 170 % 4")}
            WHEN os = 'F' THEN 'Completed'
            WHEN os = 'O' THEN {_pick(vocab.STATUS_GROUPS["Active"], "k % 4")}
            ELSE {_pick(STOPPED_STATUSES, "k % 5")} END AS st""",
    ]
    cells = orders.selectExpr(*base).selectExpr("*", *steps)
    return cells.selectExpr(f"k AS {INGEST_POS}", *[f"{derived[c]} AS `{c}`" for c in columns])
