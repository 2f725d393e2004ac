"""Fixed vocabularies of the study registry.

Everything in this module is a fixed value: the words, orders and limits the
results depend on. The logic that uses them lives in ``functions`` and
``operators``.
"""

from __future__ import annotations

import datetime as dt

# --- Fixed values: study status -------------------------------------------
STATUS_GROUPS: dict[str, list[str]] = {
    "Active": [
        "Recruiting",
        "Not yet recruiting",
        "Active, not recruiting",
        "Enrolling by invitation",
    ],
    "Completed": ["Completed"],
    "Stopped": ["Withdrawn", "Terminated", "Suspended"],
}
OTHER = "Other"
UNKNOWN = "Unknown"
# Statuses of expanded-access programmes; they belong to no group above.
EXPANDED_ACCESS_STATUSES = [
    "Available",
    "No longer available",
    "Approved for marketing",
    "Temporarily not available",
]
KNOWN_STATUSES = [s for g in STATUS_GROUPS.values() for s in g] + EXPANDED_ACCESS_STATUSES
RESOLVED_GROUPS = ["Completed", "Stopped"]
STOPPED_STATUS_ORDER = ["Withdrawn", "Terminated", "Suspended"]

# --- Fixed values: phases, lowest to highest -------------------------------
PHASE_ORDER = [
    "Early Phase 1",
    "Phase 1",
    "Phase 2",
    "Phase 3",
    "Phase 4",
    "Not Applicable",
]
CLINICAL_PHASES = PHASE_ORDER[:-1]

# --- Fixed values: dates and enrollment -------------------------------------
EXTRACTION_DATE = dt.date(2021, 4, 14)
CUTOFF_BUFFER_YEARS = 10
PRE_COVID_BEFORE = dt.date(2020, 1, 1)
DATE_ERROR_BEFORE = dt.date(2000, 1, 1)
MAIN_WINDOW_END = dt.date(2021, 6, 1)
LARGE_ENROLLMENT = 100_000

# --- Fixed values: columns of the flat file ---------------------------------
CRITICAL_COLUMNS = [
    "Phases",
    "Status",
    "Conditions",
    "Start Date",
    "Funded Bys",
    "Study Type",
    "Study Designs",
    "Enrollment",
    "Locations",
    "Completion Date",
    "Primary Completion Date",
]
STUDY_DATE_COLUMNS = ["Start Date", "Completion Date", "Primary Completion Date"]
POSTED_DATE_COLUMNS = ["Last Update Posted", "First Posted"]

# Whole cells the usual CSV readers of data frames take as missing.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- Fixed values: canonical condition names, first match wins --------------
CONDITION_KEYWORDS: dict[str, list[str]] = {
    "COVID-19": [
        "covid", "sars-cov", "sars cov", "sars cov-2", "coronavirus",
        "corona virus", "2019-ncov", "ncov", "cytokine storm",
        "cytokine release", "anosmia",
    ],
    "Acute Respiratory Distress Syndrome": ["ards", "acute respiratory distress"],
    "Pneumonia": ["pneumonia"],
    "Acute Kidney Injury": ["acute kidney injury", " aki"],
}

# --- Fixed values: therapeutic areas, first match wins ----------------------
AREA_KEYWORDS: dict[str, list[str]] = {
    "Infectious Disease": [
        "covid", "sars", "coronavirus", "2019-ncov", "viral infection",
        "virus disease", "infection viral", "influenza", "sepsis",
        "inflammation", "infection", "hiv", "aids", "inflammatory response",
        "epidemic",
    ],
    "Respiratory/Critical Care": [
        "pneumonia", "respiratory", "ards", "lung", "pulmonary", "hypoxemia",
        "hypoxia", "dyspnea", "asthma", "copd", "mechanical ventilation",
        "critical illness", "cytokine", "post intensive care",
        "intensive care unit",
    ],
    "Mental Health": [
        "anxiety", "depression", "mental", "psychiatric", "ptsd",
        "post traumatic", "stress", "psychological", "social isolation",
        "isolation, social", "loneliness", "depressive", "burnout",
        "wellbeing", "well-being", "sleep", "insomnia",
    ],
    "Metabolic/Cardiovascular": [
        "diabetes", "obesity", "cardiovascular", "heart", "hypertension",
        "thrombosis", "stroke", "vitamin d", "metabolic", "myocardial",
        "myocarditis", "endothelial", "cardiac", "coagulation",
        "thromboembolism",
    ],
    "Oncology": [
        "cancer", "tumor", "oncology", "carcinoma", "lymphoma", "neoplasm",
        "leukemia", "malignant",
    ],
    "Neurological": [
        "multiple sclerosis", "parkinson", "autism", "neurolog", "dementia",
        "alzheimer", "epilepsy", "cognitive impairment", "cognitive",
    ],
    "Renal": ["kidney", "renal", "aki", "acute kidney"],
    "Musculoskeletal/Rheumatology": [
        "arthritis", "rheumatoid", "lupus", "musculoskeletal", "pain",
        "chronic pain", "rheumatic",
    ],
    "Reproductive Health": [
        "pregnancy", "maternal", "obstetric", "neonatal", "perinatal",
        "prenatal",
    ],
}
AREAS = [*AREA_KEYWORDS, OTHER]

# --- Fixed values: study design keys, first match wins ----------------------
DESIGN_KEYS: dict[str, str] = {
    "allocation": "allocation",
    "intervention_model": "intervention model",
    "masking": "masking",
    "primary_purpose": "primary purpose",
    "observational_model": "observational model",
    "time_perspective": "time perspective",
}

# --- Fixed values: countries per continent ----------------------------------
CONTINENT_COUNTRIES: dict[str, list[str]] = {
    "North America": [
        "United States", "Canada", "Mexico", "Puerto Rico", "Costa Rica",
        "Panama", "Dominican Republic", "Honduras", "Guatemala", "Jamaica",
        "Martinique", "Guadeloupe", "Barbados",
    ],
    "South America": [
        "Brazil", "Argentina", "Colombia", "Chile", "Peru", "Ecuador",
        "Bolivia", "Paraguay", "Uruguay", "Venezuela", "French Guiana",
    ],
    "Europe": [
        "France", "Spain", "Italy", "United Kingdom", "Germany", "Belgium",
        "Netherlands", "Denmark", "Poland", "Greece", "Switzerland", "Sweden",
        "Austria", "Ukraine", "Russian Federation", "Norway", "Portugal",
        "Finland", "Hungary", "Romania", "Czechia", "Bulgaria", "Serbia",
        "Croatia", "Slovakia", "Ireland", "Georgia", "Belarus", "Lithuania",
        "Bosnia and Herzegovina", "Latvia", "Slovenia", "Estonia",
        "North Macedonia", "Albania", "Luxembourg", "Monaco", "Iceland",
        "Cyprus", "Malta", "San Marino",
    ],
    "Asia": [
        "China", "Japan", "India", "Turkey", "Israel", "Iran", "South Korea",
        "Saudi Arabia", "Pakistan", "Taiwan", "Singapore", "Indonesia",
        "Hong Kong", "Malaysia", "Philippines", "Bangladesh", "Jordan",
        "Nepal", "United Arab Emirates", "Qatar", "Thailand", "Vietnam",
        "Kuwait", "Iraq", "Lebanon", "Kazakhstan", "Bahrain", "Uzbekistan",
        "Cambodia", "Oman", "Azerbaijan", "Armenia", "Mongolia", "Kyrgyzstan",
        "Lao People's Democratic Republic",
    ],
    "Africa": [
        "Egypt", "South Africa", "Nigeria", "Ethiopia", "Kenya", "Tunisia",
        "Zimbabwe", "Zambia", "Uganda", "Ghana", "Mali", "Malawi",
        "Mozambique", "Burkina Faso", "Senegal", "Cameroon", "Sudan",
        "Guinea-Bissau", "Gambia", "Côte D'Ivoire", "Guinea", "Cape Verde",
        "Algeria", "Botswana", "Tanzania", "South Sudan", "Rwanda", "Lesotho",
        "Mayotte", "Réunion",
    ],
    "Oceania": ["Australia", "New Zealand", "New Caledonia"],
}
CONTINENTS = [*CONTINENT_COUNTRIES, OTHER]
