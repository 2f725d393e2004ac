"""Schemas of the raw flat file and of the seven star tables."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DateType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

RAW_COLUMNS = [
    "NCT Number",
    "Title",
    "Acronym",
    "Status",
    "Conditions",
    "Interventions",
    "Outcome Measures",
    "Sponsor/Collaborators",
    "Gender",
    "Phases",
    "Enrollment",
    "Funded Bys",
    "Study Type",
    "Study Designs",
    "Start Date",
    "Primary Completion Date",
    "Completion Date",
    "First Posted",
    "Last Update Posted",
    "Locations",
]
# Position of a row in its source; the smallest one is the "first" duplicate.
INGEST_POS = "ingest_pos"


def _table(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


_S, _L, _I, _D, _B = StringType(), LongType(), IntegerType(), DateType(), BooleanType()

STAR_SCHEMAS: dict[str, StructType] = {
    "studies": _table(
        study_id=_L,
        nct_id=_S,
        title=_S,
        acronym=_S,
        status=_S,
        status_group=_S,
        phase=_S,
        study_type=_S,
        start_date=_D,
        completion_date=_D,
        primary_completion_date=_D,
        enrollment=_I,
        gender=_S,
        pre_covid_start=_B,
        date_error=_B,
    ),
    "conditions": _table(study_id=_L, condition_name=_S, mesh_term=_S, therapeutic_area=_S),
    "interventions": _table(study_id=_L, intervention_type=_S, name=_S, description=_S),
    "outcomes": _table(study_id=_L, outcome_type=_S, measure=_S, time_frame=_S, description=_S),
    "sponsors": _table(study_id=_L, agency=_S, agency_class=_S, lead_or_collaborator=_S),
    "locations": _table(study_id=_L, facility=_S, city=_S, state=_S, country=_S, continent=_S),
    "study_design": _table(
        study_id=_L,
        allocation=_S,
        intervention_model=_S,
        masking=_S,
        primary_purpose=_S,
        observational_model=_S,
        time_perspective=_S,
    ),
}
