"""The seven-table star: builders over the clean flat file."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialbraid import vocab
from trialbraid.functions import rules, stats, text
from trialbraid.operators.cleaning import IN_STAR
from trialbraid.schema import INGEST_POS, STAR_SCHEMAS

_STUDY_COLUMNS = {
    "nct_id": "NCT Number",
    "title": "Title",
    "acronym": "Acronym",
    "status": "Status",
    "status_group": "status_group",
    "phase": "phase_clean",
    "study_type": "Study Type",
    "start_date": "Start Date",
    "completion_date": "Completion Date",
    "primary_completion_date": "Primary Completion Date",
    "enrollment": "Enrollment",
    "gender": "Gender",
    "pre_covid_start": "pre_covid_start",
    "date_error": "date_error",
}


#: Why a row of the flat file has no place in the star.
REJECTS = {
    "no registry number": "`NCT Number` IS NULL",
    "enrollment out of range": rules.beyond_integer("Enrollment"),
}


def accepted(flat: DataFrame) -> DataFrame:
    """The rows that the star takes; :func:`rejected_rows` counts the others.

    The clean file says so in one flag, so a builder need not read what decides it.
    """
    if IN_STAR in flat.columns:
        return flat.filter(IN_STAR)
    return flat.filter(f"NOT ({' OR '.join(f'({e})' for e in REJECTS.values())})")


def rejected_rows(flat: DataFrame) -> DataFrame:
    """(reason, n_rows): rows left out of the star, by the first reason that holds."""
    cases = " ".join(f"WHEN {e} THEN '{reason}'" for reason, e in REJECTS.items())
    counts = flat.selectExpr(f"CASE {cases} END AS reason").filter("reason IS NOT NULL")
    return counts.groupBy("reason").agg(F.count("*").alias("n_rows"))


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns in the order and types of the table; absent ones are NULL."""
    present = set(df.columns)
    return df.selectExpr(
        *[
            f"cast({f.name if f.name in present else 'NULL'} AS {f.dataType.simpleString()}) "
            f"AS {f.name}"
            for f in STAR_SCHEMAS[table].fields
        ]
    )


def build_studies(flat: DataFrame) -> DataFrame:
    """One row per study: of a repeated registration the first one is kept.

    The rows are reduced by the study key, the key of all later joins, so the
    study side of a join is shuffled once. Map-side combine sends one row per
    task of a number that is registered millions of times; columns that a
    query does not read are pruned. Two numbers with one key are an error.
    """
    rows = accepted(flat).selectExpr(
        f"{rules.study_key(text.name('NCT Number'))} AS study_id",
        INGEST_POS,
        *[f"{text.name(c)} AS {target}" for target, c in _STUDY_COLUMNS.items()],
    )
    first = rows.groupBy("study_id").agg(
        *[F.min_by(c, INGEST_POS).alias(c) for c in _STUDY_COLUMNS],
        F.min("nct_id").alias("least_id"),
        F.max("nct_id").alias("largest_id"),
    )
    clash = "raise_error('study key of two numbers: ' || least_id || ', ' || largest_id)"
    checked = first.filter(f"if(least_id = largest_id, true, cast({clash} AS boolean))")
    return conform(checked.withColumn("enrollment", F.bround("enrollment", 0)), "studies")


def key_map(studies: DataFrame) -> DataFrame:
    """Surrogate key of every stored study."""
    return studies.select("study_id", "nct_id")


def _keyed(flat: DataFrame, *columns: str) -> DataFrame:
    """Children of every row that has a study; all rows of a study count.

    The key is computed from the row itself, so no map is joined.
    """
    return accepted(flat).selectExpr(
        f"{rules.study_key(text.name('NCT Number'))} AS study_id", *columns
    )


def _items(flat: DataFrame, column: str) -> DataFrame:
    """(study_id, item): the stripped, non-empty entries of a pipe list."""
    raw = _keyed(flat, f"explode({text.pipe_tokens(text.name(column))}) AS token")
    return raw.selectExpr("study_id", f"{text.strip('token')} AS item").filter("item != ''")


def build_conditions(flat: DataFrame) -> DataFrame:
    return conform(rules.classify_conditions(_items(flat, "Conditions"), "item"), "conditions")


def build_interventions(flat: DataFrame) -> DataFrame:
    parsed = _items(flat, "Interventions").selectExpr(
        "study_id",
        f"{rules.intervention_type('item')} AS intervention_type",
        f"{rules.intervention_name('item')} AS name",
    )
    return conform(parsed, "interventions")


def build_outcomes(flat: DataFrame) -> DataFrame:
    measured = _items(flat, "Outcome Measures").withColumnRenamed("item", "measure")
    return conform(measured, "outcomes")


def build_sponsors(flat: DataFrame) -> DataFrame:
    """Sponsors with the funder at the same position; the first one leads."""
    listed = _keyed(
        flat,
        f"{text.split_pipe(text.name('Funded Bys'))} AS funders",
        f"posexplode({text.split_pipe(text.name('Sponsor/Collaborators'))}) AS (pos, agency)",
    )
    roles = listed.selectExpr(
        "study_id",
        "agency",
        "get(funders, pos) AS agency_class",
        "if(pos = 0, 'Lead', 'Collaborator') AS lead_or_collaborator",
    )
    return conform(roles, "sponsors")


def build_locations(flat: DataFrame) -> DataFrame:
    """Country is the text after the last comma; the continent follows from it."""
    located = _items(flat, "Locations").selectExpr(
        "study_id", f"{text.last_comma_part('item')} AS country"
    )
    return conform(
        located.withColumn("continent", F.expr(rules.continent("country"))), "locations"
    )


def build_study_design(flat: DataFrame) -> DataFrame:
    """One row per registry row, all NULL when the design is missing."""
    pairs = _keyed(flat, f"{rules.design_pairs(text.name('Study Designs'))} AS pairs")
    slots = [f"{rules.design_value('pairs', slot)} AS {slot}" for slot in vocab.DESIGN_KEYS]
    return conform(pairs.selectExpr("study_id", *slots), "study_design")


BUILDERS = {
    "studies": build_studies,
    "conditions": build_conditions,
    "interventions": build_interventions,
    "outcomes": build_outcomes,
    "sponsors": build_sponsors,
    "locations": build_locations,
    "study_design": build_study_design,
}


#: Label sets of studies: the table, column and vocabulary they come from.
LABELS = {
    "areas": ("conditions", "therapeutic_area", vocab.AREAS),
    "continents": ("locations", "continent", vocab.CONTINENTS),
}


def label_bits(star: Star, kind: str) -> DataFrame:
    """(study_id, bit) of every child with a label."""
    table, label, vocabulary = LABELS[kind]
    children = getattr(star, table).filter(f"{label} IS NOT NULL")
    return children.selectExpr("study_id", f"{stats.label_bit(label, vocabulary)} AS bit")


def label_sets(star: Star) -> DataFrame:
    """(study_id, areas, continents): both label sets of every study with a label, as bits."""
    parts = [
        label_bits(star, kind).selectExpr(
            "study_id", *[f"{'bit' if k == kind else 0} AS {k}" for k in LABELS]
        )
        for kind in LABELS
    ]
    return merged_labels(reduce(DataFrame.union, parts))


def merged_labels(sets: DataFrame) -> DataFrame:
    """One row per study of label sets that stand in several rows, or in several loads."""
    return sets.groupBy("study_id").agg(*[F.bit_or(k).alias(k) for k in LABELS])


class Star:
    """The seven tables, each built on first use.

    Built from a clean flat file, or over stored tables (see
    ``sources.tables.read_star``); the questions do not see a difference.
    ``labels`` gives stored rows of label sets (study_id, areas, continents),
    so that questions on areas and continents need not read the children.
    """

    def __init__(
        self,
        make: Callable[[str], DataFrame],
        count: Callable[[], DataFrame] | None = None,
        labels: Callable[[], DataFrame] | None = None,
    ):
        self._make = make
        self._count = count
        self._labels = labels
        self._tables: dict[str, DataFrame] = {}

    @classmethod
    def of_flat(cls, flat: DataFrame, **other: Callable[[], DataFrame]) -> Star:
        """The star over a clean flat file; ``other`` gives tables with a source of their own."""
        make = lambda name: other[name]() if name in other else BUILDERS[name](flat)
        return cls(make, lambda: count_studies(flat))

    def n_studies(self) -> DataFrame:
        """One row, one column: the number of studies, without building them."""
        return self._count() if self._count else self.studies.agg(F.count("*"))

    def label_masks(self, kind: str) -> DataFrame:
        """(study_id, mask): the distinct areas or continents of each study as bits."""
        bits = self._labels().selectExpr("study_id", f"{kind} AS bit") if self._labels else label_bits(self, kind)
        masks = bits.groupBy("study_id").agg(F.bit_or("bit").alias("mask"))
        return masks.filter("mask != 0") if self._labels else masks

    def label_sets(self) -> DataFrame:
        """(study_id, areas, continents) of each study with one of them."""
        return merged_labels(self._labels()) if self._labels else label_sets(self)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in STAR_SCHEMAS:
            raise AttributeError(name)
        if name not in self._tables:
            self._tables[name] = self._make(name)
        return self._tables[name]

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in STAR_SCHEMAS}


def count_studies(flat: DataFrame) -> DataFrame:
    """Distinct registry numbers of the accepted rows of a flat file."""
    return accepted(flat).agg(F.count_distinct("NCT Number"))


def row_count_audit(star: Star) -> DataFrame:
    """Rows per table."""
    counts = [
        df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"))
        for name, df in star.tables().items()
    ]
    return reduce(DataFrame.union, counts)
