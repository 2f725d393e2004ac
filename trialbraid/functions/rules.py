"""Cleaning and classification rules of the registry as Spark SQL expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from trialbraid import vocab
from trialbraid.functions import text


def date_literal(day: dt.date) -> str:
    return f"DATE '{day.isoformat()}'"


def nullify_tokens(c: str) -> str:
    """NULL for a whole cell that only says "missing"."""
    return f"CASE WHEN NOT {text.is_in(c, vocab.NULL_TOKENS)} THEN {c} END"


def status_group(status: str) -> str:
    groups = ((text.is_in(status, members), g) for g, members in vocab.STATUS_GROUPS.items())
    return text.case_of(groups, text.quote(vocab.OTHER))


def clean_phase(phases: str) -> str:
    """Highest phase of a pipe list; among equals the last one wins.

    Most cells hold one phase, which needs no list.
    """
    stripped = f"transform({text.pipe_tokens(phases)}, t -> {text.strip('t')})"
    # array_position counts from 1 and gives 0 for a label outside of the order.
    rank = f"array_position(array({text.word_list(vocab.PHASE_ORDER)}), t)"
    ranked = f"transform({stripped}, (t, i) -> struct({rank} AS rank, i AS pos, t AS name))"
    unknown = text.quote(vocab.UNKNOWN)
    return (
        f"CASE WHEN contains({phases}, '|') THEN array_max({ranked}).name "
        f"ELSE coalesce({text.strip(phases)}, {unknown}) END"
    )


def enrollment_number(c: str) -> str:
    """Number in a text cell; anything that is not a plain number gives NULL."""
    number = text.strip(c)
    plain = r"'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"
    return f"CASE WHEN {number} RLIKE {plain} THEN try_cast({number} AS double) END"


def beyond_integer(number: str) -> str:
    """Whether a parsed enrollment has no place in an integer column."""
    return f"coalesce(abs({number}) > 2147483647, false)"


def has_star_place(nct_id: str, enrollment: str) -> str:
    """A registry number, and an enrollment text that is no number beyond an integer.

    Only a cell with ten digits or an exponent is parsed. The cell stands once
    in front of that, because a filter computes what it names each time anew.
    """
    large = f"coalesce({enrollment} RLIKE '[0-9]{{10}}|[0-9.][eE]', false)"
    beyond = beyond_integer(enrollment_number(enrollment))
    return f"{nct_id} IS NOT NULL AND NOT ({large} AND {beyond})"


def parse_date(c: str, lenient: bool = False) -> str:
    """Date of ``2020-11-09`` or ``November 9, 2020``; other text gives NULL.

    ``lenient`` also takes a month without a day and puts it on the first. The
    shape is tested first, because a failing parse costs an exception.
    """
    day = text.strip(c)
    shapes = [
        ("[0-9]{4}-[0-9]{2}-[0-9]{2}", f"try_cast({day} AS date)"),
        ("[A-Za-z]+ [0-9]{1,2}, [0-9]{4}", f"try_to_date({day}, 'MMMM d, yyyy')"),
    ]
    if lenient:
        shapes.append(("[A-Za-z]+ [0-9]{4}", f"try_to_date({day}, 'MMMM yyyy')"))
    branches = " ".join(f"WHEN {day} RLIKE '^{shape}$' THEN {date}" for shape, date in shapes)
    return f"CASE {branches} END"


def cutoff_after(extraction: str) -> str:
    return f"add_months({extraction}, {12 * vocab.CUTOFF_BUFFER_YEARS})"


def keep_until(c: str, cutoff: str) -> str:
    """NULL for placeholder dates beyond the cutoff."""
    return f"CASE WHEN {c} <= {cutoff} THEN {c} END"


def starts_before(start: str, day: dt.date) -> str:
    """Flag that is false, not NULL, for a missing start."""
    return f"coalesce({start} < {date_literal(day)}, false)"


def is_expanded_access(study_type: str) -> str:
    return f"coalesce(contains({study_type}, 'Expanded'), false)"


def normalize_condition(condition: str, lowered: str) -> str:
    """Canonical name for known spelling variants, title case for the rest.

    Takes a stripped condition and its lower-case form.
    """
    return text.first_label(lowered, vocab.CONDITION_KEYWORDS, text.title_case(condition))


def therapeutic_area(lowered: str) -> str:
    """Area of a lower-case condition name; on double hits the earlier area wins."""
    return text.first_label(lowered, vocab.AREA_KEYWORDS, text.quote(vocab.OTHER))


def classify_conditions(conditions: DataFrame, condition: str) -> DataFrame:
    """Add ``condition_name`` and ``therapeutic_area`` to stripped conditions.

    The lower-case forms are columns of their own, computed once per row and
    not once per keyword list.
    """
    kept = conditions.columns
    return (
        conditions.selectExpr(*kept, f"lower({condition}) AS lowered")
        .selectExpr(*kept, f"{normalize_condition(condition, 'lowered')} AS condition_name")
        .selectExpr(*kept, "condition_name", "lower(condition_name) AS lowered")
        .selectExpr(
            *kept, "condition_name", f"{therapeutic_area('lowered')} AS therapeutic_area"
        )
    )


def continent(country: str) -> str:
    """Continent by hash-set membership: no join and nothing to broadcast."""
    members = (
        (text.is_in(country, countries), continent)
        for continent, countries in vocab.CONTINENT_COUNTRIES.items()
    )
    return text.case_of(members, text.quote(vocab.OTHER))


def is_mapped_country(country: str) -> str:
    return f"{continent(country)} != {text.quote(vocab.OTHER)}"


def intervention_type(item: str) -> str:
    other = text.quote(vocab.OTHER)
    return f"CASE WHEN contains({item}, ':') THEN {text.before_colon(item)} ELSE {other} END"


def intervention_name(item: str) -> str:
    return f"coalesce({text.after_colon(item)}, {text.strip(item)})"


def design_pairs(designs: str) -> str:
    """``Key: value|Key: value`` as an array of (slot, value).

    A slot is the design column a key belongs to. A key naming several of them
    goes to the first; a part without a colon has no slot.
    """
    key = f"CASE WHEN contains(p, ':') THEN lower({text.before_colon('p')}) END"
    keyed = (
        f"transform({text.pipe_tokens(designs)}, "
        f"p -> struct({key} AS key, {text.after_colon('p')} AS value))"
    )
    slot = text.case_of(
        ((f"contains(kv.key, {text.quote(w)})", slot) for slot, w in vocab.DESIGN_KEYS.items()),
        "NULL",
    )
    return f"transform({keyed}, kv -> struct({slot} AS slot, kv.value AS value))"


def design_value(pairs: str, slot: str) -> str:
    """Value of the last pair for a slot, NULL when there is none."""
    return f"try_element_at(filter({pairs}, p -> p.slot = {text.quote(slot)}), -1).value"


def study_key(nct_id: str) -> str:
    """Stable numeric key of a study, the same on every run and every task.

    Registry numbers (``NCT`` and digits) map to their own digits, so no
    sequence, no global sort and no key-map join is needed. Any other
    identifier gets a negative hash key, apart from the numbers.
    """
    number = f"cast(substring({nct_id}, 4) AS bigint)"
    other = f"-pmod(xxhash64({nct_id}), {2**62}L) - 1"
    return (
        f"CASE WHEN {nct_id} RLIKE '^NCT([0-9]{{8}}|[1-9][0-9]{{8,16}})$' THEN {number} "
        f"WHEN {nct_id} IS NOT NULL THEN {other} END"
    )


def age_days(end: str, start: str) -> str:
    """Day part (0 to 30, signed) of the calendar age between two dates.

    Not a duration: of "3 months 12 days" it is the 12. Whole months are taken
    off first, and a borrowed month has the length of the earlier date's month.
    """

    def day_part(late: str, early: str) -> str:
        borrowed = f"CASE WHEN day({late}) < day({early}) THEN day(last_day({early})) ELSE 0 END"
        return f"(day({late}) - day({early}) + {borrowed})"

    return (
        f"CASE WHEN {end} >= {start} THEN {day_part(end, start)} "
        f"WHEN {end} < {start} THEN -{day_part(start, end)} END"
    )
