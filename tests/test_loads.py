"""Loads of stored tables: one winner per number, key sidecars, history, reclaimed files."""

from __future__ import annotations

import random
import re

import pytest

from trialbraid.operators import cleaning, quality
from trialbraid.operators.star import Star, row_count_audit
from trialbraid.plans import duration, geography, landscape
from trialbraid.schema import STAR_SCHEMAS
from trialbraid.sources import commits
from trialbraid.sources import tables as stored


@pytest.fixture
def load(registry):
    """A star of a few studies, by their numbers."""

    def make(*numbers: int, **cells) -> Star:
        row = {"Conditions": "Asthma|Sepsis", "Study Designs": "Masking: None"} | cells
        return Star.of_flat(
            cleaning.clean_pipeline(registry(*[row | {"NCT Number": f"NCT{n:08d}"} for n in numbers]))
        )

    return make


def studies(spark, folder):
    return sorted(r.study_id for r in stored.read_star(spark, folder).studies.collect())


def whole(spark, folder):
    """All tables fit the studies."""
    star = stored.read_star(spark, folder)
    own = {r.study_id for r in star.studies.collect()}
    assert {r.study_id for r in star.conditions.collect()} == own
    counts = {r.table_name: r.n_rows for r in row_count_audit(star).collect()}
    assert counts["studies"] == counts["study_design"] == len(own)
    assert counts["conditions"] == 2 * len(own)


@pytest.mark.parametrize("repeated", ["refuse", "skip"])
def test_of_two_interleaved_loads_one_keeps_a_shared_study(spark, tmp_path, load, monkeypatch, repeated):
    folder = str(tmp_path)
    stored.append_tables(load(1, 2), folder)
    claim = commits.claim
    other = []

    def late(spark, folder, commit):
        # Another writer commits after the check of this one and before its claim.
        if not other:
            other.append(1)
            monkeypatch.setattr(commits, "claim", claim)
            stored.append_tables(load(3, 4), folder)
        return claim(spark, folder, commit)

    monkeypatch.setattr(commits, "claim", late)
    if repeated == "refuse":
        with pytest.raises(ValueError, match="stored already"):
            stored.append_tables(load(4, 5), folder)
        assert studies(spark, folder) == [1, 2, 3, 4]
    else:
        stored.append_tables(load(4, 5), folder, repeated)
        assert studies(spark, folder) == [1, 2, 3, 4, 5]
    whole(spark, folder)
    numbers = [c.number for c in commits.read_commits(spark, folder)]
    assert numbers == list(range(len(numbers)))


def test_a_lost_race_without_a_shared_study_takes_the_next_number(spark, tmp_path, load, monkeypatch):
    folder, claim, lost = str(tmp_path), commits.claim, []

    def late(spark, folder, commit):
        if not lost:
            lost.append(commit.number)
            assert claim(spark, folder, commits.Commit(commit.number))
            assert not claim(spark, folder, commit)
            return False
        return claim(spark, folder, commit)

    monkeypatch.setattr(commits, "claim", late)
    stored.append_tables(load(7), folder)
    assert [c.load is None for c in commits.read_commits(spark, folder)] == [True, False]
    assert studies(spark, folder) == [7]


def test_only_loads_that_may_hold_a_key_are_read(spark, tmp_path, load):
    folder = str(tmp_path)
    names = [stored.append_tables(load(*range(a, a + 9)), folder) for a in (10, 100, 1000)]
    wide = stored.append_tables(load(1, 99999), folder)
    known = commits.visible(commits.read_commits(spark, folder))
    assert [c.load for c in known] == [*names, wide]

    def asked(*numbers):
        keys = load(*numbers).studies.select("study_id")
        own = commits.Commit(99, "x", len(numbers), min(numbers), max(numbers), 1)
        return [c.load for c in stored.loads_that_may_hold(keys, own, folder, known)]

    assert asked(105) == [names[1]]
    # In the range of two loads, in the filter of one.
    assert asked(14, 1003) == [names[0], names[2]]
    assert asked(500) == [] and asked(200000) == []


def test_filters_miss_no_key_and_let_few_others_through(spark, tmp_path):
    rng = random.Random(4)
    mine = spark.createDataFrame([(rng.randrange(10**9),) for _ in range(20_000)], "study_id bigint")
    commit = stored.write_sidecar(mine, f"{tmp_path}/keys/load=a", 0, "a")
    words = spark.read.parquet(f"{tmp_path}/keys/load=a")

    def met(keys):
        hashed = stored._hashed(keys).selectExpr(f"h & {commit.slots - 1}L AS slot", "bits")
        return hashed.join(words, "slot").where("word & bits = bits").count()

    assert met(mine) == 20_000
    others = spark.createDataFrame([(10**9 + i,) for i in range(20_000)], "study_id bigint")
    assert met(others) < 0.05 * 20_000
    assert words.count() <= 20_000 / 2


def test_a_foreign_number_with_a_stored_key_is_an_error(spark, tmp_path, load):
    folder = str(tmp_path)
    stored.append_tables(load(5), folder)
    clash = load(5)
    changed = clash.studies.selectExpr(
        *["'EUCTR-5' AS nct_id" if c == "nct_id" else c for c in STAR_SCHEMAS["studies"].names]
    )
    star = Star(lambda name: changed if name == "studies" else getattr(clash, name))
    with pytest.raises(Exception, match="two numbers"):
        stored.append_tables(star, folder, "skip")


def test_hidden_loads_are_reclaimed_after_the_retention(spark, tmp_path, load):
    folder = str(tmp_path)
    first = stored.append_tables(load(1, 2), folder)
    old = stored.read_star(spark, folder)
    stored.reset_tables(spark, folder)
    second = stored.append_tables(load(2, 3), folder)
    load(9).studies.write.parquet(f"{folder}/studies/load=unfinished")
    assert stored.reclaim(spark, folder, 1.0) == []
    # A reader of the older list still has whole tables.
    assert old.studies.count() == 2 and old.conditions.count() == 4
    assert stored.reclaim(spark, folder, -1.0) == sorted([first, "unfinished"])
    assert not (tmp_path / "conditions" / f"load={first}").exists()
    assert (tmp_path / "conditions" / f"load={second}").exists()
    assert studies(spark, folder) == [2, 3]
    with pytest.raises(Exception, match="(?i)not.*exist|not found"):
        old.studies.collect()
    assert stored.reclaim(spark, folder, -1.0) == []


def test_drift_is_seen_in_the_load_that_has_it_without_its_rows(spark, tmp_path, load):
    folder = str(tmp_path)
    stored.append_tables(load(1, 2, Gender="All"), folder)
    stored.append_tables(load(3, 4, Gender="All"), folder)
    stored.append_tables(load(5, 6), folder)
    drift = quality.load_drift(stored.load_profiles(spark, folder))
    assert [(r.number, r.column_name, r.change_points) for r in drift.where("alert").collect()] == [
        (2, "gender", 100.0)
    ]
    plan = drift._jdf.queryExecution().executedPlan().toString()
    assert "load=" not in plan.replace("profile/load=", "") and "nct_id" not in plan
    stored.reset_tables(spark, folder)
    assert stored.load_profiles(spark, folder).count() == 0


def test_merged_label_sets_give_the_answers_of_all_children(spark, tmp_path, load):
    """Three loads; the last one gives a stored study one more condition and place."""
    folder = str(tmp_path)
    stored.append_tables(load(1, 2, Locations="A, Paris, France|B, Rome, Italy"), folder)
    stored.append_tables(load(3, Conditions="COVID-19", Locations="C, Lima, Peru"), folder)
    more = load(2, Conditions="Depression", Locations="D, Cairo, Egypt")
    late = Star(lambda t: getattr(more, t).limit(0) if t in ("studies", "study_design") else getattr(more, t))
    stored.append_tables(late, folder)
    merged = stored.read_star(spark, folder)
    plain = Star(lambda name: getattr(merged, name))
    for plan in (
        landscape.area_distribution,
        geography.continent_counts,
        lambda star: geography.specialization_index(star, 1),
        lambda star: duration.duration_by_area(star, 0),
        duration.duration_by_area_and_phase,
    ):
        assert plan(merged).collect() == plan(plain).collect()
    areas = {r.therapeutic_area: r.trial_count for r in landscape.area_distribution(merged).collect()}
    assert areas["Mental Health"] == 1
    text = geography.specialization_index(merged)._jdf.queryExecution().executedPlan().toString()
    read = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    assert read == {"study_id:bigint,areas:int,continents:int"}
