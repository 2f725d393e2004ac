"""Question 4: where trials run and what regions specialize in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialbraid import vocab
from trialbraid.functions import stats
from trialbraid.functions.stats import COUNT, tally
from trialbraid.operators.star import Star


def continent_counts(star: Star) -> DataFrame:
    """q4a: distinct trials per continent and share of the located trials."""
    sets = tally(star.label_masks("continents"), "mask", n=COUNT)
    labels = stats.labels_or_all("mask", vocab.CONTINENTS)
    counts = tally(
        sets.selectExpr("n", f"explode({labels}) AS continent"), "continent", trial_count="sum(n)"
    )
    located = "max(if(continent IS NULL, trial_count, NULL)) OVER ()"
    return (
        counts.selectExpr("*", f"{located} AS located")
        .filter("continent IS NOT NULL")
        .selectExpr(
            "continent", "trial_count", f"{stats.pct('trial_count', 'located')} AS pct_of_trials"
        )
        .orderBy(F.desc("trial_count"), "continent")
    )


def country_map(star: Star) -> DataFrame:
    """q4m: distinct trials per country."""
    return tally(
        star.locations.filter("country IS NOT NULL"),
        "country",
        n_trials="count(DISTINCT study_id)",
    )


def label_cells(star: Star) -> DataFrame:
    """Distinct trials per (continent, area), with NULL standing for "any".

    Locations and conditions are not joined: both are reduced to one pair of
    label sets per study in a single shuffle, studies are counted by pair, and
    only the distinct pairs are spread over their labels. All totals the index
    needs are cells of the same small result.
    """
    cells = (
        tally(star.label_sets(), "continents", "areas", n=COUNT)
        .selectExpr(
            "n", "areas", f"explode({stats.labels_or_all('continents', vocab.CONTINENTS)}) AS continent"
        )
        .selectExpr(
            "n",
            "continent",
            f"explode({stats.labels_or_all('areas', vocab.AREAS)}) AS therapeutic_area",
        )
    )
    return tally(cells, "continent", "therapeutic_area", n="sum(n)")


def specialization_index(star: Star, min_trials: int = 5) -> DataFrame:
    """q4b: local share of an area in a continent against its global share.

    The local share is of the trials with a location there, the global share
    of all trials.
    """
    in_continent = "max(if(therapeutic_area IS NULL, n, NULL)) OVER (PARTITION BY continent)"
    in_area = "max(if(continent IS NULL, n, NULL)) OVER (PARTITION BY therapeutic_area)"
    total = star.n_studies().scalar()
    cells = (
        label_cells(star)
        .selectExpr("*", f"{in_continent} AS in_continent", f"{in_area} AS in_area")
        .filter(
            "continent IS NOT NULL AND therapeutic_area IS NOT NULL "
            f"AND n >= {min_trials}"
        )
        .withColumn("total", total)
    )
    index = "n * cast(total AS double) / nullif(cast(in_continent AS double) * in_area, 0.0D)"
    return cells.selectExpr(
        "continent",
        "therapeutic_area",
        "n AS area_trials",
        f"{stats.pct('n', 'in_continent')} AS local_pct",
        f"{stats.pct('in_area', 'total')} AS global_pct",
        f"round({index}, 2) AS specialization_index",
    ).orderBy("continent", F.desc("specialization_index"), "therapeutic_area")
