"""Shares, exact quantiles over histograms, and label sets.

Like the rules, the expression helpers take and return SQL text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialbraid.functions.text import quote

COUNT = "count(*)"


def pct(part: str, whole: str, digits: int = 1) -> str:
    """Percentage as a double, rounded half away from zero."""
    return f"round(100.0D * {part} / {whole}, {digits})"


def pct_half_even(part: str, whole: str, digits: int = 1) -> str:
    """Percentage rounded half to even, the rule of the profiling reports."""
    return f"bround(100.0D * {part} / {whole}, {digits})"


def grand_total(c: str) -> str:
    """Sum over all rows; only for frames that are already aggregated."""
    return f"sum({c}) OVER ()"


def tally(df: DataFrame, *keys: str, **counts: str) -> DataFrame:
    """Aggregates by keys, given as SQL text."""
    return df.groupBy(*keys).agg(*[F.expr(e).alias(c) for c, e in counts.items()])


def quantiles(
    histogram: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    probabilities: Mapping[str, float],
    **extra: str,
) -> DataFrame:
    """Exact, linearly interpolated quantiles of a weighted histogram.

    ``histogram`` holds one row per (keys, value) with the number of rows
    ``weight`` behind it; NULL values carry no weight. The histogram is built
    by a plain ``groupBy`` with map-side combine, spread over all tasks by
    (keys, value), so a key holding a third of all rows arrives here as its
    distinct values only. The running sum is a sort that can spill; nothing is
    collected into a per-group buffer.

    ``extra`` are aggregates over the histogram rows, in the same pass.
    """
    per_key = Window.partitionBy(*keys)
    up_to_value = per_key.orderBy(F.asc_nulls_last(value)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    w = F.expr(f"if({value} IS NULL, 0, {weight})")
    ranked = histogram.withColumns(
        {"upto_": F.sum(w).over(up_to_value), "total_": F.sum(w).over(per_key)}
    )

    return tally(ranked, *keys, **{c: _quantile(p, value) for c, p in probabilities.items()}, **extra)


def spread_quantiles(
    histogram: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    probabilities: Mapping[str, float],
) -> DataFrame:
    """The quantiles of :func:`quantiles` for values without a bound on their number.

    The values of a key fall into ranges of a binary order of magnitude cut in
    eight, of which there are a few thousand at most. Running sums over the
    ranges find those that hold a quantile; only their values are ordered, each
    range in a task of its own. Keys are not NULL. Without keys there is one
    row, with NULLs where there is no value.
    """
    return _of_ranges(histogram, keys, value, weight, probabilities)[1]


def spread_summary(
    histogram: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    probabilities: Mapping[str, float],
) -> DataFrame:
    """The quantiles of :func:`spread_quantiles`, and n_values, mean, stddev, min and max.

    The ranges carry the moments of their values: count, sum, and the squares
    about their own mean, which are small against the values of a narrow range.
    So everything comes out of the one histogram. Groups without a value are
    left out; without keys there is one row always.
    """
    ranges, found = _of_ranges(histogram, keys, value, weight, probabilities)
    total = "(sum(sum_) * sum(sum_) / sum(n_))"
    moments = tally(
        ranges,
        *keys,
        n_values="coalesce(sum(n_), 0L)",
        mean="sum(sum_) / sum(n_)",
        stddev=f"sqrt(greatest(sum(around_) + sum(sum_ * sum_ / n_) - {total}, 0D) / nullif(sum(n_) - 1, 0))",
        min="min(least_)",
        max="max(largest_)",
    )
    both = moments.unionByName(found, allowMissingColumns=True)
    columns = ["n_values", "mean", "stddev", "min", "max", *probabilities]
    return tally(both, *keys, **{c: f"max({c})" for c in columns})


def _of_ranges(
    histogram: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    probabilities: Mapping[str, float],
) -> tuple[DataFrame, DataFrame]:
    """The ranges of the values with their moments, and the quantiles."""
    # Falls and rises with the value; doubles reach from -1074 to 1024 binary orders.
    order = (
        f"if({value} = 0, 0D, signum({value}) * (10000 + floor(log2(abs({value})) * 8)))"
    )
    # The join below asks for a range; asked here, the histogram is the same plan for all its readers.
    valued = histogram.filter(f"{value} IS NOT NULL").withColumn("range_", F.expr(order))
    valued = valued.filter("range_ IS NOT NULL")
    whole = Window.partitionBy(*keys)
    running = whole.orderBy("range_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    product = f"cast({value} AS double) * {weight}"
    ranges = tally(
        valued,
        *keys,
        "range_",
        n_=f"sum({weight})",
        sum_=f"sum({product})",
        around_=f"sum({product} * {value}) - sum({product}) * sum({product}) / sum({weight})",
        least_=f"min({value})",
        largest_=f"max({value})",
    )
    counted = ranges.select(*keys, "range_", "n_").withColumns(
        {"upto_": F.sum("n_").over(running), "total_": F.sum("n_").over(whole)}
    )
    ranks = [f"{f}({p}D * (total_ - 1))" for p in probabilities.values() for f in ("floor", "ceil")]
    holds = " OR ".join(f"(upto_ - n_ <= {r} AND {r} < upto_)" for r in ranks)
    held = counted.filter(holds).selectExpr(*keys, "range_", "upto_ - n_ AS before_", "total_")
    inside = Window.partitionBy(*keys, "range_").orderBy(value)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = valued.join(held, [*keys, "range_"]).withColumn(
        "upto_", F.col("before_") + F.sum(weight).over(inside)
    )
    return ranges, tally(ranked, *keys, **{c: _quantile(p, value) for c, p in probabilities.items()})


def _quantile(p: float, value: str) -> str:
    """SQL: interpolated quantile of rows with running sums ``upto_`` of ``total_``."""
    rank = f"({p}D * (total_ - 1))"
    low = f"min(CASE WHEN upto_ > floor({rank}) THEN {value} END)"
    high = f"min(CASE WHEN upto_ > ceil({rank}) THEN {value} END)"
    return f"cast({low} + max({rank} - floor({rank})) * ({high} - {low}) AS double)"


# --- Label sets -------------------------------------------------------------
# A study can carry several labels of a small fixed vocabulary. Its set of
# labels fits the bits of one integer, so "the distinct labels of a study" is
# a bit_or with map-side combine: one shuffle of (id, integer), no distinct,
# no collected arrays, and a study repeated millions of times stays one row.


def label_bit(label: str, vocabulary: Sequence[str]) -> str:
    """Bit of a label; a label outside the vocabulary is an error, not a loss."""
    bits = " ".join(f"WHEN {quote(name)} THEN {1 << i}" for i, name in enumerate(vocabulary))
    unknown = f"cast(raise_error('label outside the vocabulary: ' || {label}) AS int)"
    return f"CASE {label} {bits} ELSE {unknown} END"


def labels_of(mask: str, vocabulary: Sequence[str]) -> str:
    """Array of the labels whose bits are set."""
    names = ", ".join(
        f"if({mask} & {1 << i} != 0, {quote(name)}, NULL)" for i, name in enumerate(vocabulary)
    )
    return f"array_compact(array({names}))"


def labels_or_all(mask: str, vocabulary: Sequence[str]) -> str:
    """Labels of the mask plus one NULL entry that stands for "any label"."""
    return f"array_append({labels_of(mask, vocabulary)}, cast(NULL AS string))"
