"""Exact quantiles and box statistics, by histograms first and values last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.bounded import held

#: Slices for each power of two, and parts of a slice.
STEPS, PARTS = 1_024, 65_536
#: Wanted slices that a broadcast may hold.
HELD_SLICES = 200_000
_LOWEST_EXPONENT = -1075
_LAST_SLICE = 1 << 40


def points(rows: DataFrame, keys: Sequence[str], value: str, counted: bool = False) -> DataFrame:
    """(``keys``, ``_x``, ``_n``): the values that count, and how often.

    Rows with a NULL or NaN value or a NULL key are in no group. ``counted`` adds up
    equal values of a group first.
    """
    x = F.col(value).cast("double")
    known = rows.dropna(subset=[*keys, value]).filter(~F.isnan(x))
    # Not NULL by type, so that no NULL test is pushed below one of the uses only: all
    # passes then read the same shuffle where the rows come out of one.
    x = F.coalesce(x, F.lit(0.0)).alias("_x")
    if counted:
        return known.groupBy(*keys, x).agg(F.count("*").alias("_n"))
    return known.select(*keys, x, F.lit(1).cast("bigint").alias("_n"))


def magnitude_slice(x: Column) -> Column:
    """Slice number that never decreases as ``x`` grows, ``STEPS`` slices per power of two.

    It needs no knowledge of the value range, and a few huge values do not push all
    others into one slice. Whole numbers up to ``STEPS`` have a slice each, infinities
    the first and the last.
    """
    infinite = F.abs(x) == float("inf")
    size = F.when(~infinite, F.abs(x)).otherwise(1.0)
    exponent = F.floor(F.log2(size))
    step = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * STEPS)
    number = (exponent - _LOWEST_EXPONENT) * STEPS + step
    number = F.when(infinite, F.lit(_LAST_SLICE)).otherwise(number)
    return F.coalesce(F.when(x == 0, 0).when(x > 0, number).otherwise(-number), F.lit(0)).cast("bigint")


def slice_part(x: Column, lo: Column, hi: Column) -> Column:
    """Part of the slice with least value ``lo`` and greatest ``hi``; never decreases."""
    return F.when(hi > lo, F.floor((x - lo) / (hi - lo) * PARTS)).otherwise(0).cast("bigint")


def _joined(big: DataFrame, small: DataFrame, on: Sequence[str] | Column, few_groups: bool) -> DataFrame:
    side = held(small, HELD_SLICES, "use few_groups=False for so many groups") if few_groups else small
    return big.join(side, on if isinstance(on, Column) else list(on))


def slice_totals(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(``keys``, ``_slice``, ``_total``, ``_lo``, ``_hi``), combined before the shuffle.

    What is shuffled is one row for each slice of each group and task, however many
    rows and different values there are.
    """
    return (
        values.groupBy(*keys, magnitude_slice(F.col("_x")).alias("_slice"))
        .agg(F.sum("_n").alias("_total"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    )


def exact_quantiles(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    few_groups: bool = True,
    counted: bool = False,
) -> DataFrame:
    """Linearly interpolated quantiles per group: ``keys``, ``n`` and one ``q_i`` per prob.

    NULL and NaN values are ignored; a group with no others has no row.

    The built-in percentile gathers all values of a group in one buffer. Here slice
    totals, summed straight from the rows, tell which slices hold the wanted ranks, at
    most two for each quantile and group. Only rows of those slices are then counted, by
    part of the slice. A part that holds one value gives it; the values of the others, if
    any are left, are counted one by one in a last pass, which finds nothing to read
    where there are none. No pass shuffles more than slices, parts, or the different
    values of a few narrow parts.

    Each pass derives the rows anew. Where that is costly, or values repeat a lot, such as
    counts, ``counted`` shuffles the different values once, and all passes read those.

    The wanted slices are broadcast, and more than ``HELD_SLICES`` of them are an error;
    ``few_groups=False`` takes any number of groups by joins that shuffle the rows.
    """
    keys = list(keys)
    values = points(rows, keys, value, counted)
    totals = slice_totals(values, keys)

    whole = Window.partitionBy(*keys)
    wanted = (
        totals.withColumns(
            {"n": F.sum("_total").over(whole), "_end": F.sum("_total").over(whole.orderBy("_slice"))}
        )
        .withColumn("_before", F.col("_end") - F.col("_total"))
        .withColumn("_ranks", _ranks_within(probs, F.col("_before"), F.col("_end")))
        .filter(F.size("_ranks") > 0)
        .select(*keys, "_slice", "n", "_before", "_ranks", "_lo", "_hi")
    )

    sliced = values.withColumn("_slice", magnitude_slice(F.col("_x")))
    in_slice = _joined(sliced, wanted, [*keys, "_slice"], few_groups)
    part = slice_part(F.col("_x"), F.col("_lo"), F.col("_hi")).alias("_part")
    parts = in_slice.groupBy(*keys, "_slice", part).agg(
        F.sum("_n").alias("_total"),
        F.min("_x").alias("_lo"),
        F.max("_x").alias("_hi"),
        *[F.any_value(c).alias(c) for c in ("n", "_before", "_ranks")],
    )
    in_order = Window.partitionBy(*keys, "_slice").orderBy("_part")
    found = (
        parts.withColumn("_end", F.col("_before") + F.sum("_total").over(in_order))
        .withColumn("_before", F.col("_end") - F.col("_total"))
        .withColumn("_ranks", _only("_ranks", F.col("_before"), F.col("_end")))
        .filter(F.size("_ranks") > 0)
        .drop("_end", "_total")
    )

    known = found.filter("_lo = _hi").select(*keys, "n", F.explode("_ranks").alias("_rank"), F.col("_lo").alias("_x"))
    open_ = found.filter("_lo < _hi").select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
        F.col("_slice").alias("_of"), "_part", "n", "_before", "_ranks", "_lo", "_hi",
    )
    same = F.col("_slice") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_key{i}"))
    inside = same & F.col("_x").between(F.col("_lo"), F.col("_hi"))
    counted = (
        _joined(sliced, open_, inside, few_groups)
        .groupBy(*keys, "_slice", "_part", "_x")
        .agg(F.sum("_n").alias("_n"), *[F.any_value(c).alias(c) for c in ("n", "_before", "_ranks")])
    )
    in_part = Window.partitionBy(*keys, "_slice", "_part").orderBy("_x")
    ranked = (
        counted.withColumn("_end", F.col("_before") + F.sum("_n").over(in_part))
        .withColumn("_start", F.col("_end") - F.col("_n"))
        .select(*keys, "n", F.explode(_only("_ranks", F.col("_start"), F.col("_end"))).alias("_rank"), "_x")
    )
    both = known.unionByName(ranked)
    ends = []
    for i, p in enumerate(probs):
        for side, rank in (("a", F.floor(_position(p))), ("b", F.ceil(_position(p)))):
            ends.append(F.max(F.when(F.col("_rank") == rank, F.col("_x"))).alias(f"_{side}{i}"))
    return (
        both.groupBy(*keys, "n")
        .agg(*ends)
        .select(*keys, "n", *[_between(i, p).alias(f"q_{i}") for i, p in enumerate(probs)])
    )


def _position(p: float) -> Column:
    """0-based fractional rank of quantile ``p`` among ``n`` values."""
    return (F.col("n") - 1) * F.lit(float(p))


def _between(i: int, p: float) -> Column:
    low, high = F.col(f"_a{i}"), F.col(f"_b{i}")
    between = low + (high - low) * (_position(p) - F.floor(_position(p)))
    return F.when(low == high, low).otherwise(between)


def _only(ranks: str, start: Column, end: Column) -> Column:
    return F.filter(ranks, lambda r: (r >= start) & (r < end))


def _ranks_within(probs: Sequence[float], start: Column, end: Column) -> Column:
    ranks = []
    for p in probs:
        ranks += [F.floor(_position(p)), F.ceil(_position(p))]
    return F.filter(F.array_distinct(F.array(*ranks)), lambda r: (r >= start) & (r < end))


def _fences(
    rows: DataFrame, keys: Sequence[str], value: str, few_groups: bool, counted: bool
) -> DataFrame:
    """Quartiles and the 1.5 IQR fences per group."""
    iqr = F.col("q3") - F.col("q1")
    return (
        exact_quantiles(rows, keys, value, (0.25, 0.5, 0.75), few_groups, counted)
        .withColumnsRenamed({"q_0": "q1", "q_1": "median", "q_2": "q3"})
        .withColumns({"_fence_lo": F.col("q1") - iqr * 1.5, "_fence_hi": F.col("q3") + iqr * 1.5})
    )


def box_stats(
    rows: DataFrame, keys: Sequence[str], value: str, few_groups: bool = True, counted: bool = False
) -> DataFrame:
    """Quartiles, whisker ends within 1.5 IQR, and the number of points beyond them.

    After the quartiles one more pass over the rows, with one row for each group and
    task in its shuffle.
    """
    inside = F.col("_x").between(F.col("_fence_lo"), F.col("_fence_hi"))
    fences = _fences(rows, keys, value, few_groups, counted)
    return (
        _joined(points(rows, keys, value, counted), fences, keys, few_groups)
        .groupBy(*keys, "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("_x"))).alias("_w_lo"),
            F.max(F.when(inside, F.col("_x"))).alias("_w_hi"),
            F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("n_outliers"),
        )
        .select(
            *keys,
            "n",
            "q1",
            "median",
            "q3",
            F.least("_w_lo", "q1").alias("whisker_lo"),
            F.greatest("_w_hi", "q3").alias("whisker_hi"),
            "n_outliers",
        )
    )


def box_outliers(
    rows: DataFrame, keys: Sequence[str], value: str, few_groups: bool = True, counted: bool = False
) -> DataFrame:
    """The rows beyond the whiskers of their group."""
    fences = _fences(rows, keys, value, few_groups, counted).select(*keys, "_fence_lo", "_fence_hi")
    x = F.col(value).cast("double")
    return (
        _joined(rows, fences, keys, few_groups)
        .filter(~x.between(F.col("_fence_lo"), F.col("_fence_hi")))
        .drop("_fence_lo", "_fence_hi")
    )
