"""Spend mix before and after the first purchase, per A/B group."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.bins import score_grade
from cohortlens.operators.firsts import first_per_key
from cohortlens.operators.periods import first_purchases, label_periods
from cohortlens.operators.pivots import pair_label, usage_pivot
from cohortlens.operators.running import gapless_numbers
from cohortlens.sources.extract_sets import Extract, remove_folder, write_set

# Groups, grade width and actions counted after the purchase.
GROUPS = ("A", "B")
GRADE_WIDTH = 10
STEPS = (10, 20)


def without_referral(log: DataFrame) -> DataFrame:
    """Rows of users without a referral reward, with their score grade."""
    return log.filter(F.col("get_referral_reward") == 0).withColumn(
        "rs_grade", score_grade(F.col("relative_score"), GRADE_WIDTH)
    )


def usage_before_after_purchase(
    log: DataFrame,
    user: str = "ci_hash",
    group: str = "user_group",
    groups: Sequence[str] = GROUPS,
    steps: tuple[int, int] = STEPS,
    every_purchase: bool = False,
) -> DataFrame:
    """Long form: (group, user, period, use type, description) with ``freq`` and ``vol``.

    All groups and periods come from one labelling and one aggregation. Rows without
    a description belong to no column and are left out.
    """
    kept = without_referral(log).filter(F.col(group).isin(list(groups)))
    labelled = label_periods(kept, group, user, steps, every_purchase)
    return (
        labelled.filter(F.col("description").isNotNull())
        .groupBy(group, user, "period", "use_type", "description")
        .agg(F.count("quantity").alias("freq"), F.sum("quantity").alias("vol"))
    )


def usage_wide(
    usage: DataFrame,
    value: str,
    labels: Sequence[str],
    user: str = "ci_hash",
    group: str = "user_group",
) -> DataFrame:
    """One column per ``use_type|description`` label, one row per (group, user, period).

    Labels absent from a whole (group, period) are NULL there, other gaps are 0.
    """
    cells = usage.withColumn("_label", pair_label(F.col("use_type"), F.col("description")))
    return usage_pivot(cells, [group, user, "period"], [group, "period"], "_label", value, labels)


def purchaser_counts(
    log: DataFrame, user: str = "ci_hash", group: str = "user_group"
) -> DataFrame:
    """Distinct purchasing users per group."""
    return (
        first_purchases(without_referral(log), [group, user])
        .groupBy(group)
        .agg(F.count(user).alias("num_purchased"))
    )


def user_grades(log: DataFrame, user: str = "ci_hash") -> DataFrame:
    """Grade of each user's first action."""
    return first_per_key(
        without_referral(log).filter(F.col(user).isNotNull()),
        [user],
        [F.asc_nulls_last("action_num")],
    ).select(user, "rs_grade")


def occurring_labels(
    usage: DataFrame, group: str = "user_group"
) -> dict[tuple[str, str], list[str]]:
    """The column labels of each (group, period), for pivots without a given list.

    One row per frame reaches the driver, with the distinct labels, which become the
    columns of its table; no row of the data does.
    """
    label = pair_label(F.col("use_type"), F.col("description"))
    found = usage.groupBy(group, "period").agg(F.sort_array(F.collect_set(label)).alias("labels"))
    return {(r[0], r[1]): r[2] for r in found.orderBy(group, "period").toLocalIterator()}


def usage_extracts(
    wide: DataFrame,
    labels: dict[tuple[str, str], list[str]],
    user: str = "ci_hash",
    group: str = "user_group",
) -> dict[str, Extract]:
    """The pivots of a stored wide table, by name, with their headers of two levels.

    ``wide`` has a ``_freq`` and a ``_vol`` column for each label. Each pivot is some of its
    columns and partitions. One period: the user, then a column for each of the period's
    own labels, 0 where the user has none, under the lines use type, description and
    the user's name. All periods of a group: a running number from 0 in each period, the
    user, the labels of any period, NULL in periods without the label, and the period.
    """
    out = {}
    for name in sorted({g for g, _ in labels}):
        periods = {p: found for (g, p), found in labels.items() if g == name}
        every = sorted({c for found in periods.values() for c in found})
        rows = wide.filter(F.col(group) == name)
        for value in ("freq", "vol"):
            cells = [
                F.when(F.col("period").isin([p for p, own in periods.items() if c in own]), F.coalesce(f"`{c}_{value}`", F.lit(0)))
                .alias(c)
                for c in every
            ]
            stacked = gapless_numbers(rows, ["period"], user, "index").select("index", user, *cells, "period")
            out[f"{name.lower()}_all_{value}_periods"] = Extract(stacked, _two_levels(["use_type", user], every, ["period"], ["description", ""]))
            for period, own in periods.items():
                one = rows.filter(F.col("period") == period).select(
                    user, *[F.coalesce(f"`{c}_{value}`", F.lit(0)).alias(c) for c in own]
                )
                header = _two_levels(["use_type"], own, [], ["description"])
                out[f"{name.lower()}_{period}_{value}"] = Extract(one, [*header, [user] + [""] * len(own)])
    return out


def _two_levels(first: list[str], labels: Sequence[str], last: list[str], second: list[str]) -> list[list[str]]:
    parts = [label.split("|", 1) for label in labels]
    return [[*first, *[p[0] for p in parts], *last], [*second, *[p[1] for p in parts], *[""] * len(last)]]


def write_usage_extracts(
    log: DataFrame,
    path: str,
    user: str = "ci_hash",
    group: str = "user_group",
) -> str:
    """All CSV extracts of the analysis under ``path``, as one set that replaces the one before.

    Per group and value (freq, vol): one extract with all periods stacked, and one per
    period with only the labels that occur in it; and the user grades. The log is
    processed once into the long form, which is pivoted once for all extracts into a wide
    table with partitions by group and period; each extract then is a scan of its own
    columns and partitions. Both tables lie in a work folder under ``path``, which must
    be on storage that the driver and all executors share, and go when the set is out.
    See ``extract_sets`` for reading. Returns the folder of the set.
    """
    spark = log.sparkSession
    work = f"{path}/work-{uuid.uuid4().hex}"
    try:
        long = usage_before_after_purchase(log, user, group)
        long.write.partitionBy(group, "period").parquet(f"{work}/long")
        usage = spark.read.schema(long.schema).parquet(f"{work}/long")
        labels = occurring_labels(usage, group)
        every = sorted({c for found in labels.values() for c in found})
        cells = usage.withColumn("_label", pair_label(F.col("use_type"), F.col("description")))
        wide = (
            cells.groupBy(group, user, "period")
            .pivot("_label", every)
            .agg(F.sum("freq").alias("freq"), F.sum("vol").alias("vol"))
        )
        wide.write.partitionBy(group, "period").parquet(f"{work}/wide")
        stored = spark.read.schema(wide.schema).parquet(f"{work}/wide")
        grades = gapless_numbers(user_grades(log, user), [], user, "index").select("index", user, "rs_grade")
        grade = Extract(grades, [["", user, "rs_grade"]])
        return write_set(spark, path, {**usage_extracts(stored, labels, user, group), "user_grade": grade})
    finally:
        remove_folder(spark, work)
