"""Day-N retention flags."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.measures import any_flag
from cohortlens.functions.times import day_gap

# Day windows since approval, both ends included.
RETENTION_DAYS = {
    "d1_retention": (1, 1),
    "d2_4_retention": (2, 4),
    "d5_7_retention": (5, 7),
    "w1_retention": (8, 14),
}
ONLINE_DAYS = (0, 7)


def daily_screens(screen_log: DataFrame, screen: str) -> DataFrame:
    """(user, day) with ``check_coupon_box`` = 1 if ``screen`` was visited that day."""
    return screen_log.groupBy("user_id", F.to_date("date_ymd_kst").alias("active_date")).agg(
        any_flag(F.array_contains("navigations", screen)).alias("check_coupon_box")
    )


def retention_flags(
    daily: DataFrame,
    cohort: DataFrame,
    windows: Mapping[str, tuple[int, int]] = RETENTION_DAYS,
    observed_until: Column | None = None,
) -> DataFrame:
    """Per cohort user: a 0/1 flag per window, active days in 0..7, and the screen flag.

    ``daily`` has one row per user and day, ``cohort`` (``user_id``,
    ``approval_date``) one per user, so a user brings at most one row per calendar
    day to the join. Windows that reach past the log are censored; with
    ``observed_until`` (a date) ``fully_observed`` tells the users whose last window
    lies within it.
    """
    joined = daily.join(cohort.select("user_id", "approval_date"), "user_id")
    gap = day_gap(F.col("approval_date"), F.col("active_date"))
    keys = ["user_id"]
    if observed_until is not None:
        last = max(hi for _, hi in windows.values())
        joined = joined.withColumn(
            "fully_observed", F.date_add("approval_date", last) <= observed_until
        )
        keys.append("fully_observed")
    return joined.groupBy(*keys).agg(
        *[any_flag(gap.between(lo, hi)).cast("bigint").alias(n) for n, (lo, hi) in windows.items()],
        F.count(F.when(gap.between(*ONLINE_DAYS), F.col("active_date"))).alias("online_date"),
        F.max("check_coupon_box").alias("check_coupon_box"),
    )
