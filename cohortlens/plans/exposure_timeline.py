"""Dense per-user timeline of cumulative exposure since sign-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.times import full_minutes, in_kst_days, time_bucket
from cohortlens.operators.firsts import first_per_key
from cohortlens.operators.running import running_sums
from cohortlens.sources.scans import date_partitions

# Cohort days (KST), log days, bucket width, horizon and score bound.
COHORT_DAYS = ("2025-12-01", "2025-12-28")
LOG_DAYS = ("2025-12-01", "2025-12-29")
WIDTH_MIN = 5
HORIZON_MIN = 60 * 24
MAX_SCORE = 100
TAGGED = "rcmd_type = 3 AND channel_id = 3"

MEASURES = [
    "rcmd_users",
    "rcmd_impression_users",
    "rcmd_response_users",
    "rcmd_request_users",
    "rcmd_users_rcmded",
    "rcmd_impression_users_rcmded",
    "rcmd_response_users_rcmded",
    "rcmd_request_users_rcmded",
]
ATTRIBUTES = ["date_ymd_kst", "hour_kst", "user_location"]


# When the user reacted either way; the event time to use for response curves.
RESPONSE_TIME = "greatest(like_time, dislike_time)"


def exposure_timeline(
    log: DataFrame,
    users: DataFrame,
    cohort_days: tuple[str, str] = COHORT_DAYS,
    log_days: tuple[str, str] = LOG_DAYS,
    gender: int = 1,
    width_min: int = WIDTH_MIN,
    horizon_min: int = HORIZON_MIN,
    event_time: str = "impression_time",
    tagged: str = TAGGED,
    max_score: float = MAX_SCORE,
) -> DataFrame:
    """One row per user and bucket ``0..horizon_min/width_min``, more where dates differ.

    Only the first recommendation per pair counts, so a counterpart occurs once per
    user and plain counts are distinct counts, also when summed over buckets. Buckets
    run from ``approval_time`` to ``event_time``; a row without that time is in no
    bucket. ``event_time`` and ``tagged`` are SQL expressions over the log. Users without rows get the full grid of zeros.
    ``users`` has one row per id.

    The cohort join comes first, so that rows of other users are gone before the log
    is sorted and shuffled by pair; it keeps or drops all rows of a pair together.
    """
    last_bucket = horizon_min // width_min

    cohort = users.filter(
        in_kst_days(F.col("first_approval_time"), *cohort_days) & (F.col("gender") == gender)
    ).select(
        F.col("id").alias("user_id"),
        "relative_score",
        "approval_time",
        F.substring(F.col("location").cast("string"), 1, 3).alias("user_location"),
    )
    shown = (
        date_partitions(log, *log_days)
        .filter(F.col("user1_gender") == gender)
        .withColumnRenamed("user1_id", "user_id")
    )
    joined = shown.join(cohort, "user_id")
    first = first_per_key(
        joined, ["user_id", "user2_id"], [F.asc_nulls_last("registered_time")]
    ).filter(F.col("user1_relative_score") < max_score)
    bucketed = first.withColumn(
        "min_rc", time_bucket(full_minutes("approval_time", event_time), width_min)
    ).filter(F.col("min_rc").between(0, last_bucket))
    counted = bucketed.groupBy(
        "user_id", "relative_score", "user1_relative_score", "min_rc", *ATTRIBUTES
    ).agg(*_counts(tagged))
    return _with_grid(counted, cohort, last_bucket)


def _counts(tagged: str) -> list[Column]:
    stages = {
        "rcmd_users": "true",
        "rcmd_impression_users": "impression_time IS NOT NULL",
        "rcmd_response_users": "(like_time IS NOT NULL OR dislike_time IS NOT NULL)",
        "rcmd_request_users": "friend_request_time IS NOT NULL",
    }
    tests = stages | {f"{n}_rcmded": f"{p} AND {tagged}" for n, p in stages.items()}
    return [F.expr(f"count(CASE WHEN {p} THEN user2_id END)").alias(n) for n, p in tests.items()]


def _with_grid(counted: DataFrame, cohort: DataFrame, last_bucket: int) -> DataFrame:
    """Running sums over the occupied buckets, then the empty buckets in between.

    Each user gets one start row before bucket 0. Every row then fills the gap up to
    the user's next row: zeros, no attributes, and the sums reached so far. Only the
    occupied buckets are shuffled, never the dense grid.
    """
    start = cohort.select(
        "user_id", "relative_score", F.lit(-1).cast("bigint").alias("min_rc"),
        *[F.lit(0).cast("bigint").alias(m) for m in MEASURES],
    )
    occupied = counted.unionByName(start, allowMissingColumns=True)
    order = [F.asc(c) for c in ("min_rc", *ATTRIBUTES, "user1_relative_score")]
    summed = running_sums(occupied, ["user_id"], order, MEASURES)
    following = F.lead("min_rc").over(Window.partitionBy("user_id").orderBy(*order))
    first, last = F.greatest("min_rc", F.lit(0)), F.greatest(
        "min_rc", F.coalesce(following, F.lit(last_bucket + 1)) - 1
    )
    steps = F.when(last >= first, F.sequence(first, last))
    own = F.col("_at") == F.col("min_rc")
    return (
        summed.withColumn("_steps", steps)
        .withColumn("_at", F.explode("_steps"))
        .select(
            "user_id",
            F.col("_at").alias("min_rc"),
            "relative_score",
            *[F.when(own, F.col(c)).alias(c) for c in ATTRIBUTES],
            *[F.when(own, F.col(m)).otherwise(0).alias(m) for m in MEASURES],
            *[f"cumul_{m}" for m in MEASURES],
        )
    )
