"""Daily sign-ups: first-time users by either definition against rewarded users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.times import in_days
from cohortlens.operators.distincts import distinct_by_flags
from cohortlens.operators.matching import existence_flag

# Rewarded source type, gender and sign-up days (no zone shift).
SOURCE_TYPE = "MALE_NEW_USER_FIRST_JOIN_V1"
GENDER = 0
DAYS = ("2025-06-01", "2025-07-01")


def first_reward_daily(
    metrics: DataFrame,
    grants: DataFrame,
    source_type: str = SOURCE_TYPE,
    gender: int = GENDER,
    days: tuple[str, str] = DAYS,
) -> DataFrame:
    """Seven distinct user counts per first-approval date, sorted by date.

    Grants are reduced to the users that hold one: repeated grants would only
    multiply rows that the distinct counts fold again.
    """
    users = metrics.filter(
        (F.col("gender") == gender) & in_days(F.col("first_approval_time"), *days)
    ).withColumn("first_approval_date", F.to_date("first_approval_time"))
    granted = grants.filter(F.col("source_type") == source_type)
    flagged = existence_flag(users, granted, "user_id", "_rewarded")
    mobile = "coalesce(mobile_hash_user_seq, 0) = 1"
    ci = "coalesce(ci_hash_user_seq, 0) = 1"
    rewarded = "_rewarded = 1"
    return distinct_by_flags(
        flagged,
        ["first_approval_date"],
        "user_id",
        {
            "num_users": "true",
            "num_mobile_first_users": mobile,
            "num_ci_first_users": ci,
            "num_ci_not_mobile_first_users": f"{ci} AND NOT {mobile}",
            "num_mobile_not_ci_first_users": f"NOT {ci} AND {mobile}",
            "num_actual_rewarded_users": rewarded,
            "num_rewarded_not_analyzed_users": f"{ci} AND NOT {mobile} AND {rewarded}",
        },
    ).orderBy("first_approval_date")
