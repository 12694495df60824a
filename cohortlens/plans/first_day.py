"""What new users were shown on the day they signed up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.sources.scans import on_days_of

DAY = "date_ymd_kst"


def first_day_exposure(cohort: DataFrame, log: DataFrame) -> DataFrame:
    """Recommendations and answers of each cohort user on the sign-up day.

    ``cohort`` has ``user_id`` and ``approval_date``, ``log`` is partitioned by day. Only the
    partitions of days on which someone of the cohort signed up are read. Users
    without a row that day have zeros, also those without an approval date.
    """
    day = F.col("approval_date").cast("string")
    people = cohort.select("user_id", "approval_date", day.alias(DAY))
    shown = on_days_of(log, cohort, day).select(
        F.col("user1_id").alias("user_id"), DAY, "registered_time", "like_time", "dislike_time"
    )
    answered = F.col("like_time").isNotNull() | F.col("dislike_time").isNotNull()
    per_user = (
        shown.join(people.select("user_id", DAY), ["user_id", DAY], "left_semi")
        .groupBy("user_id", DAY)
        .agg(
            F.count("registered_time").alias("first_day_rcmds"),
            F.count(F.when(answered, 1)).alias("first_day_answers"),
        )
    )
    return people.join(per_user, ["user_id", DAY], "left").select(
        "user_id",
        "approval_date",
        F.coalesce("first_day_rcmds", F.lit(0)).alias("first_day_rcmds"),
        F.coalesce("first_day_answers", F.lit(0)).alias("first_day_answers"),
    )
