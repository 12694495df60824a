"""Reward cohort tables: coupons, retention, two-sided funnel."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.times import full_hours, kst_date, kst_instant, to_kst
from cohortlens.operators.distincts import distinct_by_flags
from cohortlens.operators.funnel import two_sided_funnel
from cohortlens.operators.matching import existence_flag
from cohortlens.operators.retention import daily_screens, retention_flags
from cohortlens.sources.scans import date_partitions

# Cohort bounds (KST clock), log days, screens and coupon name patterns.
COHORT_FROM = "2025-12-01 00:00:00"
COHORT_TO = "2025-12-31 00:00:00"
LOG_DAYS = ("2025-12-01", "2025-12-31")
COUPON_SINCE = "2025-12-01 00:00:00"
BOX_SCREEN = "mobile_coupon"
MAX_SCORE = 100
RAW_FROM = "2025-12-17 00:00:00"
RAW_SINCE = "2025-12-17"
RAW_SCREEN = "onboarding_step_mobile_coupon"
COUPON_PATTERNS = {
    "counts_1d_am": "%바나프레소 아메리카노%",
    "counts_2d_am": "%아메리카노 1잔 2일차%",
    "counts_4d_cl": "%크리미라떼 1잔 4일차%",
    "counts_7d_am": "%아메리카노 1잔 7일차%",
    "counts_7d_cl": "%크리미라떼 1잔 7일차%",
}


def sign_up_cohort(
    metrics: DataFrame, since: str = COHORT_FROM, until: str | None = COHORT_TO
) -> DataFrame:
    """Users approved from ``since`` to ``until`` (KST clock, both instants included).

    The shift sits on the bounds, so the range reaches the scan.
    """
    approved = F.col("first_approval_time")
    kept = metrics.filter(approved >= kst_instant(since))
    if until is not None:
        kept = kept.filter(approved <= kst_instant(until))
    return kept.select(
        "user_id",
        "gender",
        "first_approval_time",
        to_kst(approved).alias("approval_time_kst"),
        to_kst(F.col("last_active_at")).alias("last_active_time_kst"),
        full_hours("first_approval_time", "last_active_at").alias("retention_hour"),
    )


def with_approval_date(cohort: DataFrame) -> DataFrame:
    return cohort.withColumn("approval_date", kst_date(F.col("first_approval_time")))


def cohort_retention(
    cohort: DataFrame,
    screen_log: DataFrame,
    log_days: tuple[str, str] = LOG_DAYS,
    screen: str = BOX_SCREEN,
    observed_until: Column | None = None,
) -> DataFrame:
    """Retention flags, active days and the coupon-box flag per cohort user with activity."""
    daily = daily_screens(date_partitions(screen_log, *log_days), screen)
    return retention_flags(daily, with_approval_date(cohort), observed_until=observed_until)


def coupon_issue_redeem(box: DataFrame, since: str = COUPON_SINCE) -> DataFrame:
    """Coupons issued and redeemed per user since ``since`` (KST clock)."""
    return (
        box.filter(F.col("created_at") >= kst_instant(since))
        .groupBy(F.col("assigned_user_id").alias("user_id"))
        .agg(F.count("created_at").alias("issue_cnt"), F.count("received_at").alias("redeem_cnt"))
    )


def used_coupons(code: DataFrame) -> DataFrame:
    return code.filter((F.col("status") == "USED") & F.col("valid_from").isNotNull()).select(
        F.col("assigned_user_id").alias("user_id"), F.col("id").alias("coupon_id"), "source_id"
    )


def coupon_use_by_pattern(
    code: DataFrame,
    source: DataFrame,
    patterns: Mapping[str, str] = COUPON_PATTERNS,
) -> DataFrame:
    """Distinct used coupons per user and name pattern; patterns may overlap.

    Names are matched once per coupon source, not once per used coupon. A user whose
    coupons match nothing, or whose source is unknown, has zeros.
    """
    matched = source.select(
        F.col("id").alias("source_id"),
        *[F.col("coupon_name").like(p).alias(f"_is_{n}") for n, p in patterns.items()],
    )
    named = used_coupons(code).join(matched, "source_id", "left")
    flags = {n: f"_is_{n}" for n in patterns}
    return distinct_by_flags(named, ["user_id"], "coupon_id", flags)


def reward_cohort(
    metrics: DataFrame,
    accounts: DataFrame,
    log: DataFrame,
    screen_log: DataFrame,
    box: DataFrame,
    code: DataFrame,
    source: DataFrame,
    since: str = COHORT_FROM,
    until: str = COHORT_TO,
    log_days: tuple[str, str] = LOG_DAYS,
    coupon_since: str = COUPON_SINCE,
    screen: str = BOX_SCREEN,
    patterns: Mapping[str, str] = COUPON_PATTERNS,
    max_score: float = MAX_SCORE,
    gender: int = 1,
    log_by_candidate: DataFrame | None = None,
) -> DataFrame:
    """One row per cohort user: attributes, coupons, retention, two-sided funnel.

    The gender test is applied to the cohort before the branches use it: they are
    joined back on the user, so the users it removes could not appear anyway. Every
    branch is one row per user when joined. Only ``redeem_cnt`` is 0 where there is
    nothing to count, the other branch columns are NULL. Sorted by approval time.

    With all inputs bucketed by their user, and the log a second time by its candidate
    (``log_by_candidate``), the branches are computed and joined without shuffles.
    """
    cohort = sign_up_cohort(metrics, since, until).filter(F.col("gender") == gender)
    people = accounts.filter(F.col("relative_score") < max_score).select(
        F.col("id").alias("user_id"), "relative_score", "location"
    )
    coupons = coupon_issue_redeem(box, coupon_since)
    retention = cohort_retention(cohort, screen_log, log_days, screen)
    if log_by_candidate is not None:
        log_by_candidate = date_partitions(log_by_candidate, *log_days)
    funnel = two_sided_funnel(date_partitions(log, *log_days), cohort, log_by_candidate=log_by_candidate)
    used = coupon_use_by_pattern(code, source, patterns)
    joined = (
        with_approval_date(cohort)
        .join(people, "user_id")
        .join(coupons, "user_id", "left")
        .join(retention, "user_id", "left")
        .join(funnel, "user_id", "left")
        .join(used, "user_id", "left")
    )
    flags = [c for c in retention.columns if c.endswith("retention")]
    return joined.select(
        *cohort.columns,
        "approval_date",
        "relative_score",
        "location",
        "issue_cnt",
        "check_coupon_box",
        F.coalesce("redeem_cnt", F.lit(0)).alias("redeem_cnt"),
        *patterns,
        *flags,
        *[c for c in funnel.columns if c != "user_id"],
        (F.col("rcmd_other_match") + F.col("rcmd_match")).alias("rcmd_match_overall"),
        "online_date",
    ).orderBy(F.asc_nulls_last("first_approval_time"), "user_id")


def reward_cohort_raw(
    metrics: DataFrame,
    accounts: DataFrame,
    screen_log: DataFrame,
    code: DataFrame,
    since: str = RAW_FROM,
    log_since: str = RAW_SINCE,
    screen: str = RAW_SCREEN,
) -> DataFrame:
    """Recent sign-ups with whether they saw the coupon screen and how many coupons they used.

    The coupon-source lookup of the original adds no column and no filter, and a
    distinct count ignores any repetition it causes, so it is not needed.
    """
    cohort = sign_up_cohort(metrics, since, None).drop("first_approval_time")
    people = accounts.select(F.col("id").alias("user_id"), "relative_score", "location")
    seen = date_partitions(screen_log, since=log_since).filter(
        F.array_contains("navigations", screen)
    )
    used = (
        used_coupons(code)
        .groupBy("user_id")
        .agg(F.count_distinct(F.col("coupon_id")).alias("used_vana_coupons"))
    )
    flagged = existence_flag(cohort.join(people, "user_id"), seen, "user_id", "get_vana_coupon")
    return flagged.join(used, "user_id", "left")
