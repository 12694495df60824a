"""Jobs over stored layouts: a log partitioned by day, and tables bucketed by user.

The layouts are made from the driver tables by the first query of a session that needs
them, and found in the catalog by the next ones.
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import functions as F

from cohortlens.catalog import composed as c
from cohortlens.catalog import standins as s
from cohortlens.catalog.registry import REGISTRY, query
from cohortlens.operators import bitmaps as b
from cohortlens.operators.retention_state import RetentionState, retention_of_state
from cohortlens.operators.periods import clean_use_type
from cohortlens.plans import reward_cohort as rw
from cohortlens.plans import usage_periods as up
from cohortlens.plans.first_day import first_day_exposure
from cohortlens.sources import extract_sets as sets
from cohortlens.sources import warehouse as w
from cohortlens.sources.csv_records import read_checked
from cohortlens.sources.scans import date_partitions

#: Buckets of the tables on the user.
BUCKETS = 8


def _paths(sf: str, *names: str) -> list[str]:
    return [f"{sf}/{name}.parquet" for name in names]


def daily_log(spark, sf):
    """The recommendation log with one directory for each day."""
    return w.stored(spark, "daily_log", _paths(sf, "events"), lambda: s.event_log(spark, sf), w.by_day)


def _by_user(spark, sf, name, user, build):
    paths = _paths(sf, "events", "customer")
    write = partial(w.by_bucket, user=user, buckets=BUCKETS)
    return w.stored(spark, f"{name}_by_{user}", paths, lambda: build(spark, sf), write)


@query("cohort_first_day", s.with_inputs(s.LOG_SQL, *c._USER_INPUTS, c._COHORT_SQL, body="""
SELECT n.user_id, CAST(approval_time_kst AS DATE) AS approval_date, count(registered_time) AS first_day_rcmds,
  count(CASE WHEN like_time IS NOT NULL OR dislike_time IS NOT NULL THEN 1 END) AS first_day_answers
FROM user_info n
LEFT JOIN log ON user1_id = n.user_id AND date_ymd_kst = strftime(approval_time_kst, '%Y-%m-%d')
GROUP BY ALL"""))
def cohort_first_day(spark, sf):
    return first_day_exposure(rw.with_approval_date(c._cohort(spark, sf)), daily_log(spark, sf))


@query("reward_cohort_bucketed", REGISTRY["reward_cohort"].sql)
def reward_cohort_bucketed(spark, sf):
    return rw.reward_cohort(
        _by_user(spark, sf, "metrics", "user_id", s.activation_metrics),
        _by_user(spark, sf, "accounts", "id", s.accounts),
        _by_user(spark, sf, "log", "user1_id", s.event_log),
        _by_user(spark, sf, "screens", "user_id", s.screen_log),
        _by_user(spark, sf, "box", "assigned_user_id", s.coupon_box),
        _by_user(spark, sf, "code", "assigned_user_id", s.coupon_code),
        s.coupon_source(spark, sf),
        since=c.COHORT[0],
        until=c.COHORT[1],
        log_days=c.LOG_DAYS,
        coupon_since="2024-01-05 00:00:00",
        patterns=s.COUPON_PATTERNS,
        log_by_candidate=_by_user(spark, sf, "log", "user2_id", s.event_log),
    )


@query("retention_by_batches", REGISTRY["cohort_retention"].sql)
def retention_by_batches(spark, sf):
    """Three batches of days merged into a state, and the cohort read off it."""
    screens = w.stored(spark, "daily_screens", _paths(sf, "events"), lambda: s.screen_log(spark, sf), w.by_day)
    state = RetentionState(spark, f"{w.shared_root(spark)}/retention-{uuid.uuid4().hex}", rw.BOX_SCREEN)
    for batch in (("2024-01-01", "2024-01-09"), ("2024-01-10", "2024-01-20"), ("2024-01-21", "2024-01-31")):
        days = state.add_days(screens, *batch)
    return retention_of_state(days, rw.with_approval_date(c._cohort(spark, sf)))


_STAGES = {
    "shown": "registered_time IS NOT NULL",
    "seen": "impression_time IS NOT NULL",
    "opened": "profile_open_time IS NOT NULL",
    "answered": "like_time IS NOT NULL OR dislike_time IS NOT NULL",
    "requested": "friend_request_time IS NOT NULL",
}


@query("stage_users_from_bitmaps", s.with_inputs(s.LOG_SQL, body=f"""
SELECT channel_id, {", ".join(f"CAST(count(DISTINCT CASE WHEN {p} THEN user1_id END) AS BIGINT) AS {n}" for n, p in _STAGES.items())}
FROM log WHERE date_ymd_kst BETWEEN '2024-01-01' AND '2024-01-31' GROUP BY channel_id"""))
def stage_users_from_bitmaps(spark, sf):
    """Users per channel and stage over 31 days, from the bitmaps of single days."""
    log = date_partitions(daily_log(spark, sf), *c.LOG_DAYS)
    daily = b.day_bitmaps(log, ["date_ymd_kst", "channel_id"], "user1_id", _STAGES, b.dense_ids(log, "user1_id"))
    return b.bitmap_counts(daily, ["channel_id"], list(_STAGES))


def _new_folder(spark, name):
    return f"{w.shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@query("csv_extract_read_back", s.with_inputs(s.PEOPLE_SQL, s.EXTRACTS_SQL, body="""
SELECT user_id, relative_score, rcmd_cnt, del_interval_hour FROM exposure_counts"""))
def csv_extract_read_back(spark, sf):
    """The exposure counts as a CSV extract, read by many tasks; a bad record is an error."""
    path = _new_folder(spark, "exposure_counts")
    columns = ["user_id", "relative_score", "rcmd_cnt", "del_interval_hour"]
    sets.write_lines(sets.Extract(s.exposure_counts(spark, sf).select(*columns)), path)
    good, bad = read_checked(spark, path, "exposure_counts")
    if not bad.isEmpty():
        raise ValueError(f"bad records in {path}")
    return good


@query("extract_set_read_back", s.with_inputs(s.PEOPLE_SQL, s.USAGE_SQL, body="""
SELECT ci_hash, CAST(floor(relative_score / 10) AS BIGINT) + 1 AS rs_grade
FROM usage_log WHERE get_referral_reward = 0
QUALIFY row_number() OVER (PARTITION BY ci_hash ORDER BY action_num) = 1"""))
def extract_set_read_back(spark, sf):
    """The user grades out of the published set of all extracts of the spend mix."""
    path = _new_folder(spark, "usage_extracts")
    up.write_usage_extracts(s.usage_log(spark, sf), path)
    grades = sets.read_published(spark, path, "user_grade")
    return grades.select("ci_hash", F.col("rs_grade").cast("bigint").alias("rs_grade"))


@query("use_type_guard", s.with_inputs(s.PEOPLE_SQL, s.USAGE_SQL, body="""
SELECT ci_hash, action_num, quantity FROM usage_log"""))
def use_type_guard(spark, sf):
    """Cleaning of the use type where the log has no such column."""
    return clean_use_type(s.usage_log(spark, sf).select("ci_hash", "action_num", "quantity"))
