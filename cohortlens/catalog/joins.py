"""Join shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog import standins as s
from cohortlens.catalog.registry import query
from cohortlens.operators import matching as m
from cohortlens.operators.distincts import distinct_by_flags
from cohortlens.plans.reward_cohort import used_coupons
from cohortlens.sources.grids import with_grid


@query("computed_key_join", """
SELECT c_custkey, c_name, s_name AS place_title
FROM customer LEFT JOIN supplier ON CAST(s_suppkey AS VARCHAR) = substring(c_name, 17, 3)""")
def computed_key_join(spark, sf):
    channels = s.table(spark, sf, "customer").select(
        "c_custkey", "c_name", F.substring("c_name", 17, 3).alias("_place")
    )
    places = s.table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("_place"), F.col("s_name").alias("place_title")
    )
    return channels.join(places, "_place", "left").drop("_place")


@query("chained_left_join", """
SELECT c_custkey, n_name, r_name FROM customer
LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN region ON 'REGION_' || CAST(r_regionkey AS VARCHAR) = 'REGION_' || substring(n_name, 8, 1)""")
def chained_left_join(spark, sf):
    named = m.left_lookup(
        s.table(spark, sf, "customer"),
        s.table(spark, sf, "nation"),
        F.col("n_nationkey") == F.col("c_nationkey"),
    )
    region_key = F.concat(F.lit("REGION_"), F.col("r_regionkey").cast("string"))
    second_key = F.concat(F.lit("REGION_"), F.substring("n_name", 8, 1))
    return m.left_lookup(named, s.table(spark, sf, "region"), region_key == second_key).select(
        "c_custkey", "n_name", "r_name"
    )


@query("using_join", s.with_inputs(s.COUPONS_SQL, body="""
SELECT source_id, coupon_id, user_id, coupon_name, source_channel
FROM (SELECT id AS coupon_id, source_id, assigned_user_id AS user_id FROM code
      WHERE status = 'USED' AND valid_from IS NOT NULL) c
LEFT JOIN (SELECT id AS source_id, coupon_name, source_channel FROM coupon_source) d USING (source_id)"""))
def using_join(spark, sf):
    sources = s.coupon_source(spark, sf).withColumnRenamed("id", "source_id")
    return used_coupons(s.coupon_code(spark, sf)).join(sources, "source_id", "left")


def _pair_state(spark, sf):
    return (
        s.event_log(spark, sf)
        .filter(F.col("date_ymd_kst") >= "2024-01-03")
        .groupBy("user1_id", "user2_id")
        .agg(
            F.max("friend_request_time").alias("rr_request"),
            F.max("hour_kst").alias("rr_hour"),
            F.max("date_ymd_kst").alias("rr_date"),
            F.max("rcmd_type").alias("rr_type"),
        )
    )


_STATE_SQL = """state AS (
  SELECT user1_id, user2_id, max(friend_request_time) AS rr_request, max(hour_kst) AS rr_hour,
    max(date_ymd_kst) AS rr_date, max(rcmd_type) AS rr_type
  FROM log WHERE date_ymd_kst >= '2024-01-03' GROUP BY 1, 2)"""


def _log_keys(spark, sf):
    return s.event_log(spark, sf).select(
        "event_id", "user1_id", "user2_id", "rcmd_type", "hour_kst", "date_ymd_kst"
    )


@query("theta_residual_join", s.with_inputs(s.LOG_SQL, _STATE_SQL, body="""
SELECT event_id, rc.hour_kst, rc.rcmd_type, rr_request, rr_type FROM log rc
LEFT JOIN state rr ON rc.user1_id = rr.user1_id AND rc.user2_id = rr.user2_id
  AND rc.hour_kst = rr.rr_hour AND rc.rcmd_type <> rr.rr_type"""))
def theta_residual_join(spark, sf):
    residual = (F.col("hour_kst") == F.col("rr_hour")) & (F.col("rcmd_type") != F.col("rr_type"))
    return m.left_with_residual(
        _log_keys(spark, sf), _pair_state(spark, sf), ["user1_id", "user2_id"], residual
    ).select("event_id", "hour_kst", "rcmd_type", "rr_request", "rr_type")


@query("self_eq_join", s.with_inputs(s.LOG_SQL, _STATE_SQL, body="""
SELECT event_id, rc.date_ymd_kst, a.rr_date AS any_date, b.rr_date AS same_date FROM log rc
LEFT JOIN state a ON rc.user1_id = a.user1_id AND rc.user2_id = a.user2_id
  AND rc.hour_kst = a.rr_hour AND a.rr_date = a.rr_date
LEFT JOIN state b ON rc.user1_id = b.user1_id AND rc.user2_id = b.user2_id
  AND rc.hour_kst = b.rr_hour AND rc.date_ymd_kst = b.rr_date"""))
def self_eq_join(spark, sf):
    same_hour = F.col("hour_kst") == F.col("rr_hour")
    joined = _log_keys(spark, sf).join(
        _pair_state(spark, sf), ["user1_id", "user2_id"], "left"
    )
    return joined.select(
        "event_id",
        "date_ymd_kst",
        F.when(same_hour & F.col("rr_date").isNotNull(), F.col("rr_date")).alias("any_date"),
        F.when(same_hour & (F.col("date_ymd_kst") == F.col("rr_date")), F.col("rr_date")).alias(
            "same_date"
        ),
    )


@query("existence_flag", s.with_inputs(s.PEOPLE_SQL, s.SCREEN_SQL, body="""
SELECT p.id AS user_id, CASE WHEN x.user_id IS NOT NULL THEN 1 ELSE 0 END AS get_coupon
FROM people p LEFT JOIN (SELECT DISTINCT user_id FROM screens
  WHERE date_ymd_kst >= '2024-01-25' AND list_contains(navigations, 'onboarding_step_mobile_coupon')) x
ON x.user_id = p.id"""))
def existence_flag(spark, sf):
    seen = s.screen_log(spark, sf).filter(
        (F.col("date_ymd_kst") >= "2024-01-25")
        & F.array_contains("navigations", "onboarding_step_mobile_coupon")
    )
    users = s.people(spark, sf).select(F.col("id").alias("user_id"))
    return m.existence_flag(users, seen, "user_id", "get_coupon")


@query("anti_join", """
SELECT event_id, user_id, event_type FROM events
WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value >= 100)""")
def anti_join(spark, sf):
    events = s.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    payers = events.filter((F.col("event_type") == "purchase") & (F.col("value") >= 100))
    return m.without_keys(events.drop("value"), payers, "user_id")


@query("merge_suffix", s.with_inputs(s.PEOPLE_SQL, s.EXTRACTS_SQL, body="""
SELECT e.*, r.cumul_rcmd_2way_response_users AS cumul_rcmd_2way_response_users_rr, r.rr_rows
FROM early_exposure e LEFT JOIN (
  SELECT user2_id, max(cumul_rcmd_2way_response_users) AS cumul_rcmd_2way_response_users, count(*) AS rr_rows
  FROM early_response GROUP BY user2_id) r ON r.user2_id = e.user2_id"""))
def merge_suffix(spark, sf):
    right = (
        s.early_response(spark, sf)
        .groupBy("user2_id")
        .agg(
            F.max("cumul_rcmd_2way_response_users").alias("cumul_rcmd_2way_response_users"),
            F.count("*").alias("rr_rows"),
        )
    )
    return m.merge_renamed(
        s.early_exposure(spark, sf),
        right,
        "user2_id",
        ["cumul_rcmd_2way_response_users", "rr_rows"],
        "_rr",
    )


@query("fanout_distinct", s.with_inputs(s.PEOPLE_SQL, s.ACTIVITY_SQL, s.METRICS_SQL, s.GRANT_SQL, body="""
SELECT gender, count(DISTINCT u.user_id) AS num_users,
  count(DISTINCT CASE WHEN source_type = 'MALE_NEW_USER_FIRST_JOIN_V1' THEN u.user_id END) AS num_rewarded
FROM metrics u LEFT JOIN grants g ON g.user_id = u.user_id GROUP BY gender"""))
def fanout_distinct(spark, sf):
    users = s.activation_metrics(spark, sf).select("user_id", "gender")
    rewarded = s.reward_grant(spark, sf).filter(
        F.col("source_type") == "MALE_NEW_USER_FIRST_JOIN_V1"
    )
    flagged = m.existence_flag(users, rewarded, "user_id", "_rewarded")
    return distinct_by_flags(
        flagged,
        ["gender"],
        "user_id",
        {"num_users": "true", "num_rewarded": "_rewarded = 1"},
    )


@query("role_swap_join", s.with_inputs(s.LOG_SQL, body="""
SELECT a.user_id, a.shown, a.requested, b.candidate, b.requested_by FROM (
  SELECT user1_id AS user_id, count(DISTINCT user2_id) AS shown,
    count(DISTINCT CASE WHEN friend_request_time IS NOT NULL THEN user2_id END) AS requested
  FROM log GROUP BY 1) a
LEFT JOIN (
  SELECT user2_id AS user_id, count(DISTINCT user1_id) AS candidate,
    count(DISTINCT CASE WHEN friend_request_time IS NOT NULL THEN user1_id END) AS requested_by
  FROM log GROUP BY 1) b ON a.user_id = b.user_id"""))
def role_swap_join(spark, sf):
    sides = m.both_roles(
        s.event_log(spark, sf), "user1_id", "user2_id", ["friend_request_time"]
    ).filter(F.col("user_id").isNotNull())
    known = F.col("other_id").isNotNull()
    asked = known & F.col("friend_request_time").isNotNull()
    per_pair = sides.groupBy("user_id", "role", "other_id").agg(
        F.max(F.when(known, 1).otherwise(0)).alias("seen"),
        F.max(F.when(asked, 1).otherwise(0)).alias("asked"),
    )

    def side(role, column):
        return F.sum(F.when(F.col("role") == role, F.col(column)))

    return (
        per_pair.groupBy("user_id")
        .agg(
            side(1, "seen").alias("shown"),
            side(1, "asked").alias("requested"),
            side(2, "seen").alias("candidate"),
            side(2, "asked").alias("requested_by"),
        )
        .filter(F.col("shown").isNotNull())
    )


@query("cross_grid", s.with_inputs(s.PEOPLE_SQL, body="""
SELECT id AS user_id, CAST(minute_offset AS INTEGER) AS minute_offset
FROM people CROSS JOIN (SELECT unnest(generate_series(0, 1440)) AS minute_offset)
WHERE minute_offset * 5 <= 60 * 2 AND minute_offset >= 0"""))
def cross_grid(spark, sf):
    users = s.people(spark, sf).select(F.col("id").alias("user_id"))
    return with_grid(users, 60 * 2 // 5, "minute_offset")
