"""Time arithmetic, scans, projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog import standins as s
from cohortlens.catalog.registry import query
from cohortlens.functions import times as t
from cohortlens.functions.measures import any_flag
from cohortlens.operators.distincts import distinct_by_flags
from cohortlens.sources.grids import with_grid
from cohortlens.sources.scans import date_partitions, in_hours, snapshots


def _with_approval(spark, sf):
    """Each log row with its user's approval times (before the approval for some)."""
    users = s.accounts(spark, sf).select(
        F.col("id").alias("user1_id"), "first_approval_time", "approval_time"
    )
    log = s.event_log(spark, sf).select("event_id", "user1_id", "registered_time", "joined_time")
    return log.join(users, "user1_id")


_WITH_APPROVAL = """with_approval AS (
  SELECT event_id, registered_time, joined_time, first_approval_time, approval_time
  FROM log JOIN accounts ON id = user1_id)"""
_APPROVAL_INPUTS = [s.LOG_SQL, s.PEOPLE_SQL, s.ACTIVITY_SQL, s.ACCOUNTS_SQL, _WITH_APPROVAL]


@query("hour_diff_bucket", s.with_inputs(*_APPROVAL_INPUTS, body="""
SELECT event_id,
  CAST(date_sub('hour', approval_time, registered_time) AS BIGINT) AS hours_since,
  CAST(date_sub('hour', first_approval_time, joined_time) AS BIGINT) AS hours_to_join,
  CAST(date_diff('day', CAST(first_approval_time + INTERVAL 9 HOUR AS DATE),
                 CAST(registered_time + INTERVAL 9 HOUR AS DATE)) AS INTEGER) AS day_gap
FROM with_approval"""))
def hour_diff_bucket(spark, sf):
    rows = _with_approval(spark, sf)
    return rows.select(
        "event_id",
        t.full_hours("approval_time", "registered_time").alias("hours_since"),
        t.full_hours("first_approval_time", "joined_time").alias("hours_to_join"),
        t.day_gap(
            t.kst_date(F.col("first_approval_time")), t.kst_date(F.col("registered_time"))
        ).alias("day_gap"),
    )


@query("minute_bucket_div", s.with_inputs(*_APPROVAL_INPUTS, body="""
SELECT event_id, CAST(date_sub('minute', approval_time, registered_time) AS BIGINT) AS minutes_since,
  CAST(date_sub('minute', approval_time, registered_time) // 5 AS BIGINT) AS min_rc
FROM with_approval"""))
def minute_bucket_div(spark, sf):
    rows = _with_approval(spark, sf)
    minutes = t.full_minutes("approval_time", "registered_time")
    return rows.select(
        "event_id", minutes.alias("minutes_since"), t.time_bucket(minutes, 5).alias("min_rc")
    )


@query("kst_cohort_sargable", """
SELECT event_id, user_id, ts + INTERVAL 9 HOUR AS ts_kst FROM events
WHERE ts BETWEEN CAST('2024-01-05 00:00:00' AS TIMESTAMP) - INTERVAL 9 HOUR
             AND CAST('2024-01-12 00:00:00' AS TIMESTAMP) - INTERVAL 9 HOUR""")
def kst_cohort_sargable(spark, sf):
    bounds = t.kst_instant("2024-01-05 00:00:00"), t.kst_instant("2024-01-12 00:00:00")
    return (
        s.table(spark, sf, "events")
        .filter(F.col("ts").between(*bounds))
        .select("event_id", "user_id", t.to_kst(F.col("ts")).alias("ts_kst"))
    )


@query("kst_cohort_date", """
SELECT event_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS kst_date, CAST(ts AS DATE) AS utc_date FROM events
WHERE CAST(ts + INTERVAL 9 HOUR AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def kst_cohort_date(spark, sf):
    return (
        s.table(spark, sf, "events")
        .filter(t.in_kst_days(F.col("ts"), "2024-01-05", "2024-01-20"))
        .select(
            "event_id", t.kst_date(F.col("ts")).alias("kst_date"), F.to_date("ts").alias("utc_date")
        )
    )


@query("date_partition_scan", s.with_inputs(s.LOG_SQL, body="""
SELECT date_ymd_kst, count(*) AS row_cnt,
  count(CASE WHEN date_ymd_kst > '2024-01-10' THEN 1 END) AS after_cnt,
  count(CASE WHEN date_ymd_kst IN ('2024-01-09', '2024-01-10') THEN 1 END) AS listed_cnt
FROM log WHERE date_ymd_kst >= '2024-01-03' AND date_ymd_kst <= '2024-01-25' GROUP BY date_ymd_kst"""))
def date_partition_scan(spark, sf):
    log = date_partitions(s.event_log(spark, sf), since="2024-01-03", until="2024-01-25")
    day = F.col("date_ymd_kst")
    return log.groupBy("date_ymd_kst").agg(
        F.count("*").alias("row_cnt"),
        F.count(F.when(day > "2024-01-10", 1)).alias("after_cnt"),
        F.count(F.when(day.isin("2024-01-09", "2024-01-10"), 1)).alias("listed_cnt"),
    )


@query("snapshot_dim_scan", s.with_inputs(s.CHANNELS_SQL, body="""
SELECT id, name, count(*) AS copies,
  count(CASE WHEN date_ymd_snapshot = '2024-01-20' THEN 1 END) AS latest_copies
FROM channels WHERE date_ymd_snapshot > '2024-01-10' GROUP BY id, name"""))
def snapshot_dim_scan(spark, sf):
    dim = s.channel_snapshot(spark, sf)
    several = snapshots(dim, "2024-01-10", ["id", "name"]).withColumn("_latest", F.lit(0))
    newest = snapshots(dim, "2024-01-10", ["id", "name"], latest_only=True).withColumn(
        "_latest", F.lit(1)
    )
    return (
        several.unionByName(newest)
        .groupBy("id", "name")
        .agg(
            F.count(F.when(F.col("_latest") == 0, 1)).alias("copies"),
            F.count(F.when(F.col("_latest") == 1, 1)).alias("latest_copies"),
        )
    )


@query("derived_table_scan", """
SELECT event_type, count(*) AS cnt, sum(CAST(floor(v) AS BIGINT))::BIGINT AS total
FROM (SELECT event_type, value AS v FROM events WHERE value > 10) x WHERE v < 200 GROUP BY event_type""")
def derived_table_scan(spark, sf):
    derived = (
        s.table(spark, sf, "events")
        .select("event_type", F.col("value").alias("v"))
        .filter(F.col("v") > 10)
    )
    return (
        derived.filter(F.col("v") < 200)
        .groupBy("event_type")
        .agg(F.count("*").alias("cnt"), F.sum(F.floor("v")).alias("total"))
    )


@query("cte_reuse", """
WITH cohort AS (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id)
SELECT c.user_id, c.first_ts, c.last_ts, early_cnt, late_cnt FROM cohort c
LEFT JOIN (SELECT e.user_id, count(*) AS early_cnt FROM events e JOIN cohort c ON c.user_id = e.user_id
           WHERE e.ts < c.first_ts + INTERVAL 7 DAY GROUP BY 1) a ON a.user_id = c.user_id
LEFT JOIN (SELECT e.user_id, count(*) AS late_cnt FROM events e JOIN cohort c ON c.user_id = e.user_id
           WHERE e.event_type = 'purchase' AND e.ts > c.last_ts - INTERVAL 7 DAY GROUP BY 1) b
  ON b.user_id = c.user_id""")
def cte_reuse(spark, sf):
    # Both branches need the same join to the cohort, so it is made once for both.
    events = s.table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    cohort = events.groupBy("user_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    joined = events.join(cohort, "user_id")
    early = F.expr("ts < first_ts + INTERVAL '7' DAY")
    late = F.expr("event_type = 'purchase' AND ts > last_ts - INTERVAL '7' DAY")
    branches = joined.groupBy("user_id").agg(
        F.sum(F.when(early, 1)).alias("early_cnt"), F.sum(F.when(late, 1)).alias("late_cnt")
    )
    return cohort.join(branches, "user_id", "left")


@query("int_grid", """
WITH span AS (
  SELECT user_id, CAST(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS INTEGER) AS days
  FROM events GROUP BY user_id)
SELECT user_id, CAST(unnest(generate_series(0, days)) AS INTEGER) AS day_offset FROM span""")
def int_grid(spark, sf):
    span = (
        s.table(spark, sf, "events")
        .groupBy("user_id")
        .agg(t.day_gap(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).alias("days"))
    )
    return with_grid(span, F.col("days"), "day_offset").drop("days")


@query("star_project_derive", """
SELECT *, l_extendedprice * (1 - l_discount) AS net, l_quantity > 25 AS is_large,
  abs(l_discount - l_tax) AS spread
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_returnflag <> 'N'""")
def star_project_derive(spark, sf):
    return (
        s.table(spark, sf, "lineitem")
        .filter((F.col("l_shipdate") >= t.instant("1996-01-01")) & (F.col("l_returnflag") != "N"))
        .withColumns(
            {
                "net": F.col("l_extendedprice") * (1 - F.col("l_discount")),
                "is_large": F.col("l_quantity") > 25,
                "spread": F.abs(F.col("l_discount") - F.col("l_tax")),
            }
        )
    )


@query("fillna_scalar", s.with_inputs(s.PEOPLE_SQL, s.USAGE_SQL, body="""
SELECT ci_hash, action_num, coalesce(quantity, 0) AS quantity, coalesce(use_type, 'Other') AS use_type,
  coalesce(purchase_num, 0) AS purchase_num
FROM usage_log"""))
def fillna_scalar(spark, sf):
    return (
        s.usage_log(spark, sf)
        .select("ci_hash", "action_num", "quantity", "use_type", "purchase_num")
        .na.fill({"quantity": 0, "purchase_num": 0, "use_type": "Other"})
    )


@query("in_notin_flags", s.with_inputs(s.LOG_SQL, body="""
SELECT event_id, CASE WHEN rcmd_type IN (4, 50, 80, 101, 102, 103, 105) THEN 1 ELSE 0 END AS is_special,
  CASE WHEN rcmd_type NOT IN (4, 50, 80, 101, 102, 103, 105) AND channel_id <> 21 THEN 1 END AS is_plain,
  CASE WHEN friend_request_time IS NOT NULL THEN 1 ELSE 0 END AS requested
FROM log"""))
def in_notin_flags(spark, sf):
    special = F.col("rcmd_type").isin(4, 50, 80, 101, 102, 103, 105)
    return s.event_log(spark, sf).select(
        "event_id",
        F.when(special, 1).otherwise(0).alias("is_special"),
        F.when(~special & (F.col("channel_id") != 21), 1).alias("is_plain"),
        F.when(F.col("friend_request_time").isNotNull(), 1).otherwise(0).alias("requested"),
    )


@query("like_pattern_counts", """
SELECT p_type, count(DISTINCT CASE WHEN p_name LIKE '%ring%' THEN p_partkey END) AS ring_cnt,
  count(DISTINCT CASE WHEN p_name LIKE '%hot%' THEN p_partkey END) AS hot_cnt,
  count(DISTINCT CASE WHEN p_name LIKE '%hot ring%' THEN p_partkey END) AS hot_ring_cnt
FROM part GROUP BY p_type""")
def like_pattern_counts(spark, sf):
    flags = {
        "ring_cnt": "p_name LIKE '%ring%'",
        "hot_cnt": "p_name LIKE '%hot%'",
        "hot_ring_cnt": "p_name LIKE '%hot ring%'",
    }
    return distinct_by_flags(s.table(spark, sf, "part"), ["p_type"], "p_partkey", flags)


@query("array_contains_flag", s.with_inputs(s.SCREEN_SQL, body="""
SELECT user_id, CAST(date_ymd_kst AS DATE) AS active_date,
  max(CASE WHEN list_contains(navigations, 'mobile_coupon') THEN 1 ELSE 0 END) AS check_coupon_box
FROM screens GROUP BY 1, 2"""))
def array_contains_flag(spark, sf):
    return (
        s.screen_log(spark, sf)
        .groupBy("user_id", F.to_date("date_ymd_kst").alias("active_date"))
        .agg(any_flag(F.array_contains("navigations", "mobile_coupon")).alias("check_coupon_box"))
    )


@query("map_key_null", s.with_inputs(s.LOG_SQL, body="""
SELECT hour_kst, count(*) AS row_cnt,
  count(DISTINCT CASE WHEN ml_ver IS NULL THEN registered_time END) AS rb_rcmd_cnt
FROM log GROUP BY hour_kst"""))
def map_key_null(spark, sf):
    return distinct_by_flags_with_rows(s.event_log(spark, sf))


def distinct_by_flags_with_rows(log):
    """Row count next to a distinct count, still without multiplying the rows."""
    no_model = F.col("exp_props")["ml_ver"].isNull()
    per_time = log.groupBy("hour_kst", "registered_time").agg(
        F.count("*").alias("row_cnt"),
        F.max(F.when(no_model & F.col("registered_time").isNotNull(), 1).otherwise(0)).alias("rb"),
    )
    return per_time.groupBy("hour_kst").agg(
        F.sum("row_cnt").alias("row_cnt"), F.sum("rb").alias("rb_rcmd_cnt")
    )


@query("not_coalesce_flags", s.with_inputs(s.PEOPLE_SQL, s.ACTIVITY_SQL, s.METRICS_SQL, body="""
SELECT user_id,
  coalesce(ci_hash_user_seq, 0) = 1 AND NOT coalesce(mobile_hash_user_seq, 0) = 1 AS ci_not_mobile,
  NOT coalesce(ci_hash_user_seq, 0) = 1 AND coalesce(mobile_hash_user_seq, 0) = 1 AS mobile_not_ci
FROM metrics"""))
def not_coalesce_flags(spark, sf):
    ci = F.coalesce(F.col("ci_hash_user_seq"), F.lit(0)) == 1
    mobile = F.coalesce(F.col("mobile_hash_user_seq"), F.lit(0)) == 1
    return s.activation_metrics(spark, sf).select(
        "user_id", (ci & ~mobile).alias("ci_not_mobile"), (~ci & mobile).alias("mobile_not_ci")
    )


@query("hour_boundary_scan", s.with_inputs(s.LOG_SQL, body="""
SELECT event_id, date_ymd_kst, hour_kst FROM log
WHERE (date_ymd_kst = '2024-01-10' AND CAST(hour_kst AS INT) > 11)
   OR date_ymd_kst IN ('2024-01-11', '2024-01-12')
   OR (date_ymd_kst = '2024-01-13' AND CAST(hour_kst AS INT) < 12)"""))
def hour_boundary_scan(spark, sf):
    return (
        s.event_log(spark, sf)
        .filter(in_hours(("2024-01-10", 12), ("2024-01-13", 11)))
        .select("event_id", "date_ymd_kst", "hour_kst")
    )
