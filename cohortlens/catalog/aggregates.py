"""Aggregations, windows, sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog import standins as s
from cohortlens.catalog.registry import query
from cohortlens.functions.measures import any_flag, count_when, percent
from cohortlens.operators.distincts import distinct_by_flags
from cohortlens.operators.firsts import best_per_key, first_per_key, top_rows
from cohortlens.operators.funnel import two_sided_funnel
from cohortlens.operators.matching import both_roles
from cohortlens.operators.running import running_totals
from cohortlens.operators.running import running_sums


@query("conditional_counts", s.with_inputs(s.LOG_SQL, body="""
SELECT hour_kst, count(registered_time) AS all_cnt,
  count(CASE WHEN like_time IS NOT NULL THEN registered_time END) AS like_cnt,
  count(CASE WHEN rcmd_type = 80 THEN registered_time END) AS focus_cnt,
  count(CASE WHEN rcmd_type = 80 AND like_time IS NOT NULL THEN like_time END) AS focus_like_cnt,
  max(rcmd_type) AS max_type, max(registered_time) AS last_time, max(date_ymd_kst) AS last_date
FROM log GROUP BY hour_kst"""))
def conditional_counts(spark, sf):
    focus, liked = F.col("rcmd_type") == 80, F.col("like_time").isNotNull()
    time = F.col("registered_time")
    return s.event_log(spark, sf).groupBy("hour_kst").agg(
        F.count("registered_time").alias("all_cnt"),
        count_when(liked, time).alias("like_cnt"),
        count_when(focus, time).alias("focus_cnt"),
        count_when(focus & liked, F.col("like_time")).alias("focus_like_cnt"),
        F.max("rcmd_type").alias("max_type"),
        F.max("registered_time").alias("last_time"),
        F.max("date_ymd_kst").alias("last_date"),
    )


_STAGE_FLAGS = {
    "rcmd_users": "true",
    "impression_users": "impression_time IS NOT NULL",
    "response_users": "like_time IS NOT NULL OR dislike_time IS NOT NULL",
    "request_users": "friend_request_time IS NOT NULL",
}


_STAGES_SQL = """
  count(DISTINCT user2_id) AS rcmd_users,
  count(DISTINCT CASE WHEN impression_time IS NOT NULL THEN user2_id END) AS impression_users,
  count(DISTINCT CASE WHEN like_time IS NOT NULL OR dislike_time IS NOT NULL THEN user2_id END) AS response_users,
  count(DISTINCT CASE WHEN friend_request_time IS NOT NULL THEN user2_id END) AS request_users
"""


@query("conditional_distinct", s.with_inputs(
    s.LOG_SQL, body=f"SELECT user1_id, date_ymd_kst, {_STAGES_SQL} FROM log GROUP BY 1, 2"))
def conditional_distinct(spark, sf):
    return distinct_by_flags(
        s.event_log(spark, sf), ["user1_id", "date_ymd_kst"], "user2_id", _STAGE_FLAGS
    )


@query("distinct_by_flags", s.with_inputs(
    s.LOG_SQL, body=f"SELECT user1_id, {_STAGES_SQL} FROM log GROUP BY 1"))
def distinct_by_flags_query(spark, sf):
    return distinct_by_flags(s.event_log(spark, sf), ["user1_id"], "user2_id", _STAGE_FLAGS)


@query("ratio_having", s.with_inputs(s.LOG_SQL, body="""
SELECT user_group, hour_kst, user_cnt, focus_cnt,
  (liked * 2000 + focus_cnt) // nullif(2 * focus_cnt, 0) / 10 AS focus_like_ratio
FROM (SELECT CAST(user1_id % 2 AS BIGINT) AS user_group, hour_kst, count(DISTINCT user1_id) AS user_cnt,
    count(CASE WHEN rcmd_type = 80 THEN 1 END) AS focus_cnt,
    count(CASE WHEN rcmd_type = 80 AND like_time IS NOT NULL THEN 1 END) AS liked
  FROM log GROUP BY 1, 2 HAVING count(DISTINCT user1_id) > 5)"""))
def ratio_having(spark, sf):
    focus = F.col("rcmd_type") == 80
    per_user = s.event_log(spark, sf).groupBy("user1_id", "hour_kst").agg(
        count_when(focus).alias("focus_cnt"),
        count_when(focus & F.col("like_time").isNotNull()).alias("liked"),
    )
    return (
        per_user.groupBy((F.col("user1_id") % 2).alias("user_group"), "hour_kst")
        .agg(
            F.count("user1_id").alias("user_cnt"),
            F.sum("focus_cnt").alias("focus_cnt"),
            F.sum("liked").alias("liked"),
        )
        .filter(F.col("user_cnt") > 5)
        .withColumn(
            "focus_like_ratio", percent(F.col("liked"), F.col("focus_cnt")).cast("double")
        )
        .drop("liked")
    )


@query("avg_when_scaled", s.with_inputs(s.LOG_SQL, body="""
SELECT hour_kst, round(avg(CASE WHEN rcmd_type = 80 THEN min_distance END) / 1000, 6) AS focus_distance,
  round(avg(CASE WHEN rcmd_type = 80 AND like_time IS NOT NULL THEN min_distance END) / 1000, 6) AS like_distance
FROM log GROUP BY hour_kst"""))
def avg_when_scaled(spark, sf):
    focus, distance = F.col("rcmd_type") == 80, F.col("min_distance")
    liked = F.col("like_time").isNotNull()
    return s.event_log(spark, sf).groupBy("hour_kst").agg(
        F.round(F.avg(F.when(focus, distance)) / 1000, 6).alias("focus_distance"),
        F.round(F.avg(F.when(focus & liked, distance)) / 1000, 6).alias("like_distance"),
    )


@query("distinct_star", """
SELECT DISTINCT l_returnflag, l_linestatus, n.* FROM lineitem
JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation n ON n_nationkey = s_nationkey""")
def distinct_star(spark, sf):
    # Distinct before each join: the fact shrinks to its used keys first.
    used = s.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey").distinct()
    suppliers = s.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    kinds = (
        used.join(suppliers, F.col("s_suppkey") == F.col("l_suppkey"))
        .select("l_returnflag", "l_linestatus", "s_nationkey")
        .distinct()
    )
    nations = s.table(spark, sf, "nation")
    return (
        kinds.join(nations, F.col("n_nationkey") == F.col("s_nationkey"), "left")
        .select("l_returnflag", "l_linestatus", *nations.columns)
        .distinct()
    )


@query("two_level_agg", s.with_inputs(s.SCREEN_SQL, body="""
SELECT user_id, count(*) AS active_days, max(daily) AS busiest_day, max(box) AS check_coupon_box FROM (
  SELECT user_id, date_ymd_kst, count(*) AS daily,
    max(CASE WHEN list_contains(navigations, 'mobile_coupon') THEN 1 ELSE 0 END) AS box
  FROM screens GROUP BY 1, 2) GROUP BY user_id"""))
def two_level_agg(spark, sf):
    daily = s.screen_log(spark, sf).groupBy("user_id", "date_ymd_kst").agg(
        F.count("*").alias("daily"),
        any_flag(F.array_contains("navigations", "mobile_coupon")).alias("box"),
    )
    return daily.groupBy("user_id").agg(
        F.count("*").alias("active_days"),
        F.max("daily").alias("busiest_day"),
        F.max("box").alias("check_coupon_box"),
    )


@query("null_propagating_add", s.with_inputs(s.LOG_SQL, body="""
SELECT a.user_id, a.joined AS own, b.joined AS other, a.joined + b.joined AS both_sides FROM (
  SELECT user1_id AS user_id, count(joined_time) AS joined FROM log GROUP BY 1) a
LEFT JOIN (SELECT user2_id AS user_id, count(joined_time) AS joined FROM log GROUP BY 1) b
  ON a.user_id = b.user_id"""))
def null_propagating_add(spark, sf):
    sides = both_roles(s.event_log(spark, sf), "user1_id", "user2_id", ["joined_time"]).filter(
        F.col("user_id").isNotNull()
    )
    joined = F.when(F.col("joined_time").isNotNull(), 1).otherwise(0)

    def side(role):
        return F.sum(F.when(F.col("role") == role, joined))

    return (
        sides.groupBy("user_id")
        .agg(side(1).alias("own"), side(2).alias("other"), (side(1) + side(2)).alias("both_sides"))
        .filter(F.col("own").isNotNull())
    )


@query("funnel_window_counts", s.with_inputs(s.LOG_SQL, s.ACTIVITY_SQL, body="""
SELECT user1_id AS user_id,
  count(DISTINCT CASE WHEN date_sub('hour', first_approval_time, impression_time) <= 72 THEN user2_id END) AS rcmd_imp,
  count(DISTINCT CASE WHEN date_sub('hour', first_approval_time, joined_time) <= 120 THEN user2_id END) AS rcmd_join_10d
FROM log JOIN activity ON id = user1_id GROUP BY 1"""))
def funnel_window_counts(spark, sf):
    cohort = s.activation_metrics(spark, sf).filter(F.col("first_approval_time").isNotNull())
    return two_sided_funnel(
        s.event_log(spark, sf), cohort, short=72, ten_days=120, late=(72, 240)
    ).select("user_id", "rcmd_imp", "rcmd_join_10d")


@query("first_per_pair", s.with_inputs(s.LOG_SQL, body="""
SELECT event_id, user1_id, user2_id, registered_time FROM (
  SELECT *, row_number() OVER (PARTITION BY user1_id, user2_id ORDER BY registered_time, event_id) AS rn FROM log)
WHERE rn = 1"""))
def first_per_pair(spark, sf):
    log = s.event_log(spark, sf).select("event_id", "user1_id", "user2_id", "registered_time")
    return first_per_key(
        log, ["user1_id", "user2_id"], [F.asc_nulls_last("registered_time"), F.asc("event_id")]
    )


@query("latest_per_key", """
SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE ts <= TIMESTAMP '2024-01-20') WHERE rn = 1""")
def latest_per_key(spark, sf):
    events = s.table(spark, sf, "events").filter(F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz"))
    latest = [F.col("ts"), F.col("event_id")]
    return best_per_key(events, ["user_id"], latest, ["event_id", "event_type", "value"])


@query("max_per_key", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
WHERE rn = 1""")
def max_per_key(spark, sf):
    orders = s.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    largest = [F.col("o_totalprice"), -F.col("o_orderkey")]
    return best_per_key(orders, ["o_custkey"], largest, ["o_orderkey", "o_totalprice"])


@query("running_sums", s.with_inputs(s.LOG_SQL, body="""
SELECT user1_id, date_ymd_kst, shown, requested,
  CAST(sum(shown) OVER w AS BIGINT) AS cumul_shown, CAST(sum(requested) OVER w AS BIGINT) AS cumul_requested
FROM (SELECT user1_id, date_ymd_kst, count(*) AS shown, count(friend_request_time) AS requested
      FROM log GROUP BY 1, 2)
WINDOW w AS (PARTITION BY user1_id ORDER BY date_ymd_kst ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def running_sums_query(spark, sf):
    daily = s.event_log(spark, sf).groupBy("user1_id", "date_ymd_kst").agg(
        F.count("*").alias("shown"), F.count("friend_request_time").alias("requested")
    )
    return running_sums(daily, ["user1_id"], [F.asc("date_ymd_kst")], ["shown", "requested"])


@query("running_totals", """
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS action_num,
  CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS purchases
FROM events""")
def running_totals_query(spark, sf):
    return running_totals(
        s.table(spark, sf, "events"),
        ["user_id"],
        [F.asc("ts"), F.asc("event_id")],
        F.unix_date(F.to_date("ts")) * 24 + F.hour("ts"),
        {
            "action_num": F.lit(1),
            "purchases": F.when(F.col("event_type") == "purchase", 1).otherwise(0),
        },
    ).select("event_id", "action_num", "purchases")


@query("topk_nulls_last", s.with_inputs(s.LOG_SQL, body="""
SELECT event_id, user2_id, like_time FROM log
ORDER BY like_time DESC NULLS LAST, user2_id DESC NULLS LAST, event_id LIMIT 10"""))
def topk_nulls_last(spark, sf):
    log = s.event_log(spark, sf).select("event_id", "user2_id", "like_time")
    order = [F.desc_nulls_last("like_time"), F.desc_nulls_last("user2_id"), F.asc("event_id")]
    return top_rows(log, order, 10)


@query("order_desc_ordinal", """
SELECT o_orderstatus, o_orderpriority, count(*) AS cnt FROM orders GROUP BY 1, 2 ORDER BY 1 DESC, 2""")
def order_desc_ordinal(spark, sf):
    return (
        s.table(spark, sf, "orders")
        .groupBy("o_orderstatus", "o_orderpriority")
        .agg(F.count("*").alias("cnt"))
        .orderBy(F.desc_nulls_last("o_orderstatus"), F.asc_nulls_last("o_orderpriority"))
    )
