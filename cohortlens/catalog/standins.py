"""The job inputs derived from the driver tables, in Spark and as SQL.

Everything is computed from whole tables; a row's stage times, codes and scores are
plain functions of its own columns or of its user's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.times import to_kst
from cohortlens.operators.running import running_totals


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _after(ts: str, interval: str) -> Column:
    return F.col(ts) + F.expr(f"INTERVAL {interval}")


def _counterpart() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def _kst_day() -> Column:
    return F.to_date(to_kst(F.col("ts"))).cast("string")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "AUTOMOBILE"), 1)
        .otherwise(0)
        .alias("gender"),
        (F.col("c_acctbal") / 80).alias("relative_score"),
        F.col("c_nationkey").cast("string").alias("location"),
        "c_mktsegment",
        "c_nationkey",
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recommendation log without the user attributes."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "user_id AS user1_id",
        "CASE WHEN value >= 2 THEN CAST(get_json_object(props, '$.k') AS BIGINT) END AS user2_id",
        "ts AS registered_time",
        "CASE WHEN event_type IN ('click', 'purchase') THEN ts + INTERVAL '5' MINUTE END AS profile_open_time",
        "CASE WHEN event_type <> 'error' THEN ts + INTERVAL '1' MINUTE END AS impression_time",
        "CASE WHEN event_type = 'click' THEN ts + INTERVAL '30' MINUTE END AS like_time",
        "CASE WHEN event_type = 'error' THEN ts + INTERVAL '10' MINUTE END AS dislike_time",
        "CASE WHEN event_type = 'purchase' THEN ts + INTERVAL '2' HOUR END AS friend_request_time",
        "CASE WHEN event_type = 'purchase' AND value >= 50 THEN ts + INTERVAL '26' HOUR END AS other_accepted_time",
        "CASE WHEN event_type = 'signup' THEN ts + INTERVAL '3' DAY END AS joined_time",
        """CASE WHEN value < 20 THEN 3 WHEN value < 35 THEN 80 WHEN value < 50 THEN 4
             WHEN value < 70 THEN 50 WHEN value < 100 THEN 101 WHEN value < 150 THEN 105 END AS rcmd_type""",
        "CASE WHEN hour(ts) < 6 THEN 3 WHEN hour(ts) < 12 THEN 21 WHEN hour(ts) < 18 THEN 5 ELSE 3 END AS channel_id",
        """CASE WHEN value >= 25 THEN map('ml_ver', get_json_object(props, '$.k'))
             ELSE from_json(props, 'map<string,string>') END AS exp_props""",
        "value * 1000 AS min_distance",
        "lpad(CAST(hour(ts + INTERVAL '9' HOUR) AS STRING), 2, '0') AS hour_kst",
        "CAST(CAST(ts + INTERVAL '9' HOUR AS DATE) AS STRING) AS date_ymd_kst",
    )


LOG_SQL = """log AS (
  SELECT event_id, user_id AS user1_id,
    CASE WHEN value >= 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS user2_id,
    ts AS registered_time,
    CASE WHEN event_type IN ('click', 'purchase') THEN ts + INTERVAL 5 MINUTE END AS profile_open_time,
    CASE WHEN event_type <> 'error' THEN ts + INTERVAL 1 MINUTE END AS impression_time,
    CASE WHEN event_type = 'click' THEN ts + INTERVAL 30 MINUTE END AS like_time,
    CASE WHEN event_type = 'error' THEN ts + INTERVAL 10 MINUTE END AS dislike_time,
    CASE WHEN event_type = 'purchase' THEN ts + INTERVAL 2 HOUR END AS friend_request_time,
    CASE WHEN event_type = 'purchase' AND value >= 50 THEN ts + INTERVAL 26 HOUR END AS other_accepted_time,
    CASE WHEN event_type = 'signup' THEN ts + INTERVAL 3 DAY END AS joined_time,
    CASE WHEN value < 20 THEN 3 WHEN value < 35 THEN 80 WHEN value < 50 THEN 4
         WHEN value < 70 THEN 50 WHEN value < 100 THEN 101 WHEN value < 150 THEN 105 END AS rcmd_type,
    CASE WHEN hour(ts) < 6 THEN 3 WHEN hour(ts) < 12 THEN 21 WHEN hour(ts) < 18 THEN 5 ELSE 3 END AS channel_id,
    CASE WHEN value >= 25 THEN json_extract_string(props, '$.k') END AS ml_ver,
    value * 1000 AS min_distance,
    strftime(ts + INTERVAL 9 HOUR, '%H') AS hour_kst,
    strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS date_ymd_kst
  FROM events)"""

PEOPLE_SQL = """people AS (
  SELECT c_custkey AS id,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 1 ELSE 0 END AS gender,
    c_acctbal / 80 AS relative_score, CAST(c_nationkey AS VARCHAR) AS location,
    c_mktsegment, c_nationkey
  FROM customer)"""


def recommendation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with the genders of both users and the score of the first."""
    who = people(spark, sf_dir)
    first = who.select(
        F.col("id").alias("user1_id"),
        F.col("gender").alias("user1_gender"),
        F.col("relative_score").alias("user1_relative_score"),
    )
    second = who.select(F.col("id").alias("user2_id"), F.col("gender").alias("user2_gender"))
    log = event_log(spark, sf_dir)
    return log.join(first, "user1_id", "left").join(second, "user2_id", "left")


FULL_LOG_SQL = """full_log AS (
  SELECT l.*, a.gender AS user1_gender, a.relative_score AS user1_relative_score, b.gender AS user2_gender
  FROM log l LEFT JOIN people a ON a.id = l.user1_id LEFT JOIN people b ON b.id = l.user2_id)"""


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(
        F.min("ts").alias("first_approval_time"),
        F.max("ts").alias("last_active_at"),
        F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("approval_time"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = people(spark, sf_dir).join(_activity(spark, sf_dir), "id", "left")
    return joined.select(
        "id", "gender", "relative_score", "location", "first_approval_time", "approval_time"
    )


def activation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = people(spark, sf_dir).join(_activity(spark, sf_dir), "id", "left")
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    return joined.select(
        F.col("id").alias("user_id"),
        "gender",
        "first_approval_time",
        "last_active_at",
        F.when(segment.isin("FURNITURE", "BUILDING"), 1).when(segment == "MACHINERY", 2).alias(
            "mobile_hash_user_seq"
        ),
        F.when(nation < 10, 1).when(nation < 15, 2).alias("ci_hash_user_seq"),
    )


ACTIVITY_SQL = """activity AS (
  SELECT user_id AS id, min(ts) AS first_approval_time, max(ts) AS last_active_at,
    min(CASE WHEN event_type = 'signup' THEN ts END) AS approval_time
  FROM events GROUP BY user_id)"""

ACCOUNTS_SQL = """accounts AS (
  SELECT p.id, gender, relative_score, location, first_approval_time, approval_time
  FROM people p LEFT JOIN activity a ON a.id = p.id)"""

METRICS_SQL = """metrics AS (
  SELECT p.id AS user_id, gender, first_approval_time, last_active_at,
    CASE WHEN c_mktsegment IN ('FURNITURE', 'BUILDING') THEN 1 WHEN c_mktsegment = 'MACHINERY' THEN 2 END
      AS mobile_hash_user_seq,
    CASE WHEN c_nationkey < 10 THEN 1 WHEN c_nationkey < 15 THEN 2 END AS ci_hash_user_seq
  FROM people p LEFT JOIN activity a ON a.id = p.id)"""


def screen_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.array(
            F.col("event_type"),
            F.when(value >= 50, "mobile_coupon").otherwise("home"),
            F.when(value < 10, "onboarding_step_mobile_coupon").otherwise("profile"),
        ).alias("navigations"),
        _kst_day().alias("date_ymd_kst"),
    )


SCREEN_SQL = """screens AS (
  SELECT event_id, user_id,
    [event_type, CASE WHEN value >= 50 THEN 'mobile_coupon' ELSE 'home' END,
     CASE WHEN value < 10 THEN 'onboarding_step_mobile_coupon' ELSE 'profile' END] AS navigations,
    strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS date_ymd_kst
  FROM events)"""


def coupon_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type") == "purchase")
        .select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("created_at"),
            F.when(F.col("value") >= 30, _after("ts", "'1' DAY")).alias("received_at"),
            F.col("user_id").alias("assigned_user_id"),
        )
    )


def coupon_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        _counterpart().alias("source_id"),
        F.col("user_id").alias("assigned_user_id"),
        F.when(F.col("event_type").isin("purchase", "click"), "USED")
        .otherwise("ISSUED")
        .alias("status"),
        F.when(F.col("value") >= 5, F.col("ts")).alias("valid_from"),
    )


def coupon_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("coupon_name"),
        F.col("p_type").alias("source_channel"),
    )


COUPON_PATTERNS = {
    "counts_1d_am": "%ring%",
    "counts_2d_am": "%hot%",
    "counts_4d_cl": "%hot ring%",
    "counts_7d_cl": "%gear",
    "counts_7d_am": "old%",
}

COUPONS_SQL = """box AS (
  SELECT event_id AS id, ts AS created_at, CASE WHEN value >= 30 THEN ts + INTERVAL 1 DAY END AS received_at,
    user_id AS assigned_user_id
  FROM events WHERE event_type = 'purchase'),
code AS (
  SELECT event_id AS id, ts AS created_at, CAST(json_extract_string(props, '$.k') AS BIGINT) AS source_id,
    user_id AS assigned_user_id,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'USED' ELSE 'ISSUED' END AS status,
    CASE WHEN value >= 5 THEN ts END AS valid_from
  FROM events),
coupon_source AS (SELECT p_partkey AS id, p_name AS coupon_name, p_type AS source_channel FROM part)"""


def reward_grant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type") == "signup")
        .select(
            "user_id",
            F.when(F.col("value") < 4, "MALE_NEW_USER_FIRST_JOIN_V1")
            .otherwise("OTHER")
            .alias("source_type"),
        )
    )


GRANT_SQL = """grants AS (
  SELECT user_id, CASE WHEN value < 4 THEN 'MALE_NEW_USER_FIRST_JOIN_V1' ELSE 'OTHER' END AS source_type
  FROM events WHERE event_type = 'signup')"""

SNAPSHOT_DAYS = ["2024-01-05", "2024-01-15", "2024-01-20"]


def _snapshotted(df: DataFrame) -> DataFrame:
    days = F.array(*[F.lit(d) for d in SNAPSHOT_DAYS])
    return df.withColumn("date_ymd_snapshot", F.explode(days))


def channel_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        _counterpart().alias("channel_id"),
        F.when(kind == "view", 0).when(kind == "click", 1).when(kind == "purchase", 2)
        .when(kind == "signup", 3).otherwise(9).alias("rcmd_type"),
        _kst_day().alias("date_ymd_kst"),
    )


def type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("rcmd_type"), F.col("r_name").alias("rcmd_type_name")
    )


def channel_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshotted(
        table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name")
        )
    )


def place_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshotted(
        table(spark, sf_dir, "supplier").select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("title")
        )
    )


CHANNELS_SQL = """channel_daily AS (
  SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS channel_id,
    CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 9 END
      AS rcmd_type,
    strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS date_ymd_kst
  FROM events),
type_map AS (SELECT r_regionkey AS rcmd_type, r_name AS rcmd_type_name FROM region),
snapshot_days AS (SELECT unnest(['2024-01-05', '2024-01-15', '2024-01-20']) AS date_ymd_snapshot),
channels AS (SELECT c_custkey AS id, c_name AS name, date_ymd_snapshot FROM customer, snapshot_days),
places AS (SELECT s_suppkey AS id, s_name AS title, date_ymd_snapshot FROM supplier, snapshot_days)"""


def _user_hash() -> Column:
    return F.concat(F.lit("u"), F.col("user_id").cast("string"))


def _user_group() -> Column:
    return F.when(F.col("user_id") % 2 == 0, "A").otherwise("B")


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered actions per user with purchases, spend, use type and description."""
    kind, value = F.col("event_type"), F.col("value")
    paid = (kind == "purchase") & (value >= 100)
    events = table(spark, sf_dir, "events")
    numbered = running_totals(
        events,
        ["user_id"],
        [F.asc("ts"), F.asc("event_id")],
        F.unix_date(F.to_date("ts")) * 24 + F.hour("ts"),
        {"action_num": F.lit(1), "purchases": F.when(paid, 1).otherwise(0)},
    )
    who = people(spark, sf_dir).select(F.col("id").alias("user_id"), "relative_score", "c_mktsegment")
    return numbered.join(who, "user_id", "left").select(
        _user_hash().alias("ci_hash"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", 1).otherwise(0).alias("get_referral_reward"),
        "relative_score",
        _user_group().alias("user_group"),
        F.when(paid, F.col("purchases").cast("double")).alias("purchase_num"),
        "action_num",
        F.when(value < 1, None).when(kind == "purchase", value).otherwise(-value).alias("quantity"),
        F.when(kind == "view", "타임어택").when(kind != "error", kind).alias("use_type"),
        F.when(value < 25, "a").when(value < 60, "b").when(value < 150, "c").alias("description"),
    )


USAGE_SQL = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS action_num,
    CASE WHEN event_type = 'purchase' AND value >= 100 THEN CAST(
      sum(CASE WHEN event_type = 'purchase' AND value >= 100 THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) END AS purchase_num
  FROM events),
usage_log AS (
  SELECT 'u' || CAST(n.user_id AS VARCHAR) AS ci_hash,
    CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS get_referral_reward,
    relative_score, CASE WHEN n.user_id % 2 = 0 THEN 'A' ELSE 'B' END AS user_group,
    purchase_num, action_num,
    CASE WHEN value < 1 THEN NULL WHEN event_type = 'purchase' THEN value ELSE -value END AS quantity,
    CASE WHEN event_type = 'view' THEN '타임어택' WHEN event_type <> 'error' THEN event_type END AS use_type,
    CASE WHEN value < 25 THEN 'a' WHEN value < 60 THEN 'b' WHEN value < 150 THEN 'c' END AS description
  FROM numbered n LEFT JOIN people p ON p.id = n.user_id)"""


def _scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = people(spark, sf_dir).select(F.col("id").alias("o_custkey"), "relative_score")
    return table(spark, sf_dir, "orders").join(score, "o_custkey", "left")


def exposure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_orders(spark, sf_dir).select(
        "o_orderkey",
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("relative_score") > -10, F.col("relative_score")).alias("relative_score"),
        F.floor(F.col("o_totalprice") / 400).alias("rcmd_cnt"),
        (F.dayofyear("o_orderdate") / 10).alias("del_interval_hour"),
    )


def early_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return _scored_orders(spark, sf_dir).select(
        "o_orderkey",
        F.col("o_custkey").alias("user2_id"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("min_rc"),
        F.floor(price / 150).alias("cumul_rcmd_users"),
        F.floor(price / 700).alias("cumul_rcmd_response_users"),
        F.floor(price / 1500).alias("cumul_rcmd_2way_response_users"),
        F.col("relative_score").alias("user2_relative_score"),
    )


def early_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("user2_id"),
        F.floor(F.hour("ts") / 6).alias("min_rr"),
        F.floor("value").alias("cumul_rcmd_2way_response_users"),
    )


EXTRACTS_SQL = """exposure_counts AS (
  SELECT o_orderkey, o_custkey AS user_id, CASE WHEN relative_score > -10 THEN relative_score END AS relative_score,
    CAST(floor(o_totalprice / 400) AS BIGINT) AS rcmd_cnt, dayofyear(o_orderdate) / 10.0 AS del_interval_hour
  FROM orders LEFT JOIN people ON id = o_custkey),
early_exposure AS (
  SELECT o_orderkey, o_custkey AS user2_id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS min_rc,
    CAST(floor(o_totalprice / 150) AS BIGINT) AS cumul_rcmd_users,
    CAST(floor(o_totalprice / 700) AS BIGINT) AS cumul_rcmd_response_users,
    CAST(floor(o_totalprice / 1500) AS BIGINT) AS cumul_rcmd_2way_response_users,
    relative_score AS user2_relative_score
  FROM orders LEFT JOIN people ON id = o_custkey),
early_response AS (
  SELECT user_id AS user2_id, CAST(hour(ts) // 6 AS BIGINT) AS min_rr,
    CAST(floor(value) AS BIGINT) AS cumul_rcmd_2way_response_users
  FROM events)"""


def with_inputs(*definitions: str, body: str) -> str:
    """``body`` behind the given table definitions, in dependency order."""
    return "WITH " + ",\n".join(definitions) + "\n" + body.strip()
