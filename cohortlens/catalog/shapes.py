"""Bins, grades, pivots, summaries, periods, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog import standins as s
from cohortlens.catalog.registry import query
from cohortlens.functions import bins
from cohortlens.operators.periods import clean_use_type, label_periods
from cohortlens.operators.pivots import distinct_users_by_bin, mean_by
from cohortlens.operators.quantiles import box_stats, exact_quantiles
from cohortlens.operators.summary import describe_all, describe_numeric
from cohortlens.plans import usage_periods as up
from cohortlens.sources.grids import bin_spine


@query("string_slices", """
SELECT c_custkey, substr(CAST(c_nationkey AS VARCHAR), 1, 3) AS location3, substring(c_name, 17, 3) AS place,
  c_mktsegment || ' 00:00:00' AS stamped, replace(c_name, 'Customer', '친구') AS renamed
FROM customer""")
def string_slices(spark, sf):
    return s.table(spark, sf, "customer").select(
        "c_custkey",
        F.substring(F.col("c_nationkey").cast("string"), 1, 3).alias("location3"),
        F.substring("c_name", 17, 3).alias("place"),
        F.concat("c_mktsegment", F.lit(" 00:00:00")).alias("stamped"),
        F.replace("c_name", F.lit("Customer"), F.lit("친구")).alias("renamed"),
    )


@query("mod_groups", """
SELECT CAST(user_id % 2 AS BIGINT) AS user_group, count(*) AS cnt, count(DISTINCT user_id) AS users
FROM events GROUP BY 1""")
def mod_groups(spark, sf):
    per_user = s.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("cnt"))
    return per_user.groupBy((F.col("user_id") % 2).alias("user_group")).agg(
        F.sum("cnt").alias("cnt"), F.count("user_id").alias("users")
    )


@query("minutes_from_bucket", s.with_inputs(s.PEOPLE_SQL, s.EXTRACTS_SQL, body="""
SELECT o_orderkey, min_rc * 5 AS time, CAST(CAST(CAST(min_rc AS DOUBLE) AS INT) AS VARCHAR) AS bucket_label
FROM early_exposure"""))
def minutes_from_bucket(spark, sf):
    return s.early_exposure(spark, sf).select(
        "o_orderkey",
        (F.col("min_rc") * 5).alias("time"),
        F.col("min_rc").cast("double").cast("int").cast("string").alias("bucket_label"),
    )


@query("score_grade", s.with_inputs(s.PEOPLE_SQL, body="""
SELECT id, CAST(floor(relative_score / 10) AS BIGINT) + 1 AS rs_grade,
  CAST(floor(relative_score / 30) AS BIGINT) + 1 AS grade,
  CASE CAST(floor(relative_score / 30) AS BIGINT) + 1
    WHEN 1 THEN '0-30%' WHEN 2 THEN '30-60%' WHEN 3 THEN '60-90%' WHEN 4 THEN '90%-100%' END AS grade_label
FROM people"""))
def score_grade(spark, sf):
    score = F.col("relative_score")
    return s.people(spark, sf).select(
        "id",
        bins.score_grade(score, 10).alias("rs_grade"),
        bins.score_grade(score, 30).alias("grade"),
        bins.grade_label(bins.score_grade(score, 30)).alias("grade_label"),
    )


@query("cut_left_closed", s.with_inputs(s.PEOPLE_SQL, s.EXTRACTS_SQL, body="""
SELECT CASE WHEN cumul_rcmd_users >= 0 AND cumul_rcmd_users < 3100
    THEN CAST(cumul_rcmd_users // 100 AS INTEGER) END AS bin_idx,
  count(*) AS cnt, min(cumul_rcmd_users) AS lowest, max(cumul_rcmd_users) AS highest
FROM early_exposure GROUP BY 1"""))
def cut_left_closed(spark, sf):
    value = F.col("cumul_rcmd_users")
    return (
        s.early_exposure(spark, sf)
        .groupBy(bins.cut_left_closed(value, 0, 3100, 100).alias("bin_idx"))
        .agg(F.count("*").alias("cnt"), F.min(value).alias("lowest"), F.max(value).alias("highest"))
    )


@query("cut_right_closed", s.with_inputs(s.PEOPLE_SQL, s.EXTRACTS_SQL, body="""
SELECT CASE WHEN rcmd_cnt BETWEEN 0 AND 100 THEN 100
    WHEN rcmd_cnt BETWEEN 101 AND 1000 THEN CAST((rcmd_cnt + 99) // 100 * 100 AS INTEGER) END AS bin,
  count(*) AS cnt, min(rcmd_cnt) AS lowest, max(rcmd_cnt) AS highest
FROM exposure_counts GROUP BY 1"""))
def cut_right_closed(spark, sf):
    value = F.col("rcmd_cnt")
    return (
        s.exposure_counts(spark, sf)
        .groupBy(bins.cut_right_closed(value, 0, 1000, 100).alias("bin"))
        .agg(F.count("*").alias("cnt"), F.min(value).alias("lowest"), F.max(value).alias("highest"))
    )


@query("bin_median_spine", """
WITH binned AS (
  SELECT CASE WHEN l_quantity >= 0 AND l_quantity < 60 THEN CAST(floor(l_quantity / 5) AS INTEGER) END AS bin_idx,
    l_extendedprice FROM lineitem),
spine AS (SELECT CAST(unnest(generate_series(0, 11)) AS INTEGER) AS bin_idx)
SELECT s.bin_idx, CAST(s.bin_idx * 5 AS BIGINT) AS bin_lo, CAST(s.bin_idx * 5 + 5 AS BIGINT) AS bin_hi,
  round(m.median, 6) AS median
FROM spine s LEFT JOIN (SELECT bin_idx, median(l_extendedprice) AS median FROM binned GROUP BY 1) m
  ON m.bin_idx = s.bin_idx""")
def bin_median_spine(spark, sf):
    binned = (
        s.table(spark, sf, "lineitem")
        .select(bins.cut_left_closed(F.col("l_quantity"), 0, 60, 5).alias("bin_idx"), "l_extendedprice")
        .filter(F.col("bin_idx").isNotNull())
    )
    medians = exact_quantiles(binned, ["bin_idx"], "l_extendedprice", (0.5,)).select(
        "bin_idx", F.round("q_0", 6).alias("median")
    )
    return bin_spine(spark, 0, 60, 5).join(medians, "bin_idx", "left")


_LABELS = [f"{u}|{d}" for u in ("Other", "click", "purchase", "signup", "친구 신청") for d in "abc"]


@query("pivot_count_sum", s.with_inputs(s.PEOPLE_SQL, s.USAGE_SQL, body=f"""
SELECT ci_hash, {", ".join(
    f'count(CASE WHEN label = {chr(39)}{c}{chr(39)} THEN quantity END) AS "{c}_freq", '
    f'round(coalesce(sum(CASE WHEN label = {chr(39)}{c}{chr(39)} THEN abs(quantity) END), 0), 4) AS "{c}_vol"'
    for c in _LABELS)}
FROM (SELECT *, coalesce(replace(use_type, '타임어택', '친구 신청'), 'Other') || '|' || description AS label
      FROM usage_log)
WHERE label IS NOT NULL GROUP BY ci_hash"""))
def pivot_count_sum(spark, sf):
    cells = (
        clean_use_type(s.usage_log(spark, sf))
        .filter(F.col("description").isNotNull())
        .withColumn("label", up.pair_label(F.col("use_type"), F.col("description")))
    )
    wide = (
        cells.groupBy("ci_hash")
        .pivot("label", _LABELS)
        .agg(F.count("quantity").alias("freq"), F.round(F.sum(F.abs("quantity")), 4).alias("vol"))
    )
    return wide.na.fill(0, [c for c in wide.columns if c != "ci_hash"])


@query("pivot_nunique_bins", """
SELECT o_orderstatus, """ + ", ".join(
    f"count(DISTINCT CASE WHEN o_totalprice > {lo} AND o_totalprice <= {lo + 100000} THEN o_custkey END)"
    f" AS bin_{lo + 100000}" for lo in range(0, 500000, 100000)) + """
FROM orders GROUP BY o_orderstatus""")
def pivot_nunique_bins(spark, sf):
    binned = s.table(spark, sf, "orders").select(
        "o_orderstatus",
        "o_custkey",
        bins.cut_right_closed(F.col("o_totalprice"), 0, 500000, 100000).alias("bin"),
    )
    labels = list(range(100000, 600000, 100000))
    return distinct_users_by_bin(binned, "o_orderstatus", "bin", "o_custkey", labels)


@query("mean_by_two_keys", s.with_inputs(s.PEOPLE_SQL, s.EXTRACTS_SQL, body="""
SELECT grade, min_rc, round(avg(cumul_rcmd_users), 6) AS cumul_rcmd_users,
  round(avg(cumul_rcmd_response_users), 6) AS cumul_rcmd_response_users
FROM (SELECT *, CAST(floor(user2_relative_score / 30) AS BIGINT) + 1 AS grade FROM early_exposure)
WHERE grade BETWEEN 1 AND 10 AND min_rc IS NOT NULL GROUP BY 1, 2"""))
def mean_by_two_keys(spark, sf):
    measures = ["cumul_rcmd_users", "cumul_rcmd_response_users"]
    graded = s.early_exposure(spark, sf).withColumn(
        "grade", bins.score_grade(F.col("user2_relative_score"), 30)
    )
    means = mean_by(graded, ["grade", "min_rc"], measures).filter(F.col("grade").isin(*range(1, 11)))
    return means.select("grade", "min_rc", *[F.round(m, 6).alias(m) for m in measures])


@query("box_stats", """
WITH q AS (
  SELECT l_returnflag, count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS q1, median(l_extendedprice) AS median,
    quantile_cont(l_extendedprice, 0.75) AS q3
  FROM lineitem GROUP BY 1)
SELECT q.l_returnflag, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  least(min(CASE WHEN l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN l_extendedprice END),
    round(q1, 6)) AS whisker_lo,
  greatest(max(CASE WHEN l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN l_extendedprice END),
    round(q3, 6)) AS whisker_hi,
  count(CASE WHEN NOT l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 1 END) AS n_outliers
FROM lineitem l JOIN q ON q.l_returnflag = l.l_returnflag GROUP BY q.l_returnflag, n, q1, median, q3""")
def box_stats_query(spark, sf):
    stats = box_stats(s.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return stats.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _numeric_sql(table: str, column: str) -> str:
    return f"""
SELECT '{column}' AS column_name, count({column}) AS count, round(avg({column}), 6) AS mean,
  round(stddev_samp({column}), 6) AS std, min({column}) AS min, round(quantile_cont({column}, 0.25), 6) AS p25,
  round(quantile_cont({column}, 0.5), 6) AS p50, round(quantile_cont({column}, 0.75), 6) AS p75,
  max({column}) AS max FROM {table}"""


def _rounded(df):
    names = ("mean", "std", "p25", "p50", "p75")
    return df.withColumns({c: F.round(c, 6) for c in names})


@query("describe_numeric", " UNION ALL ".join(_numeric_sql("lineitem", c) for c in _NUMERIC))
def describe_numeric_query(spark, sf):
    return _rounded(describe_numeric(s.table(spark, sf, "lineitem"), _NUMERIC))


_TEXT = ["ci_hash", "user_group", "use_type", "description"]
_USAGE_NUMERIC = ["relative_score", "purchase_num", "action_num", "quantity"]


def _text_sql(column: str) -> str:
    return f"""
SELECT '{column}' AS column_name, (SELECT count({column}) FROM usage_log) AS count,
  (SELECT count(DISTINCT {column}) FROM usage_log) AS "unique", {column} AS top, count(*) AS freq,
  NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS p25, NULL::DOUBLE AS p50,
  NULL::DOUBLE AS p75, NULL::DOUBLE AS max
FROM usage_log WHERE {column} IS NOT NULL GROUP BY {column}
QUALIFY row_number() OVER (ORDER BY count(*) DESC, {column}) = 1"""


def _usage_numeric_sql(column: str) -> str:
    return f"""
SELECT '{column}' AS column_name, count({column}) AS count, NULL::BIGINT AS "unique", NULL::VARCHAR AS top,
  NULL::BIGINT AS freq, round(avg({column}), 6) AS mean, round(stddev_samp({column}), 6) AS std,
  CAST(min({column}) AS DOUBLE) AS min, round(quantile_cont({column}, 0.25), 6) AS p25,
  round(quantile_cont({column}, 0.5), 6) AS p50, round(quantile_cont({column}, 0.75), 6) AS p75,
  CAST(max({column}) AS DOUBLE) AS max FROM usage_log"""


@query("describe_all", s.with_inputs(s.PEOPLE_SQL, s.USAGE_SQL, body="SELECT * FROM (" + " UNION ALL ".join(
    [f"SELECT * FROM ({_text_sql(c)})" for c in _TEXT]
    + [f"SELECT * FROM ({_usage_numeric_sql(c)})" for c in _USAGE_NUMERIC]) + ")"))
def describe_all_query(spark, sf):
    return _rounded(describe_all(s.usage_log(spark, sf), _USAGE_NUMERIC, _TEXT))


PERIODS_SQL = """kept AS (
  SELECT * FROM usage_log WHERE get_referral_reward = 0 AND user_group IN ('A', 'B') AND ci_hash IS NOT NULL),
first_purchase AS (
  SELECT user_group, ci_hash, min(action_num) AS first_action FROM kept WHERE purchase_num = 1 GROUP BY 1, 2),
labelled AS (
  SELECT k.user_group, k.ci_hash, k.action_num, k.description, abs(k.quantity) AS quantity,
    coalesce(replace(use_type, '타임어택', '친구 신청'), 'Other') AS use_type,
    CASE WHEN f.ci_hash IS NULL THEN 'non' WHEN action_num < first_action THEN 'pre'
      WHEN action_num > first_action AND action_num <= first_action + 10 THEN 'post_10'
      WHEN action_num > first_action + 10 AND action_num <= first_action + 20 THEN 'post_20' END AS period
  FROM kept k LEFT JOIN first_purchase f ON f.user_group = k.user_group AND f.ci_hash = k.ci_hash
  WHERE k.quantity <= 0),
usage AS (
  SELECT user_group, ci_hash, period, use_type, description, count(quantity) AS freq, sum(quantity) AS vol
  FROM labelled WHERE period IS NOT NULL AND description IS NOT NULL GROUP BY 1, 2, 3, 4, 5)"""


@query("period_segments", s.with_inputs(s.PEOPLE_SQL, s.USAGE_SQL, PERIODS_SQL, body="""
SELECT user_group, ci_hash, action_num, period, use_type, quantity FROM labelled WHERE period IS NOT NULL"""))
def period_segments(spark, sf):
    log = up.without_referral(s.usage_log(spark, sf)).filter(F.col("user_group").isin("A", "B"))
    return label_periods(log, "user_group", "ci_hash").select(
        "user_group", "ci_hash", "action_num", "period", "use_type", "quantity"
    )


def _wide_sql(value: str) -> str:
    def cell(label: str) -> str:
        return (
            f"CASE WHEN list_contains(any_value(labels), '{label}') THEN "
            f"coalesce(sum(CASE WHEN label = '{label}' THEN {value} END), 0) END"
        )

    cast = "CAST({} AS BIGINT)" if value == "freq" else "round({}, 4)"
    cells = ", ".join(f'{cast.format(cell(c))} AS "{c}"' for c in _LABELS)
    return s.with_inputs(
        s.PEOPLE_SQL,
        s.USAGE_SQL,
        PERIODS_SQL,
        f"""cells AS (
  SELECT user_group, ci_hash, period, use_type || '|' || description AS label, {value} FROM usage),
seen AS (SELECT user_group, period, list(DISTINCT label) AS labels FROM cells GROUP BY 1, 2)""",
        body=f"""
SELECT c.user_group, c.ci_hash, c.period, {cells}
FROM cells c JOIN seen s ON s.user_group = c.user_group AND s.period = c.period GROUP BY 1, 2, 3""",
    )


def _usage(spark, sf):
    return up.usage_before_after_purchase(
        s.usage_log(spark, sf)
    )


@query("usage_pivot", _wide_sql("vol"))
def usage_pivot_query(spark, sf):
    wide = up.usage_wide(_usage(spark, sf), "vol", _LABELS)
    return wide.withColumns({c: F.round(F.col(f"`{c}`"), 4) for c in _LABELS})


@query("usage_pivot_freq", _wide_sql("freq"))
def usage_pivot_freq(spark, sf):
    return up.usage_wide(_usage(spark, sf), "freq", _LABELS)


@query("union_missing_columns", """
SELECT event_type, purchases, NULL::DOUBLE AS clicks, 'pre' AS period FROM (
  SELECT event_type, round(sum(value), 4) AS purchases FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1)
UNION ALL
SELECT event_type, NULL, clicks, 'post' FROM (
  SELECT event_type, round(avg(value), 4) AS clicks FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)""")
def union_missing_columns(spark, sf):
    events = s.table(spark, sf, "events")
    middle = F.lit("2024-01-15").cast("timestamp_ntz")
    pre = events.filter(F.col("ts") < middle).groupBy("event_type").agg(
        F.round(F.sum("value"), 4).alias("purchases")
    )
    post = events.filter(F.col("ts") >= middle).groupBy("event_type").agg(
        F.round(F.avg("value"), 4).alias("clicks")
    )
    return pre.withColumn("period", F.lit("pre")).unionByName(
        post.withColumn("period", F.lit("post")), allowMissingColumns=True
    )
